"""Sinks: JSON, CSV, text and nested documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NESTED = ("array", "map", "struct")


def json_text(df: DataFrame, digits: int = 4) -> Column:
    """A row as JSON: decimals and doubles rounded, bytes as base64."""
    fields = []
    for name, kind in df.dtypes:
        c = F.col(name)
        fields.append((F.round(c.cast("double"), digits) if kind.startswith(("decimal", "double", "float")) else F.base64(c) if kind == "binary" else c).alias(name))
    return F.to_json(F.struct(*fields))


def write_json(df: DataFrame, path: str) -> None:
    df.select(json_text(df).alias("value")).write.mode("overwrite").text(path)


def flat_columns(df: DataFrame, lead: tuple[str, ...] = ()) -> list[str]:
    """Leading columns, then the others by name; nested ones are left out."""
    plain = [n for n, k in df.dtypes if not k.startswith(NESTED)]
    return [n for n in lead if n in plain] + sorted(n for n in plain if n not in lead)


def write_csv(df: DataFrame, path: str, lead: tuple[str, ...] = ()) -> None:
    df.select(*flat_columns(df, lead)).write.mode("overwrite").option("header", "true").csv(path)


def write_documents(nested: DataFrame, path: str) -> None:
    nested.write.mode("overwrite").json(path)


def write_text(df: DataFrame, path: str, column: str = "text") -> None:
    df.select(column).write.mode("overwrite").text(path)
