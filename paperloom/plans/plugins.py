"""Plug-in points: sentence cutters, metrics and models by name, and presets of options."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass
class Registry:
    """Named functions; a name is given once."""

    kind: str
    known: dict[str, Callable] = field(default_factory=dict)

    def add(self, name: str, function: Callable) -> Callable:
        if name in self.known:
            raise KeyError(f"{self.kind} {name} exists")
        self.known[name] = function
        return function

    def get(self, name: str) -> Callable:
        if name not in self.known:
            raise KeyError(f"no {self.kind} {name}; there are {sorted(self.known)}")
        return self.known[name]


CUTTERS = Registry("sentence cutter", {"zh": lambda c: T.sentences(c, "zh"), "latin": lambda c: T.sentences(c, "latin")})
METRICS = Registry("metric")
MODELS = Registry("model")


@dataclass(frozen=True)
class Options:
    resolution: str = "medium"
    sentence_profile: str = "latin"
    chapter_rules: str = "regex"
    layout_model: str | None = None
    table_model: str | None = None
    keep_headers: bool = False
    merge_tables: bool = True


PRESETS = {"low": Options(resolution="low", merge_tables=False), "medium": Options(), "high": Options(resolution="high", keep_headers=True)}


def options(preset: str = "medium", **changes) -> Options:
    return replace(PRESETS[preset], **changes)


def infer(df: DataFrame, model: str, schema: str) -> DataFrame:
    """Rows through a registered model: a factory that each worker calls once, giving a function from frame to frame."""
    factory = MODELS.get(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        apply = factory()
        for frame in frames:
            yield apply(frame)

    return df.mapInPandas(run, schema)


def merged_settings(base: dict, over: dict) -> dict:
    """base with the values of over; where both hold mappings these are merged in turn. Neither argument changes."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged_settings(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def first_answer(*answers: Column) -> Column:
    """The first answer that is there: a model's, then those of the rules behind it."""
    return F.coalesce(*answers)


def attempted(df: DataFrame, column: str, f: Callable, out: str = "string") -> DataFrame:
    """df with `value`, f of the column in batches, and `error`: what f raised for a row, as text, instead of a failed job."""

    @F.pandas_udf(f"value {out}, error string")
    def run(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            try:
                rows.append((f(v), None))
            except Exception as e:  # noqa: BLE001  any error of the caller's function is a value here
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["value", "error"], dtype=object)

    return df.withColumn("_made", run(column)).select("*", "_made.value", "_made.error").drop("_made")
