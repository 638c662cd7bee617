"""Ordered operators: gaps and islands, clusters by tolerance, as-of assignment, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _so_far(keys: list[str], order: list) -> object:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def islands(df: DataFrame, keys: list[str], order: list, breaks: Column, name: str) -> DataFrame:
    """Numbers runs of rows: a run starts where `breaks` (which may use lag over the same order) is true."""
    return df.withColumn("_break", F.when(breaks, 1).otherwise(0)).withColumn(name, F.sum("_break").over(_so_far(keys, order))).drop("_break")


def before(value: str | Column, keys: list[str], order: list) -> Column:
    """The value in the row before."""
    return F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))


def tolerance_clusters(df: DataFrame, keys: list[str], value: str, tolerance: float, name: str = "cluster") -> DataFrame:
    """Chains of sorted values whose neighbours differ by at most `tolerance`."""
    return islands(df, keys, [value], F.col(value) > before(value, keys, [value]) + tolerance, name)


def snapped(df: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Values moved to the mean of their tolerance cluster."""
    clustered = tolerance_clusters(df, keys, value, tolerance)
    return clustered.withColumn(f"{value}_snapped", F.avg(value).over(Window.partitionBy(*keys, "cluster")))


def merged_intervals(df: DataFrame, keys: list[str], start: str, end: str, tolerance: float = 0.0) -> DataFrame:
    """Unions of intervals that overlap or lie at most `tolerance` apart; null bounds come last, as in SQL. Both windows use one sort, so the first of equal intervals is the same in both."""
    order = [F.col(start).asc_nulls_last(), F.col(end).asc_nulls_last()]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    grouped = islands(df.withColumn("_reach", F.max(end).over(w)), keys, order, F.col(start) > F.col("_reach") + tolerance, "run")
    return grouped.groupBy(*keys, "run").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n"))


def consecutive_runs(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, first, last, n): runs of whole numbers without a gap; repeated and null values count once and not at all."""
    distinct = df.where(F.col(value).isNotNull()).select(*keys, value).distinct()
    run = F.col(value) - F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    return distinct.withColumn("_run", run).groupBy(*keys, "_run").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count(F.lit(1)).alias("n")).drop("_run")


def without_twins(chars: DataFrame, keys: list[str], tolerance: float = 1.0, same: tuple = ("fontname", "size", "upright", "text"), y: str = "doctop", x: str = "x0", order: str = "char_no") -> DataFrame:
    """Characters without those printed twice: of equal ones in a chain of near y and then near x, the first by `order` stays. Null counts as equal to null."""
    alike = [*keys, *same]
    near = tolerance_clusters(tolerance_clusters(chars, alike, y, tolerance, "_y"), [*alike, "_y"], x, tolerance, "_x")
    return first_by(near, [*alike, "_y", "_x"], [order]).drop("_y", "_x")


def lines_by_gap(df: DataFrame, keys: list[str], top: str = "top", bottom: str = "bottom", tie: str = "word_no") -> DataFrame:
    """Line numbers: a new line where the top lies below the bottom of the item before."""
    order = [top, tie]
    return islands(df, keys, order, F.col(top) > before(bottom, keys, order), "line")


def words_by_gap(df: DataFrame, keys: list[str], tolerance: float, x0: str = "x0", x1: str = "x1") -> DataFrame:
    """Word numbers in a line: a new word where x0 lies beyond everything before by more than `tolerance`."""
    w = Window.partitionBy(*keys).orderBy(x0, x1).rowsBetween(Window.unboundedPreceding, -1)
    return islands(df.withColumn("_reach", F.max(x1).over(w)), keys, [x0, x1], F.col(x0) > F.col("_reach") + tolerance, "word").drop("_reach")


def as_of(df: DataFrame, keys: list[str], order: list, value: Column, name: str, default=None) -> DataFrame:
    """The last non-null value up to each row."""
    found = F.last(value, ignorenulls=True).over(_so_far(keys, order))
    return df.withColumn(name, found if default is None else F.coalesce(found, F.lit(default)))


def numbered(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key; order must tell rows apart for a repeatable result."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def top_n(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def most_common(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each key's most frequent value (ties: the smaller) with its count and the key's rows."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("back"), F.col(value).alias("v"))).alias("_m"), F.sum("n").alias("rows"))
    return best.select(*keys, F.col("_m.v").alias(value), (-F.col("_m.back")).alias("n"), "rows")


def flattened_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, line) of every line of every text."""
    return docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
