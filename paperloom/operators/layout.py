"""Page layout: columns, edges, page numbers, tables across pages, heights, hygiene of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G


def readable_chars(chars: DataFrame, longest: int = 3, shadow: float = 0.753, color: str | None = None) -> DataFrame:
    """Characters without unresolved glyph names (texts of more than `longest` code points) and, where `color` names a column, without shadows."""
    kept = chars.where(F.length("text") <= longest)
    return kept if color is None else kept.where(~F.coalesce(F.abs(F.col(color) - shadow) < 1e-9, F.lit(False)))


def with_text(objects: DataFrame, least: int = 1, text: str = "text") -> DataFrame:
    """Objects whose trimmed text has at least `least` code points; null counts as empty."""
    return objects.where(F.length(F.trim(F.coalesce(text, F.lit("")))) >= least)


def expired(files: DataFrame, now: Column, hours: float = 24, changed: str = "modificationTime") -> DataFrame:
    """Files older than `hours`. Only lists them; nothing is deleted."""
    return files.where(F.unix_micros(now) - F.unix_micros(changed) > int(hours * 3_600_000_000))


def rect_edges(rects: DataFrame, thickest: float = 4.0) -> DataFrame:
    """Four edges (orientation, x0, x1, top, bottom) of each rectangle that is thinner than `thickest` in some direction; other columns stay."""
    rest = [c for c in rects.columns if c not in ("x0", "x1", "top", "bottom")]
    thin = rects.where((F.col("x1") - F.col("x0") < thickest) | (F.col("bottom") - F.col("top") < thickest))

    def edge(side: str, orientation: str, x0: str, x1: str, top: str, bottom: str) -> Column:
        return F.struct(F.lit(side).alias("side"), F.lit(orientation).alias("orientation"), F.col(x0).alias("x0"), F.col(x1).alias("x1"), F.col(top).alias("top"), F.col(bottom).alias("bottom"))

    four = F.array(edge("top", "h", "x0", "x1", "top", "top"), edge("bottom", "h", "x0", "x1", "bottom", "bottom"), edge("left", "v", "x0", "x0", "top", "bottom"), edge("right", "v", "x1", "x1", "top", "bottom"))
    return thin.select(*rest, F.inline(four))


def column_gaps(chars: DataFrame, keys: list[str], width: int, bin_width: int = 5, least_side: int = 10, least_run: int = 3) -> DataFrame:
    """(keys, gap_width): width of the first run of empty bins around the middle of a page, 0 if none.

    The middle 40 % of the bins are searched; a run counts if at least `least_run` bins long and ended
    by an occupied bin, and only on pages with more than `least_side` characters in each half.
    """
    bins = width // bin_width
    middle, reach = bins // 2, int(0.2 * bins)
    counts = chars.withColumn("bin", F.floor(F.col("x0") / bin_width).cast("int")).where(F.col("bin").between(0, bins - 1)).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    sides = counts.groupBy(*keys).agg(*[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(s) for s, c in (("_left", F.col("bin") < middle), ("_right", F.col("bin") >= middle))])
    searched = counts.where(F.col("bin").between(middle - reach, middle + reach - 1))
    run = F.col("bin") - F.lag("bin", 1, middle - reach - 1).over(Window.partitionBy(*keys).orderBy("bin")) - 1
    gaps = searched.withColumn("_run", run).where(F.col("_run") >= least_run).groupBy(*keys).agg(F.min_by("_run", "bin").alias("_run"))
    both = (F.col("_left") > least_side) & (F.col("_right") > least_side)
    return sides.join(gaps, keys, "left").select(*keys, F.when(both, F.coalesce("_run", F.lit(0)) * bin_width).otherwise(0).alias("gap_width"))


def inliers(rows: DataFrame, keys: list[str], value: str, sigmas: float = 2.0, least: float = 0.8) -> DataFrame:
    """(keys, n, share, consistent): share of values within `sigmas` population deviations of the mean."""
    w = Window.partitionBy(*keys)
    off = F.round(F.abs(F.col(value) - F.avg(value).over(w)), 6)
    marked = rows.where(F.col(value).isNotNull()).withColumn("_in", off <= F.round(F.stddev_pop(value).over(w) * sigmas, 6))
    share = F.avg(F.col("_in").cast("double"))
    return marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(share, 6).alias("share"), (F.round(share, 6) >= least).alias("consistent"))


def column_side(words: DataFrame, width: float) -> DataFrame:
    """Words with the column of a two-column page that they start in."""
    return words.withColumn("side", F.when(F.col("x0") < width / 2, "left").otherwise("right"))


def continued_page_numbers(pages: DataFrame, known: str = "known", candidate: str = "candidate") -> DataFrame:
    """Page numbers carried on from known ones: a candidate counts if the page before has a number, the digits are one more and the other characters equal.

    A page is numbered if none of the pages since the last known one breaks the series, which needs no recursion.
    """
    w = Window.partitionBy("doc_id").orderBy("page_no")
    text = F.coalesce(known, candidate)
    digits, rest = F.regexp_replace(text, "[^0-9]", "").try_cast("decimal(38,0)"), F.regexp_replace(text, "[0-9]", "")
    rows = pages.withColumn("_digits", digits).withColumn("_rest", rest)
    follows = (F.col("page_no") == F.lag("page_no").over(w) + 1) & (F.col("_digits") == F.lag("_digits").over(w) + 1) & (F.col("_rest") == F.lag("_rest").over(w))
    rows = rows.withColumn("_broken", F.col(known).isNull() & ~F.coalesce(follows, F.lit(False)))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    start = F.max(F.when(F.col(known).isNotNull(), F.col("page_no"))).over(so_far)
    broken = F.max(F.when(F.col("_broken"), F.col("page_no"))).over(so_far)
    rows = rows.withColumn("page_number", F.when(start.isNotNull() & (broken.isNull() | (broken < start)), text))
    return rows.drop("_digits", "_rest", "_broken")


def tables_across_pages(elements: DataFrame) -> DataFrame:
    """(doc_id, page_no) of pages that end with a table where the next page begins with one."""
    ends = elements.groupBy("doc_id", "page_no").agg(F.min_by("type", "idx").alias("first"), F.max_by("type", "idx").alias("last"))
    w = Window.partitionBy("doc_id").orderBy("page_no")
    nxt = ends.withColumn("_next", F.lead("first").over(w)).withColumn("_page", F.lead("page_no").over(w))
    return nxt.where((F.col("last") == "table") & (F.col("_next") == "table") & (F.col("_page") == F.col("page_no") + 1)).select("doc_id", "page_no")


def bucketed_order(boxes: DataFrame, keys: list[str], tolerance: float = 1.25, tie: str = "box_id") -> DataFrame:
    """Place of each box by its rounded top, then by x0."""
    bucket = F.bround(F.col("y0") / tolerance) * tolerance
    return boxes.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(bucket, "x0", tie)))


def distance_threshold(boxes: DataFrame, keys: list[str], step: int = 50, most: float = 20.0) -> DataFrame:
    """A third of the mean height in the most frequent bucket of heights (ties: the lower one), at most `most`."""
    height = F.abs(F.col("y1") - F.col("y0"))
    buckets = boxes.groupBy(*keys, F.least(F.floor(height / step), F.lit(99)).alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"), F.avg(height).alias("_mean"))
    best = buckets.groupBy(*keys).agg(F.max_by("_mean", F.struct("_n", (-F.col("_bucket")).alias("b"))).alias("_mean"))
    return best.select(*keys, F.round(F.least(F.col("_mean") / 3, F.lit(most)), 6).alias("threshold"))


def line_height(boxes: DataFrame, keys: list[str], aspect: float = 2.0, default: float = 10.0) -> DataFrame:
    """Median whole height of the boxes that are more than `aspect` times as wide as high."""
    height = F.col("y1") - F.col("y0")
    flat = F.when((height > 0) & (F.col("x1") - F.col("x0") > aspect * height), F.floor(height))
    return boxes.groupBy(*keys).agg(F.coalesce(F.median(flat), F.lit(default)).alias("line_height"))


# Half of the height that stays of boxes higher than the key.
SHRUNK_HALVES = {30: 7, 25: 6, 20: 5, 15: 4, 10: 3}


def shrunk(b: G.Box) -> tuple[Column, Column]:
    """Top and bottom of a text box drawn in towards its middle, by steps of its height; both are whole numbers."""
    height, middle = b.y1 - b.y0, F.floor((b.y0 + b.y1) / 2)
    half = F.lit(2)
    for above, keep in sorted(SHRUNK_HALVES.items()):
        half = F.when(height > above, keep).otherwise(half)
    high = height > 35
    return F.when(high, (b.y0 + 8).cast("long")).otherwise(middle - half), F.when(high, (b.y1 - 8).cast("long")).otherwise(middle + half)
