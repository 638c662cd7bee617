"""Tables: lattice cells from edges, logical grids, lookups, spans and HTML."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .groups import by_group


def crossings(vertical: DataFrame, horizontal: DataFrame, keys: list[str], tolerance: float = 0.0) -> DataFrame:
    """Vertices (keys, x, y) where a vertical edge (x, y0, y1) meets a horizontal one (y, x0, x1)."""
    v, h = vertical.alias("v"), horizontal.alias("h")
    on = (F.col("v.y0") <= F.col("h.y") + tolerance) & (F.col("v.y1") >= F.col("h.y") - tolerance) & (F.col("v.x") >= F.col("h.x0") - tolerance) & (F.col("v.x") <= F.col("h.x1") + tolerance)
    for k in keys:
        on = on & (F.col(f"v.{k}") == F.col(f"h.{k}"))
    return v.join(h, on).select(*[F.col(f"v.{k}").alias(k) for k in keys], F.col("v.x").alias("x"), F.col("h.y").alias("y"), F.col("v.edge").alias("v_edge"), F.col("h.edge").alias("h_edge")).distinct()


def _smallest_cells(x: np.ndarray, y: np.ndarray, v: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
    """x0, y0, x1, y1 of the smallest cell at each vertex of one table; vertices come by y, then x."""
    corners = set(zip(x.tolist(), y.tolist(), v.tolist(), h.tolist()))
    below: dict = {}
    right: dict = {}
    for a, b, c, d in corners:
        below.setdefault((a, c), set()).add((b, d))
        right.setdefault((b, d), set()).add((a, c))
    down, across = ({k: sorted(n) for k, n in t.items()} for t in (below, right))
    best: dict = {}
    for a, b, c, d in corners:
        cell = next(((y1, x1) for y1, low in down[a, c] if y1 > b for x1, far in across[b, d] if x1 > a and (x1, y1, far, low) in corners), None)
        if cell is not None and cell < best.get((a, b), (np.inf, np.inf)):
            best[a, b] = cell
    found = np.array([(a, b, x1, y1) for (a, b), (y1, x1) in best.items()], float).reshape(-1, 4)
    return list(found.T)


def lattice_cells(points: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest cell below and to the right of each vertex, all four sides on shared edges: the nearest lower vertex first, then the nearest right one.

    One fold over each table's vertices, so no pairs of vertices become rows.
    """
    return by_group(points, keys, ["y", "x"], ["x", "y", "v_edge", "h_edge"], _smallest_cells, "x0 double, y0 double, x1 double, y1 double")


def grid(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Row and column spans (half-open) of boxes from the order of their distinct coordinates."""
    out = cells
    for axis, lo, hi, first, last in (("y", "y0", "y1", "r0", "r1"), ("x", "x0", "x1", "c0", "c1")):
        at = cells.select(*keys, F.explode(F.array(lo, hi)).alias(axis)).distinct().withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy(axis)) - 1)
        out = out.join(at.select(*keys, F.col(axis).alias(lo), F.col("i").alias(first)), [*keys, lo]).join(at.select(*keys, F.col(axis).alias(hi), F.col("i").alias(last)), [*keys, hi])
    return out


def expanded(cells: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each unit cell (r, c) that a spanning cell covers."""
    rows = cells.withColumn("r", F.explode(F.sequence("r0", F.col("r1") - 1)))
    return rows.withColumn("c", F.explode(F.sequence("c0", F.col("c1") - 1)))


def row_of(cells: DataFrame, keys: list[str], row: int) -> DataFrame:
    """Cells that reach into a row, in column order numbers."""
    return cells.where((F.col("r0") <= row) & (F.col("r1") > row)).withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("c0")))


def full_width(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells that reach from the first to the last column of their table."""
    w = Window.partitionBy(*keys)
    ends = cells.withColumn("_c0", F.min("c0").over(w)).withColumn("_c1", F.max("c1").over(w))
    return ends.where("c0 = _c0 AND c1 = _c1").drop("_c0", "_c1")


def followers(cells: DataFrame, keys: list[str], cell: str, down: bool = False) -> DataFrame:
    """(keys, cell, next, place): cells right of (or below) each cell with its very row (column) span, up to the first gap between them.

    The first one may lie apart from the cell. Chains without gaps are numbered, so only pairs of the result are made.
    """
    span, low, high = (("c0", "c1"), "r0", "r1") if down else (("r0", "r1"), "c0", "c1")
    row = Window.partitionBy(*keys, *span).orderBy(low)
    chain = F.sum("_gap").over(row.rowsBetween(Window.unboundedPreceding, 0))
    linked = cells.withColumn("_gap", (F.col(low) != F.coalesce(F.lag(high).over(row), F.col(low))).cast("int")).withColumn("_chain", chain).withColumn("_at", F.row_number().over(row))
    own = linked.select(*keys, *span, cell, (F.col("_at") + 1).alias("_from"), F.lead("_chain").over(row).alias("_chain"))
    later = linked.select(*keys, *span, F.col(cell).alias("next"), "_at", "_chain")
    return own.join(later, [*keys, *span, "_chain"]).where("_at >= _from").select(*keys, cell, "next", (F.col("_at") - F.col("_from")).alias("place"))


def text_rows(cells: DataFrame, keys: list[str], separator: str = "\t") -> DataFrame:
    """Rows of text with the text of merged cells repeated."""
    unit = expanded(cells, keys)
    return unit.groupBy(*keys, "r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "text"))), lambda x: x["text"]), separator).alias("line"))


def to_html(cells: DataFrame, keys: list[str]) -> DataFrame:
    """An HTML table; spans of one are left out of the mark-up."""
    span = lambda name, n: F.when(n > 1, F.concat(F.lit(f' {name}="'), n.cast("string"), F.lit('"'))).otherwise("")
    cell = F.concat(F.lit("<td"), span("rowspan", F.col("r1") - F.col("r0")), span("colspan", F.col("c1") - F.col("c0")), F.lit(">"), F.replace("text", F.lit("\n"), F.lit("<br>")), F.lit("</td>"))
    rows = cells.withColumn("_td", cell).groupBy(*keys, "r0").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c0", "_td"))), lambda x: x["_td"]), "").alias("_tr"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r0", "_tr"))), lambda x: F.concat(F.lit("<tr>"), x["_tr"], F.lit("</tr>"))), "")
    return rows.groupBy(*keys).agg(F.concat(F.lit("<table>"), body, F.lit("</table>")).alias("html"))


def to_markdown(cells: DataFrame, keys: list[str]) -> DataFrame:
    """A Markdown table whose first row is the head."""
    rows = text_rows(cells, keys, " | ").withColumn("_row", F.concat(F.lit("| "), "line", F.lit(" |")))
    lines = rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "_row"))), lambda x: x["_row"]).alias("_rows"))
    lines = lines.join(cells.groupBy(*keys).agg(F.max("c1").cast("int").alias("_n")), keys)
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("_n")))
    return lines.select(*keys, F.concat_ws("\n", F.slice("_rows", 1, 1), F.array(rule), F.slice("_rows", F.lit(2), F.greatest(F.size("_rows") - 1, F.lit(0)))).alias("markdown"))


def stacked(upper: DataFrame, lower: DataFrame, keys: list[str]) -> DataFrame:
    """Two grids over one another; the lower one's first row goes if its texts equal the upper one's first row."""
    head = lambda t: t.where("r0 = 0").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("c0", "text"))), lambda x: x["text"]).alias("head"), F.max("r1").alias("depth"))
    h1, h2 = head(upper), head(lower).withColumnRenamed("head", "head2").withColumnRenamed("depth", "depth2")
    size = upper.groupBy(*keys).agg(F.max("r1").alias("size"))
    shift = size.join(h1, keys, "left").join(h2, keys, "left").select(*keys, "size", F.when(F.col("head") == F.col("head2"), F.col("depth2")).otherwise(0).alias("cut"))
    moved = lower.join(shift, keys).where(F.col("r0") >= F.col("cut")).select(*keys, (F.col("r0") - F.col("cut") + F.col("size")).alias("r0"), "c0", (F.col("r1") - F.col("cut") + F.col("size")).alias("r1"), "c1", "text")
    return upper.select(*keys, "r0", "c0", "r1", "c1", "text").unionByName(moved)


def to_csv(cells: DataFrame, keys: list[str], separator: str = ",") -> DataFrame:
    """(keys, csv): rows of unit cells; texts with the separator, a quote or a line break are quoted."""
    quote = F.col("text").contains(separator) | F.col("text").rlike('["\\n\\r]')
    cell = F.when(quote, F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce("text", F.lit("")))
    rows = text_rows(cells.withColumn("text", cell), keys, separator)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: x["line"])
    return rows.groupBy(*keys).agg(F.array_join(lines, "\n").alias("csv"))


def to_xml(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, xml): a cell element with its spans for each cell, by row and column."""
    text = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cell = F.format_string('<cell r0="%d" c0="%d" r1="%d" c1="%d">%s</cell>', "r0", "c0", "r1", "c1", text)
    inner = F.transform(F.array_sort(F.collect_list(F.struct("r0", "c0", cell.alias("x")))), lambda c: c["x"])
    return cells.groupBy(*keys).agg(F.concat(F.lit("<table>"), F.array_join(inner, ""), F.lit("</table>")).alias("xml"))


def crossing_cells(cells: DataFrame, keys: list[str], row_head: str, column_head: str, cell: str = "text") -> DataFrame:
    """(keys, row_head, column_head, cell): cells in the rows of one head and the columns of another, right of and below them, that no full-width cell parts from the column's head."""
    row, column = cells.alias("r"), cells.alias("c")
    same = lambda a, b: [F.col(f"{a}.{k}") == F.col(f"{b}.{k}") for k in keys]
    on = lambda conditions: [x for c in conditions for x in (c if isinstance(c, list) else [c])]
    inside = [F.col("m.r0") >= F.col("r.r0"), F.col("m.r1") <= F.col("r.r1"), F.col("m.c0") >= F.col("c.c0"), F.col("m.c1") <= F.col("c.c1"), F.col("m.c0") >= F.col("r.c1"), F.col("m.r0") >= F.col("c.r1")]
    heads = row.where(F.col(f"r.{cell}") == row_head).join(column.where(F.col(f"c.{cell}") == column_head), on([same("r", "c")]))
    found = heads.join(cells.alias("m"), on([same("r", "m"), inside]))
    parts = full_width(cells, keys).alias("w")
    free = found.join(parts, on([same("r", "w"), F.col("w.r0") >= F.col("c.r1"), F.col("w.r1") <= F.col("m.r0")]), "left_anti")
    return free.select(*[F.col(f"r.{k}").alias(k) for k in keys], F.col(f"r.{cell}").alias("row_head"), F.col(f"c.{cell}").alias("column_head"), F.col(f"m.{cell}").alias("cell"))


def joins_across(above: Column, below: Column, over: Column, under: Column, share: float = 0.3) -> Column:
    """Whether the last cell of a table's column and the first one of its continuation are one: if either is blank, or if both together are nearer to the cell over (else under) them than the one next to it is, and by less than a share of their length."""
    both = F.concat(above, below)
    nearer = lambda cell, own: (F.levenshtein(both, cell) < share * F.length(both)) & (F.levenshtein(both, cell) < F.levenshtein(own, cell))
    return (above == "") | (below == "") | F.when(over.isNotNull(), nearer(over, above)).otherwise(F.coalesce(nearer(under, below), F.lit(False)))
