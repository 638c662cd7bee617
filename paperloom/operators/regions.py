"""Regions of pages: bands between tables, sizes and headers, captions, cropping, growing and merging of boxes, separators."""

from __future__ import annotations

from functools import cmp_to_key

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from . import boxes as B
from .groups import by_group

# Grey levels of edges that are shading and not lines.
SHADING = [0.651, 0.749, 0.827, 0.753, 0.843, 0.847, 0.857, 0.851, 0.745, 0.898, 0.949, 1]
#: Fixed value: start of the smallest and of the second smallest size.
LARGEST_SIZE = 100.0


def edges_of(edges: DataFrame, orientation: str | None = None, kind: str | None = None, least: float = 1.0, color: str | None = None) -> DataFrame:
    """Edges of an orientation ('h', 'v') and kind that are `least` long; without shading where `color` names a column. Null colours stay."""
    length = F.when(F.col("orientation") == "v", F.col("bottom") - F.col("top")).otherwise(F.col("x1") - F.col("x0"))
    kept = edges.where(length >= least)
    if orientation:
        kept = kept.where(F.col("orientation") == orientation)
    if kind:
        kept = kept.where(F.col("kind") == kind)
    return kept if color is None else kept.where(~F.coalesce(F.col(color).isin(SHADING), F.lit(False)))


def page_sizes(parts: DataFrame, keys: list[str], line: str = "line_no", order: str = "word_no") -> DataFrame:
    """(keys, min_size, second_size, max_size, min_x0, max_x1): sizes of lines' first parts and the text's extent.

    The second smallest size counts repeats; a line that ends in a full-width stop reaches as far as the part before it.
    """
    row = F.array_sort(F.collect_list(F.struct(order, "size", "x0", "x1", "text")))  # the parts of one line
    lines = parts.groupBy(*keys, line).agg(row.alias("_r")).withColumn("_last", F.element_at("_r", -1))
    end = F.when(F.col("_last.text") != "。", F.col("_last.x1")).otherwise(F.get("_r", F.size("_r") - 2)["x1"])
    lines = lines.select(*keys, F.col("_r")[0]["size"].alias("_size"), F.col("_r")[0]["x0"].alias("_x0"), end.alias("_x1"))
    sizes = F.slice(F.array_sort(F.collect_list("_size")), 1, 2)  # the lines of one page
    top = F.lit(LARGEST_SIZE)
    return lines.groupBy(*keys).agg(sizes.alias("_s"), F.greatest(F.max("_size"), F.lit(0.0)).alias("max_size"), F.least(F.min("_x0"), F.lit(100)).alias("min_x0"), F.greatest(F.max("_x1"), F.lit(0)).alias("max_x1")).select(*keys, F.least(F.get("_s", F.lit(0)), top).alias("min_size"), F.least(F.coalesce(F.get("_s", F.lit(1)), top), top).alias("second_size"), "max_size", "min_x0", "max_x1")


def headers(parts: DataFrame, keys: list[str], page_height: float, line: str = "line_no", order: str = "word_no") -> DataFrame:
    """(keys, header): text of a page's first line if it starts in the top tenth, is at most 1 larger than the second smallest size and 0.5 smaller than the largest."""
    first = parts.groupBy(*keys).agg(F.min(line).alias(line), F.max("size").alias("_largest"))
    own = parts.join(first, [*keys, line]).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "size", "top", "text"))).alias("_r"), F.first("_largest").alias("_largest"))
    own = own.join(page_sizes(parts, keys, line, order).select(*keys, "second_size"), keys)
    head, text = F.col("_r")[0], F.trim(F.array_join(F.col("_r.text"), " "))
    fits = (head["top"] < 0.1 * page_height) & (head["size"] <= F.col("second_size") + 1) & (head["size"] < F.col("_largest") - 0.5) & (text != "")
    return own.where(fits).select(*keys, text.alias("header"))


# The characters of a page number.
PAGE_NUMBER = "0-9一二三四五六七八九十页IVXLXCDM第共 -/，"


def page_numbers(parts: DataFrame, keys: list[str], page_height: float, tolerance: float = 0.1, line: str = "line_no", order: str = "word_no") -> DataFrame:
    """(keys, number): text of a page's last line if it reaches the bottom, has 9 characters without blanks at most, only those of numbers, and a last part at most 2 larger than the second smallest size and 0.7 smaller than the largest."""
    last = parts.groupBy(*keys).agg(F.max(line).alias(line), F.max("size").alias("_largest"))
    own = parts.join(last, [*keys, line]).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "size", "bottom", "text"))).alias("_r"), F.first("_largest").alias("_largest"))
    own = own.join(page_sizes(parts, keys, line, order).select(*keys, "second_size"), keys)
    end, text = F.element_at("_r", -1), F.trim(F.array_join(F.col("_r.text"), " "))
    low = end["bottom"] > (1 - tolerance) * page_height - 5
    plain = (text != "") & (F.length(F.replace(text, F.lit(" "), F.lit(""))) <= 9) & ~text.rlike(f"[^{PAGE_NUMBER}]")
    return own.where(low & plain & (end["size"] <= F.col("second_size") + 2) & (end["size"] < F.col("_largest") - 0.7)).select(*keys, text.alias("number"))


def column_of(elements: DataFrame, columns: DataFrame, keys: list[str], id_col: str = "box_id", column: str = "column_no") -> DataFrame:
    """elements with the number of the column of largest overlap across (ties: the larger number); 0 without one."""
    a, b = G.box("l"), G.box("r")
    share = F.round(G.side_overlap(a.x0, a.x1, b.x0, b.x1), 6)
    best = B.pairs(elements, columns, keys, condition=(a.x0 < b.x1) & (b.x0 < a.x1)).groupBy(*[F.col(f"l.{k}").alias(k) for k in keys], F.col(f"l.{id_col}").alias(id_col)).agg(F.max(F.struct(share.alias("s"), F.col(f"r.{column}").alias("c")))["c"].alias(column))
    return elements.join(best, [*keys, id_col], "left").withColumn(column, F.coalesce(column, F.lit(0)))


def numbered_columns(columns: DataFrame, keys: list[str], kind: str = "kind") -> DataFrame:
    """columns with column_no: sub columns from 0 on, from left to right; -1 for full columns, -2 for others."""
    sub = F.col(kind) == "sub column"
    number = F.row_number().over(Window.partitionBy(*keys, sub).orderBy("x0", "y0", "box_id")) - 1
    return columns.withColumn("column_no", F.when(sub, number).when(F.col(kind) == "full column", -1).otherwise(-2))


def words_of_codes(chars: DataFrame, keys: list[str], order: str = "i", gap: int = 4) -> DataFrame:
    """(keys, word, state, text, first, last): decoded characters in words; CJK and other characters make words of their own, and so does a step of more than `gap` decoding columns."""
    w = Window.partitionBy(*keys).orderBy(order)
    cjk = F.col("char").between("\u4e00", "\u9fff")
    state = F.when(cjk, "cn").otherwise("en&num")
    rows = chars.withColumn("_state", state).withColumn("_step", F.col("col") - F.lag("col").over(w))
    new = F.when((F.col("_state") != F.lag("_state").over(w)) | (F.col("_step") > gap), 1).otherwise(0)
    rows = rows.withColumn("_new", new).withColumn("word", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "char"))), lambda x: x["char"]), "")
    return rows.groupBy(*keys, "word").agg(F.min("_state").alias("state"), text.alias("text"), F.min("col").alias("first"), F.max("col").alias("last"))


# Punctuation that a formula and the text behind it both end up with.
DOUBLED = ((",", ",，"), (".", ".。"), ("?", "?？"))


def mended_formulas(parts: DataFrame, keys: list[str], order: str = "place") -> DataFrame:
    """(keys, place, kind, text, x0, y0, x1, y1): lines of text and formulas without doubled punctuation and with numbers as tags.

    An embedded formula loses its last sign if the text behind begins with the same; a number in
    brackets behind an isolated formula, beside it by more than 0.9 of the height, becomes its tag.
    Parts without text go.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    after, last = F.lead("text").over(w), F.right("text", F.lit(1))
    text_next, before = F.lead("kind").over(w) == "text", F.lag("kind").over(w)
    alike = F.lit(False)
    for sign, same in DOUBLED:
        alike = alike | ((last == sign) & F.lit(same).contains(F.left(after, F.lit(1))) & (after != ""))
    rest = F.left("text", F.length("text") - 1)
    doubled = (F.col("kind") == "embedding") & text_next & alike & ~rest.endswith("\\") & ~rest.endswith("\\end")
    beside = lambda step: G.side_overlap(F.col("y0"), F.col("y1"), step("y0").over(w), step("y1").over(w)) > 0.9
    number = r"^[（(]\d+(\.\d+)*[）)]$"
    tagged = (F.col("kind") == "isolated") & text_next & after.rlike(number) & beside(F.lead)
    gone = (F.col("kind") == "text") & (before == "isolated") & F.col("text").rlike(number) & beside(F.lag)
    tag = F.concat("text", F.lit(" \\tag{"), F.substr(after, F.lit(2), F.length(after) - 2), F.lit("}"))
    text = F.when(doubled, rest).when(tagged, tag).when(gone, "").otherwise(F.col("text"))
    made = parts.select(*keys, order, "kind", text.alias("_text"), "x0", "y0", F.when(tagged, F.greatest("x1", F.lead("x1").over(w))).otherwise(F.col("x1")).alias("x1"), "y1")
    return made.where(F.trim("_text") != "").withColumnRenamed("_text", "text")


def merged_borders(lines: DataFrame, keys: list[str], near: float, id_col: str = "box_id") -> DataFrame:
    """(keys, line, at, lo, hi, n): borders (at, lo, hi) joined that are within `near` of each other and whose stretches overlap or nearly do, also through others, at their mean."""
    a, b = lines.alias("l"), lines.alias("r")
    on = (F.abs(F.col("l.at") - F.col("r.at")) <= near) & (F.col(f"l.{id_col}") < F.col(f"r.{id_col}")) & (G.interval_iou(F.col("l.lo"), F.col("l.hi"), F.col("r.lo"), F.col("r.hi")) > -0.1)
    for k in keys:
        on = on & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    edges = a.join(b, on).select(*[F.col(f"l.{k}").alias(k) for k in keys], F.col(f"l.{id_col}").alias("a"), F.col(f"r.{id_col}").alias("b"))
    found = B.components(edges, lines.select(*keys, F.col(id_col).alias("id")), keys).withColumnRenamed("id", id_col)
    return lines.join(found, [*keys, id_col]).groupBy(*keys, F.col("component").alias("line")).agg(F.avg("at").alias("at"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("n"))


def bands(tables: DataFrame, keys: list[str], page_top: float, page_bottom: float) -> DataFrame:
    """(keys, band, lo, hi): the stretches of pages between tables, from whole coordinates; pages without tables have none."""
    lo, hi = F.floor("y0").cast("long"), F.floor("y1").cast("long")
    t = tables.select(*keys, lo.alias("lo"), hi.alias("hi"))
    w = Window.partitionBy(*keys).orderBy("lo", "hi")
    above = t.select(*keys, (F.row_number().over(w) - 1).cast("int").alias("band"), F.lag("hi", 1, int(page_top)).over(w).alias("lo"), F.col("lo").alias("hi"))
    last = t.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("band"), F.max(F.struct("lo", "hi"))["hi"].alias("lo")).withColumn("hi", F.lit(int(page_bottom)).cast("long"))
    return above.unionByName(last)


def in_bands(items: DataFrame, between: DataFrame, keys: list[str], id_col: str = "box_id") -> DataFrame:
    """(keys, id, band): the first band that holds an item wholly; the lower border is outside."""
    held = B.pairs(items, between, keys, condition=(F.col("l.y0") >= F.col("r.lo")) & (F.col("l.y1") < F.col("r.hi")))
    return held.groupBy(*[F.col(f"l.{k}").alias(k) for k in keys], F.col(f"l.{id_col}").alias(id_col)).agg(F.min("r.band").alias("band"))


def captioned(elements: DataFrame, keys: list[str], order: str = "box_id", kind: str = "kind") -> DataFrame:
    """Figures grown over the caption that follows within (-6, 80); other elements as they are."""
    w = Window.partitionBy(*keys).orderBy(order)
    after = lambda c: F.lead(c).over(w)
    gap = after("y0") - F.col("y1")
    joins = (F.col(kind) == "figure") & (after(kind) == "figure caption") & (gap > -6) & (gap < 80)
    grown = {"x0": F.least("x0", after("x0")), "x1": F.greatest("x1", after("x1")), "y0": F.greatest(F.lit(0.0), "y0"), "y1": F.greatest(F.col("y1"), after("y0") - 16)}
    return elements.withColumns({c: F.when(joins, v).otherwise(F.col(c)) for c, v in grown.items()})


def cropped_by(texts: DataFrame, formulas: DataFrame, keys: list[str], least: float = 0.1, narrowest: float = 2.0, id_col: str = "box_id") -> DataFrame:
    """(keys, id, x0, y0, x1, y1): text boxes without the part that the formula of largest overlap covers.

    Overlap is the product of both sides' overlaps over the shorter side; below `least` a box stays
    whole, else the parts left and right of the formula stay if they are wide enough.
    """
    a, b = G.box("l"), G.box("r")
    value = F.round(G.side_overlap(a.x0, a.x1, b.x0, b.x1) * G.side_overlap(a.y0, a.y1, b.y0, b.y1), 6)
    best = B.pairs(texts, formulas, keys, condition=G.touches(a, b)).groupBy(*[F.col(f"l.{k}").alias(k) for k in keys], F.col(f"l.{id_col}").alias(id_col)).agg(F.max(F.struct(value.alias("value"), (-F.col(f"r.{id_col}")).alias("back"), F.col("r.x0").alias("f0"), F.col("r.x1").alias("f1"))).alias("_f"))
    joined = texts.join(best.where(F.col("_f.value") >= least), [*keys, id_col], "left")
    part = lambda x0, x1: F.struct(x0.alias("x0"), x1.alias("x1"))
    left, right = F.least(F.col("x1"), F.col("_f.f0")), F.greatest(F.col("x0"), F.col("_f.f1"))
    parts = F.when(F.col("_f").isNull(), F.array(part(F.col("x0"), F.col("x1")))).otherwise(F.filter(F.array(part(F.col("x0"), left), part(right, F.col("x1"))), lambda p: p["x1"] - p["x0"] >= narrowest))
    return joined.select(*keys, id_col, "y0", "y1", F.inline(parts)).select(*keys, id_col, "x0", "y0", "x1", "y1")


def taller(boxes: DataFrame, keys: list[str], page_height: float, line: str = "line_no", is_text: Column | None = None, ratio: float = 0.2) -> DataFrame:
    """Text boxes grown up and down by a third of the way to the next lines, `ratio` of their height at most.

    Downwards the next line's upper border counts as it was, upwards the line above as it has grown.
    """
    is_text = F.lit(True) if is_text is None else is_text
    lines = boxes.groupBy(*keys, line).agg(F.min("y0").alias("_top"))
    w = Window.partitionBy(*keys).orderBy(line)
    below = lines.select(*keys, line, F.lead("_top", 1, page_height).over(w).alias("_below"))
    most = F.floor(ratio * (F.col("y1") - F.col("y0")))
    down = F.when(is_text & (F.col("y1") < F.col("_below")), F.least(F.floor((F.col("_below") - F.col("y1")) / 3), most)).otherwise(0)
    grown = boxes.join(below, [*keys, line]).withColumn("_y1", F.col("y1") + down)
    reach = grown.groupBy(*keys, line).agg(F.max("_y1").alias("_reach"))
    above = reach.select(*keys, line, F.lag("_reach", 1, 0.0).over(w).alias("_above"))
    up = F.when(is_text & (F.col("y0") > F.col("_above")), F.least(F.floor((F.col("y0") - F.col("_above")) / 3), most)).otherwise(0)
    return grown.join(above, [*keys, line]).withColumn("y0", F.col("y0") - up).withColumn("y1", F.col("_y1")).drop("_y1", "_below", "_above")


def merged_neighbours(boxes: DataFrame, keys: list[str], kind: str = "kind", id_col: str = "box_id") -> DataFrame:
    """(keys, id, kind, x0, y0, x1, y1): texts next to each other in a line joined if the gap is at most the height; a text reaches to a formula as near.

    A fold over each line's boxes from left to right within the engine; lines bound the arrays. A
    joined box keeps its first id.
    """
    names = [id_col, kind, "x0", "y0", "x1", "y1"]
    order = F.struct(F.col("x0").alias("_at"), F.col(id_col).alias("_id"), F.struct(*names).alias("b"))
    items = boxes.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["b"]).alias("_items"))

    def step(done, new):
        last = F.element_at(done, -1)
        rest = F.slice(done, F.lit(1), F.size(done) - 1)
        gap, tall = new["x0"] - last["x1"], new["y1"] - new["y0"]
        make = lambda base, **put: F.struct(*[put.get(n, base[n]).alias(n) for n in names])
        text = lambda b: b[kind] == "text"
        near = (gap > 0) & (gap <= tall)
        both = F.array(make(last, x1=new["x1"], y0=F.least(last["y0"], new["y0"]), y1=F.greatest(last["y1"], new["y1"])))
        right = F.array(make(last, x1=new["x0"]), new)
        left = F.array(last, make(new, x0=last["x1"]))
        add = F.when(text(last) & text(new) & (gap <= tall), both).when(text(last) & ~text(new) & near, right).when(~text(last) & text(new) & near, left).otherwise(F.array(last, new))
        return F.when(F.size(done) == 0, F.array(new)).otherwise(F.concat(rest, add))

    folded = F.aggregate("_items", F.slice("_items", 1, 0), step)
    return items.select(*keys, F.inline(folded))


def _anchored(ids: np.ndarray, *sides: np.ndarray) -> list[np.ndarray]:
    """Lines of one page, grown from their topmost free box to the right and then to the left."""
    b = np.stack(sides, axis=1).astype(float)
    free = np.ones(len(b), bool)

    def share(i: int, j: int) -> float:
        return max(0.0, min(b[i, 3], b[j, 3]) - max(b[i, 1], b[j, 1])) / max(1.0, min(b[i, 3] - b[i, 1], b[j, 3] - b[j, 1]))

    def next_to(anchor: int, line: list[int], to_right: bool) -> int | None:
        wide = b[anchor, 2] - b[anchor, 0]
        slack = min(max(20.0, wide / 2), wide * 0.95)
        fits = [i for i in line if free[i] and (b[i, 0] >= b[anchor, 2] - slack if to_right else b[i, 2] <= b[anchor, 0] + slack)]

        def compare(i: int, j: int) -> float:
            if b[i, 2] < b[j, 0] - 3:
                return -1
            if b[j, 2] < b[i, 0] - 3:
                return 1
            p, q = share(i, anchor), share(j, anchor)
            if max(p, q) >= 3 * min(p, q):
                return q - p if to_right else p - q
            return b[i, 0] - b[j, 0]

        ranked = sorted(fits, key=cmp_to_key(compare))
        return (ranked[0] if to_right else ranked[-1]) if ranked else None

    rows, n_lines = [], 0
    for start in range(len(b)):
        if not free[start]:
            continue
        free[start] = False
        line = [start]
        for i in range(len(b)):
            if free[i] and max(share(i, j) for j in line) > 0.1:
                line.append(i)
        found = [start]
        for to_right in (True, False):
            at = start
            while (at := next_to(at, line[1:], to_right)) is not None:
                free[at] = False
                found = [*found, at] if to_right else [at, *found]
        rows += [(i, n_lines, place + 1) for place, i in enumerate(found)]
        n_lines += 1
    at, lines, places = (np.array(x) for x in zip(*rows))
    return [ids[at], lines.astype(np.int32), places.astype(np.int32)]


def anchored_lines(boxes: DataFrame, keys: list[str], id_col: str = "box_id") -> DataFrame:
    """(keys, id, line_no, place): lines grown from anchors; boxes of a line share a tenth of their height with it.

    The comparison of neighbours is not transitive, so the order of one page's boxes decides.
    """
    kind = dict(boxes.dtypes)[id_col]
    return by_group(boxes, keys, ["y0", id_col], [id_col, "x0", "y0", "x1", "y1"], _anchored, f"{id_col} {kind}, line_no int, place int")


def holding(containers: DataFrame, packages: DataFrame, keys: list[str], share: float = 0.5, id_col: str = "box_id", score: str = "score") -> DataFrame:
    """(keys, id, n_packages): containers that hold a package, and the best-scored one of each page in any case.

    A package belongs to the container of the largest share of it (ties: the better scored), if that is at least `share`.
    """
    a, b = G.box("l"), G.box("r")
    held = F.round(G.share_of(b, a), 6)
    own = B.pairs(packages, containers, keys, condition=G.touches(a, b)).where(held >= share)
    own = own.groupBy(*[F.col(f"l.{k}").alias(k) for k in keys], F.col(f"l.{id_col}").alias("_package")).agg(F.max(F.struct(held.alias("h"), F.col(f"r.{score}").alias("s"), (-F.col(f"r.{id_col}")).alias("i"))).alias("_m"))
    n = own.groupBy(*keys, (-F.col("_m.i")).alias(id_col)).agg(F.count(F.lit(1)).alias("n_packages"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), id_col)) == 1
    ranked = containers.select(*keys, id_col, first.alias("_first")).join(n, [*keys, id_col], "left")
    return ranked.where("_first or n_packages is not null").select(*keys, id_col, F.coalesce("n_packages", F.lit(0)).alias("n_packages"))


def separators(boxes: DataFrame, keys: list[str], lo: str = "x0", hi: str = "x1", least: float = 0.0) -> DataFrame:
    """(keys, place, at, gap): middles of the gaps of more than `least` that no box of a page covers along one axis."""
    w = Window.partitionBy(*keys).orderBy(lo, hi)
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    found = boxes.withColumn("_reach", reach).where(F.col(lo) - F.col("_reach") > least)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(lo, hi))
    return found.select(*keys, place.alias("place"), ((F.col(lo) + F.col("_reach")) / 2).alias("at"), (F.col(lo) - F.col("_reach")).alias("gap"))


def run_middles(cells: DataFrame, keys: list[str], index: str = "i", marked: str = "marked") -> DataFrame:
    """(keys, run, at, n): middles (rounded down) of the runs of marked cells."""
    own = cells.where(F.col(marked))
    island = F.col(index) - F.row_number().over(Window.partitionBy(*keys).orderBy(index))
    runs = own.withColumn("_g", island).groupBy(*keys, "_g").agg(F.min(index).alias("_a"), F.max(index).alias("_b"), F.count(F.lit(1)).alias("n"))
    run = F.row_number().over(Window.partitionBy(*keys).orderBy("_a"))
    return runs.select(*keys, run.alias("run"), F.floor((F.col("_a") + F.col("_b")) / 2).cast("long").alias("at"), "n")


def implied_rows(words: DataFrame, keys: list[str], least_words: int, tolerance: float = 1.0) -> DataFrame:
    """(keys, y, x0, x1): horizontal edges along the tops of clusters of `least_words` words, and one below the lowest of them.

    Tops belong together while each is within the tolerance of the one before.
    """
    w = Window.partitionBy(*keys).orderBy("top")
    new = F.when(F.col("top") - F.lag("top").over(w) <= tolerance, 0).otherwise(1)
    grouped = words.withColumn("_new", new).withColumn("_g", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    rows = grouped.groupBy(*keys, "_g").agg(F.count(F.lit(1)).alias("n"), F.min("top").alias("y"), F.max("bottom").alias("_b"), F.min("x0").alias("x0"), F.max("x1").alias("x1")).where(F.col("n") >= least_words)
    extent = rows.groupBy(*keys).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.max("_b").alias("_b"))
    tops = rows.select(*keys, "y").join(extent, keys).select(*keys, "y", "x0", "x1")
    return tops.unionByName(extent.select(*keys, F.col("_b").alias("y"), "x0", "x1"))


def implied_columns(words: DataFrame, keys: list[str], least_words: int, tolerance: float = 1.0) -> DataFrame:
    """(keys, x, y0, y1): vertical edges left of clusters of `least_words` words with the same left, right or middle place, and one right of all.

    Clusters count from the largest on (left places first); one whose box touches that of an earlier one goes.
    """

    def fold(x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> list[np.ndarray]:
        clusters = []
        for at in (x0, x1, (x0 + x1) / 2):
            order = np.argsort(at, kind="stable")
            parts = np.split(order, np.flatnonzero(np.diff(at[order]) > tolerance) + 1)
            clusters += [p for p in parts if len(p) >= least_words]
        kept: list[tuple] = []
        for p in sorted(clusters, key=len, reverse=True):
            b = (x0[p].min(), y0[p].min(), x1[p].max(), y1[p].max())
            sides = [(min(b[2], c[2]) - max(b[0], c[0]), min(b[3], c[3]) - max(b[1], c[1])) for c in kept]
            if not any(w >= 0 and h >= 0 and w + h > 0 for w, h in sides):
                kept.append(b)
        if not kept:
            return [np.zeros(0)] * 3
        x = np.array([*sorted(b[0] for b in kept), max(b[2] for b in kept)], float)
        return [x, np.full(len(x), min(b[1] for b in kept), float), np.full(len(x), max(b[3] for b in kept), float)]

    return by_group(words, keys, ["top", "x0", "x1"], ["x0", "x1", "top", "bottom"], fold, "x double, y0 double, y1 double")


STRATEGIES = ("lines", "lines_strict", "text", "explicit")


def table_edges(edges: DataFrame, words: DataFrame, keys: list[str], vertical: str = "lines", horizontal: str = "lines", explicit: DataFrame | None = None, least_words: tuple[int, int] = (3, 1)) -> DataFrame:
    """(keys, orientation, x0, x1, top, bottom): edges of tables by a strategy for each orientation, and the explicit ones in any case.

    lines: all edges; lines_strict: those of drawn lines only (kind 'line'); text: those that words imply
    (least_words upright and level); explicit: none beside the explicit ones. Equal edges come once.
    """
    columns = [*keys, "orientation", "x0", "x1", "top", "bottom"]
    parts = [] if explicit is None else [explicit.select(*columns)]
    for orientation, strategy in (("v", vertical), ("h", horizontal)):
        if strategy not in STRATEGIES:
            raise ValueError(f"a strategy is one of {STRATEGIES}")
        if strategy.startswith("lines"):
            own = edges.where(F.col("orientation") == orientation)
            parts.append((own.where("kind = 'line'") if strategy == "lines_strict" else own).select(*columns))
        elif strategy == "text" and orientation == "h":
            parts.append(implied_rows(words, keys, least_words[1]).select(*keys, F.lit("h").alias("orientation"), "x0", "x1", F.col("y").alias("top"), F.col("y").alias("bottom")))
        elif strategy == "text":
            parts.append(implied_columns(words, keys, least_words[0]).select(*keys, F.lit("v").alias("orientation"), F.col("x").alias("x0"), F.col("x").alias("x1"), F.col("y0").alias("top"), F.col("y1").alias("bottom")))
    if not parts:
        return edges.select(*columns).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*keys, "orientation", *[F.col(c).cast("double").alias(c) for c in ("x0", "x1", "top", "bottom")]).distinct()


def assigned_columns(elements: DataFrame, columns: DataFrame, keys: list[str], least: float = 0.1, id_col: str = "box_id") -> DataFrame:
    """elements with the id of the column that holds the largest share of their area (ties: the smaller id) if that is above `least`, else null."""
    a, b = G.box("l"), G.box("r")
    held = F.round(G.share_of(b, a), 6)
    best = B.pairs(elements, columns, keys, condition=G.touches(a, b)).where(held > least).groupBy(*[F.col(f"l.{k}").alias(k) for k in keys], F.col(f"l.{id_col}").alias(id_col)).agg((-F.max(F.struct(held.alias("h"), (-F.col(f"r.{id_col}")).alias("i")))["i"]).alias("column_id"))
    return elements.join(best, [*keys, id_col], "left")


def span_texts(spans: DataFrame, keys: list[str], without_superscripts: bool = True) -> DataFrame:
    """(keys, text): spans in the order of block, line and place, joined by blanks; raised whole numbers are left out. Groups without another span are not returned."""
    kept = spans.where(~(F.coalesce(F.col("raised"), F.lit(False)) & F.col("text").rlike(r"^\s*[+-]?\d+\s*$"))) if without_superscripts else spans
    order = lambda *c: F.array_sort(F.collect_list(F.struct(*c, "text")))
    lines = kept.groupBy(*keys, "block", "line").agg(F.trim(F.array_join(F.transform(order("place"), lambda x: x["text"]), " ")).alias("text"))
    return lines.groupBy(*keys).agg(F.trim(F.array_join(F.transform(order("block", "line"), lambda x: x["text"]), " ")).alias("text"))


def dominant_angle(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, angle): upper median of the first sides' angles of boxes three times as long as high, else of the others. Corners are x0..x2, y0..y2."""
    side = lambda i, j: F.sqrt(F.pow(F.col(f"x{j}") - F.col(f"x{i}"), 2) + F.pow(F.col(f"y{j}") - F.col(f"y{i}"), 2))
    angle = F.round(F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")), 6)
    both = boxes.select(*keys, angle.alias("_a"), (side(0, 1) > 3 * side(1, 2)).alias("_long")).groupBy(*keys).agg(*[F.array_sort(F.collect_list(F.when(c, F.col("_a")))).alias(n) for c, n in ((F.col("_long"), "_l"), (~F.col("_long"), "_o"))])  # boxes of one page
    pick = F.when(F.size("_l") > 0, F.col("_l")).otherwise(F.col("_o"))
    return both.select(*keys, F.get(pick, F.floor(F.size(pick) / 2).cast("int")).alias("angle"))


def distinct_ranks(logits: np.ndarray) -> list[int]:
    """A place for each row: its best column; of rows that want the same one the best keeps it, the others take their next, until all differ."""
    order = np.argsort(logits, axis=1, kind="stable")
    tries = np.full(len(logits), logits.shape[1] - 1)
    while True:
        want = order[np.arange(len(logits)), tries]
        again = []
        for column in np.unique(want):
            rows = np.flatnonzero(want == column)
            if len(rows) > 1:
                best = rows[np.argmax(logits[rows, column])]
                again += [r for r in rows if r != best]
        if not again:
            return want.tolist()
        tries[again] -= 1


def ranked(rows: DataFrame, keys: list[str], index: str = "i", logits: str = "logits") -> DataFrame:
    """(keys, i, place) of each group's rows, whose logits hold a value for each place; a group is one page's elements."""

    def fold(i: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
        return [i, np.array(distinct_ranks(np.stack([x[: len(i)] for x in values])), np.int32)]

    return by_group(rows, keys, [index], [index, logits], fold, f"{index} {dict(rows.dtypes)[index]}, place int")
