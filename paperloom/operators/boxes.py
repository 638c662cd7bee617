"""Joins, suppression and clustering of boxes within an image or page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G


def pairs(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", condition=None) -> DataFrame:
    """Box join: equal keys and a condition on aliases l and r. The keys bound the pairs to a page."""
    a, b = left.alias("l"), right.alias("r")
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    return a.join(b, on if condition is None else on & condition, how)


def tiled(boxes: DataFrame, side: float) -> DataFrame:
    """Boxes once for each square tile (tx, ty) of a page that they reach into."""
    at = lambda c: F.floor(F.col(c) / side)
    return boxes.withColumn("tx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("ty", F.explode(F.sequence(at("y0"), at("y1"))))


def iou_pairs(boxes: DataFrame, keys: list[str], least: float, id_col: str = "box_id", tile: float | None = None) -> DataFrame:
    """Pairs of boxes of an image with their IoU, from `least` on; the smaller id first.

    With a tile side, boxes meet within tiles instead of whole images, each pair in the tile of
    its intersection's upper left corner only; for pages of very many boxes.
    """
    a, b = G.box("l"), G.box("r")
    on = (F.col(f"l.{id_col}") < F.col(f"r.{id_col}")) & G.touches(a, b)
    if tile:
        i = G.intersection(a, b)
        on = on & (F.floor(i.x0 / tile) == F.col("l.tx")) & (F.floor(i.y0 / tile) == F.col("l.ty"))
        joined = pairs(tiled(boxes, tile), tiled(boxes, tile), [*keys, "tx", "ty"], condition=on)
    else:
        joined = pairs(boxes, boxes, keys, condition=on)
    out = joined.select(*[F.col(f"l.{k}").alias(k) for k in keys], F.col(f"l.{id_col}").alias("a"), F.col(f"r.{id_col}").alias("b"), F.round(G.iou(a, b), 6).alias("iou"))
    return out.where(F.col("iou") >= least)


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], least: float) -> DataFrame:
    """Boxes of left that some box of right overlaps by more than `least`."""
    return pairs(left, right, keys, "left_semi", G.iou(G.box("l"), G.box("r")) > least)


def not_overlapping(left: DataFrame, right: DataFrame, keys: list[str], least: float) -> DataFrame:
    """Boxes of left whose IoU with every box of right is below `least`."""
    return pairs(left, right, keys, "left_anti", G.iou(G.box("l"), G.box("r")) >= least)


def best_match(items: DataFrame, slots: DataFrame, keys: list[str], least: float, item_id: str, slot_id: str) -> DataFrame:
    """Each item with the slot of largest overlap (a containing slot first, then IoU, then the smaller id)."""
    a, b = G.box("l"), G.box("r")
    inside = G.contains(b, a)
    joined = pairs(items, slots, keys, condition=G.touches(a, b)).select(*[F.col(f"l.{k}").alias(k) for k in keys], F.col(f"l.{item_id}").alias("item"), F.col(f"r.{slot_id}").alias("slot"), F.when(inside, 1.0).otherwise(F.round(G.iou(a, b), 6)).alias("score"))
    best = joined.where(F.col("score") > least).groupBy(*keys, "item").agg(F.max(F.struct("score", (-F.col("slot")).alias("back"))).alias("m"))
    return best.select(*keys, "item", (-F.col("m.back")).alias("slot"), F.col("m.score").alias("score"))


def slotted(items: DataFrame, containers: DataFrame, keys: list[str], share: float, item_id: str, container_id: str) -> DataFrame:
    """All containers that hold at least `share` of an item's area."""
    a, b = G.box("l"), G.box("r")
    held = F.round(G.share_of(b, a), 6)
    return pairs(items, containers, keys, condition=G.touches(a, b)).select(*[F.col(f"l.{k}").alias(k) for k in keys], F.col(f"l.{item_id}").alias("item"), F.col(f"r.{container_id}").alias("container"), held.alias("share")).where(F.col("share") >= share)


def uncontained(boxes: DataFrame, keys: list[str], share: float, id_col: str = "box_id") -> DataFrame:
    """Boxes of which no larger box (or equal one with a smaller id) holds `share` of the area."""
    a, b = G.box("l"), G.box("r")
    larger = (G.area(b) > G.area(a)) | ((G.area(b) == G.area(a)) & (F.col(f"r.{id_col}") < F.col(f"l.{id_col}")))
    return pairs(boxes, boxes, keys, "left_anti", larger & (F.round(G.share_of(b, a), 6) >= share))


def nms(boxes: DataFrame, keys: list[str], least: float, most: int | None = None, label: str | None = "label", id_col: str = "box_id", score: str = "score", measure: str = "iou", keep_higher: bool = True) -> DataFrame:
    """Greedy suppression: by falling score (ties: smaller id; rising without keep_higher), a box goes if a kept one of its label overlaps it by `least`.

    The measure is the IoU or the share of the kept box ('kept') or of the later one ('own') that overlaps.

    Runs as a fold over each image's sorted boxes within the engine; images bound the arrays.
    """
    fields = [id_col, score, "x0", "y0", "x1", "y1"] + ([label] if label else [])
    row = F.struct((-F.col(score) if keep_higher else F.col(score)).alias("_order"), *[F.col(c) for c in fields])
    items = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("items"))
    measures = {"iou": G.iou, "kept": lambda a, b: G.share_of(b, a), "own": G.share_of}
    empty = F.slice("items", 1, 0)

    def hit(kept, new):
        a, b = G.Box(kept["x0"], kept["y0"], kept["x1"], kept["y1"]), G.Box(new["x0"], new["y0"], new["x1"], new["y1"])
        near = F.round(measures[measure](a, b), 6) >= least
        return near & (kept[label] == new[label]) if label else near

    folded = F.aggregate("items", empty, lambda kept, new: F.when(F.exists(kept, lambda k: hit(k, new)), kept).otherwise(F.array_append(kept, new)))
    kept = F.slice(folded, 1, most) if most else folded
    return items.select(*keys, F.explode(kept).alias("_k")).select(*keys, *[F.col(f"_k.{c}").alias(c) for c in fields])


def points_in_boxes(points: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Half-open point-in-box join of points (x, y) with boxes."""
    b = G.box("r")
    return pairs(points, boxes, keys, condition=(F.col("l.x") >= b.x0) & (F.col("l.x") < b.x1) & (F.col("l.y") >= b.y0) & (F.col("l.y") < b.y1))


def reading_order(boxes: DataFrame, keys: list[str], ratio: float = 0.4, id_col: str = "box_id") -> DataFrame:
    """Line and place of each box: a line breaks where the top moves by `ratio` of the height of the box before."""
    w = Window.partitionBy(*keys).orderBy("y0", "x0", id_col)
    h = F.lag(F.col("y1") - F.col("y0")).over(w)
    new = F.when(F.abs(F.col("y0") - F.lag("y0").over(w)) >= ratio * h, 1).otherwise(0)
    lined = boxes.withColumn("_new", new).withColumn("line_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return lined.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "line_no").orderBy("x0", id_col))).drop("_new")


def components(edges: DataFrame, nodes: DataFrame, keys: list[str], rounds: int = 50) -> DataFrame:
    """Smallest id reachable within an image, for small page-local graphs: edges (keys, a, b), nodes (keys, id).

    Labels that still change after `rounds` rounds are an error.

    Labels move along edges and then jump to their own label's label; every round is written to the
    session's checkpoint folder, so that lineage stays short.
    """
    spark = nodes.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):  # single machines and tests: the warehouse is shared as well
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/paperloom-lineage")
    both = edges.select(*keys, "a", "b").unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    labels = nodes.select(*keys, "id", F.col("id").alias("label")).distinct()
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("id", "b"), [*keys, "b"]).groupBy(*keys, "a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "id"), [*keys, "id"], "left").select(*keys, "id", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = step.select(*keys, F.col("id").alias("label"), F.col("label").alias("further"))
        step = step.join(jump, [*keys, "label"]).select(*keys, "id", "was", F.least("label", "further").alias("label")).checkpoint()
        labels = step.select(*keys, "id", "label")
        if step.where("was <> label").isEmpty():
            break
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    return labels.withColumnRenamed("label", "component")


def filtered_nms(boxes: DataFrame, keys: list[str], conf: float = 0.25, least: float = 0.45, classes: list | None = None, agnostic: bool = False, best: int = 30_000, most: int = 300, label: str = "label", id_col: str = "box_id", score: str = "score") -> DataFrame:
    """Detections above `conf` of some classes, the `best` of an image by score, suppressed within labels (or across them), `most` of an image."""
    kept = boxes.where(F.col(score) > conf)
    if classes is not None:
        kept = kept.where(F.col(label).isin(classes))
    order = Window.partitionBy(*keys).orderBy(F.desc(score), id_col)
    kept = kept.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= best).drop("_rank")
    out = nms(kept, keys, least, most, None if agnostic else label, id_col, score)
    return out.join(kept.select(*keys, id_col, label), [*keys, id_col]) if agnostic else out


def _at(row) -> G.Box:
    return G.Box(row["x0"], row["y0"], row["x1"], row["y1"])


def area_suppressed(boxes: DataFrame, keys: list[str], share: float = 0.5, id_col: str = "box_id") -> DataFrame:
    """By falling area (ties: smaller id), a box goes if a kept one holds `share` of its area."""
    row = F.struct((-G.area(G.box())).alias("_order"), *[F.col(c) for c in (id_col, "x0", "y0", "x1", "y1")])
    items = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("items"))
    folded = F.aggregate("items", F.slice("items", 1, 0), lambda kept, new: F.when(F.exists(kept, lambda k: F.round(G.share_of(_at(k), _at(new)), 6) >= share), kept).otherwise(F.array_append(kept, new)))
    return items.select(*keys, F.explode(folded).alias("_k")).select(*keys, *[F.col(f"_k.{c}").alias(c) for c in (id_col, "x0", "y0", "x1", "y1")])


def soft_nms(boxes: DataFrame, keys: list[str], sigma: float = 0.5, least_score: float = 0.001, id_col: str = "box_id", score: str = "score") -> DataFrame:
    """(keys, id, score): the best box is taken again and again, and the scores of the others fall by exp(-IoU^2 / sigma); those at `least_score` or below go."""
    row = F.struct(F.col(score).cast("double").alias("score"), (-F.col(id_col)).alias("back"), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    items = boxes.where(F.col(score) > least_score).groupBy(*keys).agg(F.collect_list(row).alias("items"))

    def step(state, _):
        top = F.array_max(state["rest"])

        def fallen(x):
            lower = x["score"] * F.exp(-F.pow(G.iou(_at(x), _at(top)), F.lit(2.0)) / sigma)
            return F.struct(lower.alias("score"), *[x[c].alias(c) for c in ("back", "x0", "y0", "x1", "y1")])

        rest = F.filter(F.transform(F.filter(state["rest"], lambda x: x["back"] != top["back"]), fallen), lambda x: x["score"] > least_score)
        return F.when(top.isNull(), state).otherwise(F.struct(rest.alias("rest"), F.array_append(state["kept"], top).alias("kept")))

    start = F.struct(F.col("items").alias("rest"), F.slice("items", 1, 0).alias("kept"))
    kept = F.aggregate(F.sequence(F.lit(1), F.size("items")), start, step, lambda s: s["kept"])
    return items.select(*keys, F.explode(kept).alias("_k")).select(*keys, (-F.col("_k.back")).alias(id_col), F.round("_k.score", 6).alias("score"))


def greedy_matches(truth: DataFrame, found: DataFrame, keys: list[str], least: float = 0.5, truth_id: str = "box_id", found_id: str = "box_id") -> DataFrame:
    """(keys, truth, found): in order of ids, each pair with IoU above `least` whose boxes are both still free. Leave don't-care boxes out beforehand."""
    a, b = G.box("l"), G.box("r")
    near = pairs(truth, found, keys, condition=G.touches(a, b) & (F.round(G.iou(a, b), 6) > least)).select(*[F.col(f"l.{k}").alias(k) for k in keys], F.struct(F.col(f"l.{truth_id}").alias("truth"), F.col(f"r.{found_id}").alias("found")).alias("_p"))
    items = near.groupBy(*keys).agg(F.array_sort(F.collect_list("_p")).alias("items"))

    def step(taken, p):
        return F.when(F.exists(taken, lambda t: (t["truth"] == p["truth"]) | (t["found"] == p["found"])), taken).otherwise(F.array_append(taken, p))

    return items.select(*keys, F.inline(F.aggregate("items", F.slice("items", 1, 0), step)))


def aligned_texts(lines: DataFrame, words: DataFrame, keys: list[str], least: float = 0.5, id_col: str = "box_id", text: str = "text") -> DataFrame:
    """(keys, id, text): for each line box the texts of the words of which it holds `least`, from left to right by blanks; lines without one have the empty text."""
    a, b = G.box("l"), G.box("r")
    held = pairs(words, lines, keys, condition=G.touches(a, b)).where(F.round(G.share_of(b, a), 6) >= least)
    joined = held.groupBy(*[F.col(f"l.{k}").alias(k) for k in keys], F.col(f"r.{id_col}").alias(id_col)).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("l.x0"), F.col(f"l.{text}").alias("t")))), lambda x: x["t"]), " ").alias("text"))
    return lines.select(*keys, id_col).join(joined, [*keys, id_col], "left").withColumn("text", F.coalesce("text", F.lit("")))


def sorted_out(boxes: DataFrame, least: float, columns: tuple = (12, 13), category: str = "category", score: str = "score") -> tuple[DataFrame, DataFrame]:
    """(elements, columns): detections from a score on, in whole coordinates, those of column categories apart."""
    kept = boxes.where(F.col(score) >= least).withColumns({c: F.round(c).cast("long") for c in ("x0", "y0", "x1", "y1")})
    apart = F.coalesce(F.col(category).isin(*columns), F.lit(False))
    return kept.where(~apart), kept.where(apart)
