"""Metrics of recognition, detection, order and structure."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions.text import similarity


def text_accuracy(pairs: DataFrame, keys: list[str], pred: str = "pred", target: str = "target", alike=similarity) -> DataFrame:
    """Share of exact matches and mean 1 - normalised edit distance, spaces left out. Long texts need whole_similarity."""
    p, t = F.replace(F.coalesce(pred, F.lit("")), F.lit(" "), F.lit("")), F.replace(F.coalesce(target, F.lit("")), F.lit(" "), F.lit(""))
    return pairs.groupBy(*keys).agg(F.round(F.avg((p == t).cast("double")), 6).alias("accuracy"), F.round(F.avg(alike(p, t)), 6).alias("similarity"), F.count(F.lit(1)).alias("n"))


def detection(truth: DataFrame, found: DataFrame, keys: list[str], least: float) -> DataFrame:
    """Precision, recall and their harmonic mean per label, where a box counts if it overlaps one of the other side."""
    def hits(a: DataFrame, b: DataFrame) -> DataFrame:
        hit = a.alias("l").join(b.alias("r"), [F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*keys, "label"]] + [F.round(G.iou(G.box("l"), G.box("r")), 6) >= least], "left_semi")
        return hit.groupBy("label").agg(F.count(F.lit(1)).alias("hits"))

    def side(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        total = a.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        return total.join(hits(a, b), "label", "left").select("label", (F.coalesce("hits", F.lit(0)) / F.col("n")).alias(name))

    both = side(found, truth, "precision").join(side(truth, found, "recall"), "label", "full")
    p, r = F.coalesce("precision", F.lit(0.0)), F.coalesce("recall", F.lit(0.0))
    return both.select("label", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("hmean"))


#: Ranges of scores that a label's detections are dealt to (2^7, for seven halvings), from so many of them on.
SCORE_RANGES, RANGED_ROWS = 128, 100_000


def average_precision(ranked: DataFrame, totals: DataFrame, label: str = "label") -> DataFrame:
    """AP from rows (label, score, id, hit) and (label, n): area under the falling envelope of precision.

    A large label's rows are dealt to ranges of scores between its quantiles; sums before and maxima behind
    a range come from a table of ranges, so no task holds a whole label. Equal scores share a range.
    Rows run from the lowest score up, so that the envelope is a running maximum in the order of the sums.
    """
    shares = [k / SCORE_RANGES for k in range(1, SCORE_RANGES)]
    cuts = ranked.groupBy(label).agg(F.percentile_approx("score", shares, 10_000).alias("_cuts"), F.count(F.lit(1)).alias("_n"))
    cuts = cuts.where(F.col("_n") >= RANGED_ROWS).drop("_n")  # at most a row for each RANGED_ROWS, so small enough to broadcast
    halves = F.array(*[F.lit(SCORE_RANGES >> k) for k in range(1, SCORE_RANGES.bit_length())])
    up_to = F.aggregate(halves, F.lit(0), lambda at, s: at + F.when(F.get("_cuts", at + s - 1) <= F.col("score"), s).otherwise(0))
    rows = ranked.join(F.broadcast(cuts), label, "left").withColumn("_range", F.lit(SCORE_RANGES - 1) - up_to)
    rows = rows.select(label, F.coalesce("_range", F.lit(0)).alias("_range"), "score", "id", F.coalesce(F.col("hit").cast("int"), F.lit(0)).alias("hit"))
    rows = rows.repartition(label, "_range")  # one shuffle for all that follows
    through = Window.partitionBy(label).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy(label, "_range").agg(F.sum("hit").alias("_tp"), F.count(F.lit(1)).alias("_k"))
    sums = sums.select(label, "_range", *[F.sum(c).over(through).alias(c) for c in ("_tp", "_k")])
    upward = Window.partitionBy(label, "_range").orderBy(F.asc_nulls_first("score"), F.desc("id"))
    so_far = upward.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_lower", F.sum("hit").over(so_far) - F.col("hit")).withColumn("_place", F.row_number().over(upward))
    rows = rows.join(sums, [label, "_range"]).withColumn("precision", (F.col("_tp") - F.col("_lower")) / (F.col("_k") - F.col("_place") + 1))
    rows = rows.withColumn("_own", F.max("precision").over(so_far))
    behind = Window.partitionBy(label).orderBy("_range").rowsBetween(1, Window.unboundedFollowing)
    tops = rows.groupBy(label, "_range").agg(F.max("precision").alias("_top")).select(label, "_range", F.max("_top").over(behind).alias("_behind"))
    envelope = F.greatest("_own", "_behind")
    parts = rows.join(tops, [label, "_range"]).groupBy(label, "_range").agg(F.sum(F.when(F.col("hit") == 1, envelope).otherwise(0.0)).alias("_part"))
    return parts.groupBy(label).agg(F.sum("_part").alias("_part")).join(totals, label).select(label, F.round(F.col("_part") / F.col("n"), 6).alias("ap"))


def confusion(pairs: DataFrame, truth: str, pred: str) -> DataFrame:
    return pairs.groupBy(truth, pred).agg(F.count(F.lit(1)).alias("n"))


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """(label, weight): inverse frequencies that sum to 1. Labels are few, so their total is one window."""
    inverse = rows.groupBy(label).agg((1 / F.count(F.lit(1))).alias("weight"))
    return inverse.select(label, (F.col("weight") / F.sum("weight").over(Window.partitionBy(F.lit(0)))).alias("weight"))


def image_weights(rows: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Sum of the class weights of each image's boxes."""
    return rows.join(class_weights(rows, label), label).groupBy(*keys).agg(F.round(F.sum("weight"), 6).alias("weight"))


# Layout label families as (truth labels, predicted labels).
LABEL_FAMILIES = {
    "Image": (["Figure"], ["Picture", "Figure"]),
    "Table": (["Table"], ["Table"]),
    "Text": (["Text", "List"], ["Text", "Formula", "Footnote", "Caption", "List-item"]),
    "Title": (["Title"], ["Section-header", "Title"]),
}


def label_family(label: Column, predicted: bool, families: dict[str, tuple[list[str], list[str]]] = LABEL_FAMILIES) -> Column:
    """Family of a truth or predicted label; null for labels of none."""
    out = F.lit(None).cast("string")
    for name, members in families.items():
        out = F.when(label.isin(members[int(predicted)]), name).otherwise(out)
    return out


def counted_accuracy(pairs: DataFrame, keys: list[str], pred: str = "pred", target: str = "target", eps: float = 1e-5) -> DataFrame:
    """Exact matches over pairs plus eps."""
    equal = F.coalesce(F.col(pred) == F.col(target), F.lit(False))
    return pairs.groupBy(*keys).agg(F.round(F.sum(equal.cast("double")) / (F.count(F.lit(1)) + eps), 6).alias("accuracy"))


def coverage(boxes: DataFrame, covers: DataFrame, keys: list[str], id_col: str = "box_id") -> DataFrame:
    """Share of each box that covers hold, overlaps counted twice, 1 at most."""
    joined = boxes.alias("l").join(covers.alias("r"), [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys] + [G.touches(G.box("l"), G.box("r"))])
    total = joined.groupBy(*[F.col(f"l.{k}").alias(k) for k in keys], F.col(f"l.{id_col}").alias(id_col)).agg(F.sum(G.overlap_area(G.box("l"), G.box("r"))).alias("_held"))
    b = G.box()
    out = boxes.join(total, [*keys, id_col], "left")
    return out.select(*keys, id_col, F.round(F.least(F.lit(1.0), F.coalesce(F.try_divide(F.coalesce("_held", F.lit(0.0)), G.area(b)), F.lit(0.0))), 6).alias("coverage"))


def order_agreement(rows: DataFrame, keys: list[str], pred: str, true: str, id_col: str) -> DataFrame:
    """Share of ordered pairs of a group that both rankings order alike (compared as numbers)."""
    a, b = rows.alias("l"), rows.alias("r")
    joined = a.join(b, [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys] + [F.col(f"l.{id_col}") < F.col(f"r.{id_col}")])
    alike = (F.col(f"l.{pred}") < F.col(f"r.{pred}")) == (F.col(f"l.{true}") < F.col(f"r.{true}"))
    return joined.groupBy(*[F.col(f"l.{k}").alias(k) for k in keys]).agg(F.round(F.avg(alike.cast("double")), 6).alias("agreement"))


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Cheapest one-to-one assignment of rows to columns by shortest augmenting paths."""
    n, m = cost.shape
    if n > m:
        return sorted((r, c) for c, r in assignment(cost.T))
    row_price, col_price, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for start in range(n):
        dist, back, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, last, base = start, -1, 0.0
        while True:
            reach = base + cost[row] - row_price[row] - col_price
            better = ~done & (reach < dist)
            dist[better], back[better] = reach[better], last
            col = int(np.where(done, np.inf, dist).argmin())
            base, last = dist[col], col
            if owner[col] < 0:
                break
            done[col], row = True, owner[col]
        row_price[start] += base
        for c in np.flatnonzero(done):
            row_price[owner[c]] += base - dist[c]
            col_price[c] -= base - dist[c]
        while last >= 0:
            owner[last] = start if back[last] < 0 else owner[back[last]]
            last = back[last]
    return sorted((int(r), c) for c, r in enumerate(owner) if r >= 0)


def matched_texts(left: DataFrame, right: DataFrame, keys: list[str], least: float = 0.65) -> DataFrame:
    """Best one-to-one match of two groups of texts (id, text) by edit similarity; weaker pairs are dropped."""

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(a) and len(b):
            a, b = a.sort_values("id"), b.sort_values("id")
            sims = np.array([[_similar(x, y) for y in b["text"]] for x in a["text"]])
            rows = [(*key, a["id"].iloc[i], b["id"].iloc[j], round(float(sims[i, j]), 6)) for i, j in assignment(1 - sims) if sims[i, j] >= least]
        return pd.DataFrame(rows, columns=[*keys, "left_id", "right_id", "similarity"])

    types = dict(left.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + f", left_id {types['id']}, right_id {dict(right.dtypes)['id']}, similarity double"
    return left.select(*keys, "id", "text").groupBy(*keys).cogroup(right.select(*keys, "id", "text").groupBy(*keys)).applyInPandas(run, schema)


def _similar(a: str, b: str) -> float:
    a, b = a or "", b or ""
    if not a and not b:
        return 1.0
    row = np.arange(len(b) + 1)
    codes = np.array([ord(c) for c in b])
    for i, c in enumerate(a, 1):
        step = np.minimum(row[1:] + 1, row[:-1] + (codes != ord(c)))
        new = np.concatenate([[i], step])
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return 1 - row[-1] / max(len(a), len(b))


def tree_distance(a: tuple, b: tuple, rename) -> float:
    """Edit distance of ordered trees (label, children), insertions and deletions costing 1."""

    def flat(tree):
        labels, lows, roots = [], [], []

        def walk(node) -> int:
            low = None
            for child in node[1]:
                at = walk(child)
                low = at if low is None else low
            labels.append(node[0])
            lows.append(len(labels) - 1 if low is None else low)
            return lows[-1]

        walk(tree)
        last = {low: i for i, low in enumerate(lows)}
        roots = sorted(last.values())
        return labels, lows, roots

    la, lowa, ra = flat(a)
    lb, lowb, rb = flat(b)
    dist = [[0.0] * len(lb) for _ in la]
    for i in ra:
        for j in rb:
            oi, oj = lowa[i], lowb[j]
            f = [[float(q) for q in range(j - oj + 2)]]
            for x in range(oi, i + 1):
                above, row = f[-1], [float(x - oi + 1)]
                prior, first, own = f[lowa[x] - oi], lowa[x] == oi, dist[x]
                for y in range(oj, j + 1):
                    q = y - oj + 1
                    least = min(above[q], row[-1]) + 1
                    if first and lowb[y] == oj:
                        own[y] = least = min(least, above[q - 1] + rename(la[x], lb[y]))
                    else:
                        least = min(least, prior[lowb[y] - oj] + own[y])
                    row.append(least)
                f.append(row)
    return float(dist[-1][-1])


# Weights of precision, recall, mAP at 0.5 and mean mAP in a detector's fitness.
FITNESS = (0.0, 0.0, 0.1, 0.9)


def fitness(*values: Column, weights: tuple[float, ...] = FITNESS) -> Column:
    """Weighted sum of a model's figures."""
    return sum((v * w for v, w in zip(values[1:], weights[1:])), values[0] * weights[0])


def confidence(rows: DataFrame, keys: list[str], value: str, kept: Column) -> DataFrame:
    """(keys, mean, geometric): mean confidence of the kept characters, 0 without one, and the geometric mean of all."""
    mean = F.coalesce(F.avg(F.when(kept, F.col(value))), F.lit(0.0))
    return rows.groupBy(*keys).agg(mean.alias("mean"), F.exp(F.avg(F.log(F.col(value) + 1e-8))).alias("geometric"))


def running(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows with total, n and mean of the values so far."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("total", F.sum(value).over(w)).withColumn("n", F.count(value).over(w))
    return out.withColumn("mean", F.try_divide("total", "n"))


def smoothed(rows: DataFrame, keys: list[str], order: list[str], value: str, size: int) -> DataFrame:
    """Rows with the lower median and the mean of the last `size` values."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - size, 0)
    last = F.array_sort(F.collect_list(value).over(w))  # size values at most
    return rows.withColumn("_last", last).withColumn("median", F.get("_last", F.floor((F.size("_last") - 1) / 2).cast("int"))).withColumn("mean", F.avg(value).over(w)).drop("_last")


def by_model(rows: DataFrame, model: str, figures: dict[str, Column]) -> DataFrame:
    """(model, figures): a map of named figures for each of several models that were scored side by side."""
    entries = [x for name, figure in figures.items() for x in (F.lit(name), figure)]
    return rows.groupBy(model).agg(F.create_map(*entries).alias("figures"))


def class_hits(pred: DataFrame, truth: DataFrame, keys: list[str], least: float = 0.7, label: str = "label", id_col: str = "box_id") -> DataFrame:
    """(label, n_pred, n_truth, precision, recall, f): boxes whose best IoU with one of their own label and image reaches `least`."""
    alike = [*keys, label]

    def hits(a: DataFrame, b: DataFrame) -> DataFrame:
        x, y = G.box("l"), G.box("r")
        on = G.touches(x, y)
        for k in alike:
            on = on & (F.col(f"l.{k}") == F.col(f"r.{k}"))
        best = a.alias("l").join(b.alias("r"), on).groupBy(*[F.col(f"l.{k}").alias(k) for k in alike], F.col(f"l.{id_col}").alias(id_col)).agg(F.max(F.round(G.iou(x, y), 6)).alias("_best"))
        return a.select(*alike, id_col).join(best, [*alike, id_col], "left").groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg((F.col("_best") >= least).cast("double")), F.lit(0.0)).alias("_share"), F.count_if(F.col("_best") >= least).alias("_hits"))

    p, t = (hits(a, b).select(label, F.col("n").alias(f"n_{s}"), F.try_divide("_hits", "n").alias(s)) for a, b, s in ((pred, truth, "precision"), (truth, pred, "recall")))
    both = p.join(t, label, "full").fillna(0)
    f = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return both.select(label, F.col("n_precision").alias("n_pred"), F.col("n_recall").alias("n_truth"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f, 6).alias("f"))


def best_reference(lines: DataFrame, references: DataFrame, keys: list[str], line: str = "line", text: str = "text") -> DataFrame:
    """(keys, line, similarity): the largest edit similarity of each line with a reference of its key; 0 without one. Keys bound the pairs to a page."""
    a, b = lines.select(*keys, line, F.col(text).alias("_a")), references.select(*keys, F.col(text).alias("_b"))
    return a.join(b, keys, "left").groupBy(*keys, line).agg(F.round(F.coalesce(F.max(F.when(F.col("_b").isNotNull(), similarity(F.col("_a"), F.col("_b")))), F.lit(0.0)), 6).alias("similarity"))


def with_truth(predictions: DataFrame, truth: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, truth, pred) of every truth; the empty text where nothing was predicted."""
    return truth.select(key, F.col(text).alias("truth")).join(predictions.select(key, F.col(text).alias("pred")), key, "left").withColumn("pred", F.coalesce("pred", F.lit("")))
