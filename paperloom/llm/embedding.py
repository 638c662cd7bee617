"""Near-duplicate embeddings by a forest of random-projection trees.

Vectors are compared by cosine in double precision, and only with vectors of the same label; labels
may be of any type that casts to a string. A null label or a vector that is null, empty, zero or holds
null or non-finite components links with nothing (vectors of another length neither), nor does a row
of null id, whose component is null and which is kept. Vectors with equal components and label are
one class with one place in the trees; classes are numbered, so rows that repeat an id with other
vectors each link by their own.

A tree splits the unit vectors of a label recursively: a random direction, the median of the
projections as threshold, and all vectors within SPILL of it on both sides, until about LEAF vectors
are left or three directions in a row fail to split. Trees are fitted on at most SAMPLE vectors of
a node and applied to all of them; nodes that stay too large are fitted again from a sample of their
own. Vectors are compared within the leaves of TREES trees, leaves in blocks of LEAF vectors, so that
no task holds an unbounded leaf; every pair is verified. A pair at the threshold is separated by a
tree with a probability of a few per cent for each level, by all trees hardly ever.

A pair may meet in several leaves. It is counted in the one of least number that both vectors lie in,
as each vector carries the numbers of its leaves, so blocks put out counts and roots of components
instead of pairs. Links are joined to components. Rows that repeat an id each get a row. Other columns
are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, unit_hash
from .components import components

THRESHOLD = 0.93
TREES = 6
LEAF = 256
SAMPLE = 8192
SPILL = 0.03
ROUNDS = 8
SEED = 5
#: Rows of a node that one task places in a fitted tree.
BLOCK = 50_000


def direction(label: str, tree: int, path: str, attempt: int, size: int) -> np.ndarray:
    seed = [SEED, tree, attempt, *path.encode(), 256, *label.encode("utf-8", "surrogatepass")]
    x = np.random.default_rng(seed).standard_normal(size)
    return x / np.linalg.norm(x)


def fit(x: np.ndarray, label: str, tree: int, root: str, leaf: int) -> dict[str, tuple[int, float]]:
    """Splits (attempt, threshold) by path, from unit vectors x at the node root."""
    splits: dict[str, tuple[int, float]] = {}
    open_ = [(root, x)]
    while open_:
        path, own = open_.pop()
        if len(own) <= leaf or len(path) > 60:
            continue
        for attempt in range(3):
            p = own @ direction(label, tree, path, attempt, own.shape[1])
            at = float(np.median(p))
            low, high = own[p <= at + SPILL], own[p >= at - SPILL]
            if max(len(low), len(high)) <= 0.8 * len(own):
                splits[path] = (attempt, at)
                open_ += [(path + "0", low), (path + "1", high)]
                break
    return splits


def place(x: np.ndarray, label: str, tree: int, root: str, splits: dict[str, tuple[int, float]]) -> Iterator[tuple[str, np.ndarray]]:
    """Leaves below root and the rows of x that fall into each."""
    open_ = [(root, np.arange(len(x)))]
    while open_:
        path, rows = open_.pop()
        if path not in splits:
            yield path, rows
            continue
        attempt, at = splits[path]
        p = x[rows] @ direction(label, tree, path, attempt, x.shape[1])
        open_ += [(path + "0", rows[p <= at + SPILL]), (path + "1", rows[p >= at - SPILL])]


def _unit(vectors) -> np.ndarray:
    x = np.stack([np.frombuffer(v, np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of doubles; null where they can't be compared."""
    for batch in batches:
        out = []
        for v in batch.column(batch.schema.get_field_index("v")).to_pylist():
            x = np.array([np.nan if c is None else c for c in v], float) if v else np.zeros(0)
            norm = np.linalg.norm(x) if len(x) and np.isfinite(x).all() else 0.0
            out.append((x + 0.0).tobytes() if norm > 0 and np.isfinite(norm) else None)
        names = [n for n in batch.schema.names if n != "v"]
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names] + [pa.array(out, pa.binary())], names=[*names, "v"])


NODE = ["label", "size", "tree", "path"]


def _fit_nodes(pdf: pd.DataFrame) -> pd.DataFrame:
    label, size, tree, path = (pdf[c].iloc[0] for c in NODE)
    splits = fit(_unit(pdf["v"]), label, int(tree), path, max(16, int(LEAF * pdf["share"].iloc[0])))
    rows = [(label, size, tree, path, p, a, t) for p, (a, t) in splits.items()]
    return pd.DataFrame(rows, columns=[*NODE, "at", "attempt", "threshold"])


def _place_nodes(key: tuple, rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    label, _, tree, path, _ = key
    if not len(rows):
        return pd.DataFrame({"id": [], "path": []})
    splits = {r.at: (r.attempt, r.threshold) for r in model.itertuples(index=False)}
    ids = rows["id"].to_numpy()
    found = [pd.DataFrame({"id": ids[own], "path": leaf}) for leaf, own in place(_unit(rows["v"]), label, int(tree), path, splits)]
    out = pd.concat(found)
    out["label"], out["size"], out["tree"] = label, key[1], tree
    return out


def leaves(vectors: DataFrame) -> DataFrame:
    """(label, size, tree, path, id): leaves of all trees, from classes (id, label, size, v)."""
    spark = vectors.sparkSession
    placed = vectors.select("id", "label", "size", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), F.lit("").alias("path"))
    done = None
    for _ in range(ROUNDS):
        counts = placed.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n"))
        large = cut(counts.where(F.col("n") > LEAF), "forest-nodes")
        if large.isEmpty():
            break
        small = placed.join(large.select(*NODE), NODE, "left_anti")
        rows = placed.join(large, NODE).join(vectors.select("id", "v"), "id")
        share = F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.col("n"))
        sampled = rows.withColumn("share", share).where(unit_hash("id", "tree") < F.col("share")).select(*NODE, "share", "v")
        models = cut(sampled.groupBy(*NODE).applyInPandas(_fit_nodes, "label string, size int, tree int, path string, at string, attempt int, threshold double"), "forest-models")
        split = models.select(*NODE).distinct()
        stuck = placed.join(large.select(*NODE), NODE, "left_semi").join(split, NODE, "left_anti")
        ready = small.unionByName(stuck)
        blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
        to_place = rows.join(split, NODE, "left_semi").withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).select(*NODE, "block", "id", "v")
        copies = models.join(large, NODE).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).select(*NODE, "block", "at", "attempt", "threshold")
        key = [*NODE, "block"]
        moved = to_place.groupBy(*key).cogroup(copies.groupBy(*key)).applyInPandas(_place_nodes, "id long, path string, label string, size int, tree int")
        ready = cut(ready.select("label", "size", "tree", "path", "id"), "forest-leaves")
        done = ready if done is None else done.unionByName(ready)
        placed = cut(moved.select("id", "label", "size", "tree", "path"), "forest-placed")
    rest = placed.select("label", "size", "tree", "path", "id")
    return rest if done is None else done.unionByName(rest)


EMPTY = {"id": [], "root": [], "near": []}


def _compare(threshold: float):
    """Per linked vector of a block: a linked vector or itself as root, and the rows of linked vectors whose pair counts here."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, x, copies = pdf["id"].to_numpy(), _unit(pdf["v"]), pdf["copies"].to_numpy()
        links = x @ x.T >= threshold
        np.fill_diagonal(links, False)
        if pdf["i"].iloc[0] != pdf["j"].iloc[0]:
            side = pdf["side"].to_numpy()
            links &= side[:, None] != side[None, :]
        own = np.flatnonzero(links.any(axis=1))
        if not len(own):
            return pd.DataFrame(EMPTY)
        links = links[np.ix_(own, own)]
        root = np.arange(len(own))
        while True:
            least = np.minimum(root, np.where(links, root[None, :], len(own)).min(axis=1))
            least = least[least]
            if (least == root).all():
                break
            root = least
        before = [[n for n in pdf["leaves"].iloc[k] if n < pdf["leaf"].iloc[0]] for k in own]
        numbers, n = np.unique(np.concatenate([np.array(b, np.int64) for b in before]), return_counts=True)
        numbers = numbers[n > 1]
        inside = np.zeros((len(own), len(numbers)), np.float32)
        for k, b in enumerate(before):
            inside[k] = np.isin(numbers, b)
        counted = links & (inside @ inside.T == 0)
        return pd.DataFrame({"id": ids[own], "root": ids[own][root], "near": counted @ copies[own]})

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) of each row; see the module's notes."""
    small_batches(vectors.sparkSession)
    slim = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    slim = cut(slim.mapInArrow(_packed, "id long, label string, v binary"), "forest-vectors")
    fits = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    classes = slim.where(fits).groupBy("label", "v").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("id"), "label", "v", "least", "copies", F.octet_length("v").cast("int").alias("size")), "forest-classes")
    found = cut(leaves(classes.select("id", "label", "size", "v")).withColumn("leaf", F.xxhash64(*NODE)), "forest-found")
    sizes = found.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(LEAF)).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    of_vector = found.groupBy("id").agg(F.collect_list("leaf").alias("leaves"))  # as many as the trees and their spill make
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(block, k).alias("i"), F.greatest(block, k).alias("j"), (block > k).cast("int").alias("side")))
    dealt = found.join(sizes, "leaf").select("leaf", "id", F.inline(pairs)).join(classes.select("id", "v", "copies").join(of_vector, "id"), "id")
    near = cut(dealt.groupBy("leaf", "i", "j").applyInPandas(_compare(threshold), "id long, root long, near long"), "forest-links")
    comp = components(near.select(F.col("id").alias("a"), F.col("root").alias("b")), "forest-components")
    comp = cut(comp, "forest-components")
    least = cut(classes.select("id", "least").join(comp, "id").groupBy("component").agg(F.min("least").alias("component_id")), "forest-least")
    counted = near.groupBy("id").agg(F.sum("near").alias("others"))
    linked = comp.join(least, "component").select("id", "component_id").join(counted, "id", "left")
    by_class = classes.join(linked, "id", "left").select("label", "v", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    out = slim.where(fits).join(by_class, ["label", "v"], "left").select("id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    out = out.unionByName(slim.where(~fits).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op3_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
