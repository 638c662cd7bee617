"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set holds the distinct 64-bit hashes of its k-word shingles (words are runs of bytes
other than space and \\t-\\r, A-Z lower-cased); with fewer than k words the whole sequence is one
shingle; null, empty and blank texts have the empty set and link with nothing. Two documents link
if 100 * intersection >= percent * union, both counted on these hashes: two of n shingles of a
document, or of a pair, share a hash with a probability of n**2 / 2**65 (1e-14 for 600).

Repeated texts are compared once. Each row stands for itself: rows that repeat an id with other
texts link by their own texts, rows that repeat an id with the same text give one row. Rows of null
id link with nothing, have a null component and are kept. Other columns are ignored, whatever their
names. An empty table gives an empty result.

1. Equal word sequences form a class; classes are numbered, and a class has its smallest id.
2. Each class is sketched: in round i < T every shingle falls into a hashed bin with value i plus
   a fraction, in round T + b all fall into bin b, so every coordinate is filled, and a coordinate
   keeps its smallest value. Two sets agree in a coordinate with the probability of their Jaccard
   similarity. BANDS bands of ROWS coordinates miss a pair at 0.8 with probability 1e-7.
3. Each member of a band's bucket is paired with the bucket's smallest number only, and the pairs
   are verified on the full sets. Buckets of any size give one pair a member.
4. Where a bucket still holds several components, its members go through an exact prefix-filter
   join, restricted to different components, so no link between buckets' members is lost although
   not all pairs are made. A prefix holds a set's first shingles in an order that is the same for
   all sets: by number of occurrences if among the most frequent ones, then by hash. The order
   decides only how many candidates there are, so the list of frequent shingles may be bounded.
5. Verified links are joined to components, whose smallest id is the component_id.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, chunks, column, cut, encoded, mix, released, shingle_hashes, small_batches, word_hashes
from .components import components

ROWS = 5
BANDS = 40
T = ROWS * BANDS
#: Occurrences from which a shingle may be ordered by their number, and the most shingles that are (others are ordered by hash).
FREQUENT = 16
MAX_FREQUENT = 300_000
_NONE = U64(0xFFFFFFFFFFFFFFFF)
_SEED = mix(np.arange(1, 2 * T + 1, dtype=U64) * U64(0xD6E8FEB86659FD93))


def sketch(h: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Sketches (n_docs x T) of the sets of hashes h, which belong to the documents doc."""
    out = np.full(n_docs * T, _NONE, U64)
    active = np.unique(doc)
    for i in range(2 * T):
        if i < T:
            x = mix(h ^ _SEED[i])
            at = doc * T + ((x >> U64(40)) * U64(T) >> U64(24)).astype(np.int64)
        else:
            x = mix(h ^ _SEED[i])
            at = doc * T + (i - T)
        np.minimum.at(out, at, (U64(i) << U64(40)) | (x & U64((1 << 40) - 1)))
        open_ = (out.reshape(n_docs, T)[active] == _NONE).any(axis=1)
        if not open_.any():
            break
        if not open_.all():
            still = np.zeros(n_docs, bool)
            still[active[open_]] = True
            keep = still[doc]
            h, doc, active = h[keep], doc[keep], active[open_]
    return out.reshape(n_docs, T)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    rows = sketches.reshape(len(sketches), BANDS, ROWS)
    key = np.broadcast_to(mix(np.arange(BANDS, dtype=U64) + U64(77)), rows.shape[:2])
    for r in range(ROWS):
        key = mix(key * U64(0x9E3779B97F4A7C15) + rows[:, :, r])
    return key.view(np.int64)


def _sets(texts: list[bytes], k: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Chunks of texts as (first, last, each one's distinct shingles in ascending order)."""
    for a, b in chunks([len(t) for t in texts]):
        words, doc = word_hashes(texts[a:b], lower=True)
        h, at = shingle_hashes(words, doc, k, b - a)
        out = []
        for own in np.split(h, np.searchsorted(at, np.arange(1, b - a))):
            own = np.sort(own)
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own)
        yield a, b, out


def _digest(text: bytes) -> bytes:
    return hashlib.blake2b(b" ".join(text.lower().split()), digest_size=16).digest()


SIG = "id long, same long, n_shingles long, digest binary, bands array<long>"


def _signatures(k: int):
    schema = pa.schema([("id", pa.int64()), ("same", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, same = (batch.column(batch.schema.get_field_index(c)) for c in ("id", "same"))
            texts = encoded(column(batch, "text"))
            for a, b, sets in _sets(texts, k):
                n = np.fromiter(map(len, sets), np.int64, b - a)
                keys = band_keys(sketch(np.concatenate(sets), np.repeat(np.arange(b - a), n), b - a))
                rows = pa.array([row if m else row[:0] for row, m in zip(keys, n)], pa.list_(pa.int64()))
                digests = pa.array([_digest(t) for t in texts[a:b]], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), same.slice(a, b - a), pa.array(n), digests, rows], schema=schema)
        released()

    return run


def _full_sets(k: int):
    """The sets of the rows whose text has the digest asked for."""
    schema = pa.schema([("v", pa.int64()), ("s", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, digests, v = encoded(column(batch, "text")), column(batch, "digest"), column(batch, "v")
            own = [i for i, t in enumerate(texts) if _digest(t) == digests[i]]
            for a, b, sets in _sets([texts[i] for i in own], k):
                yield pa.RecordBatch.from_arrays([pa.array([v[i] for i in own[a:b]], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], schema=schema)
        released()

    return run


def _verified(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for x, y, s, t in zip(*(column(batch, c) for c in ("a", "b", "sa", "sb"))):
                p, q = np.frombuffer(s, U64), np.frombuffer(t, U64)
                if not len(p) or not len(q):
                    continue
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both = int((q[at] == p).sum())
                if 100 * both >= percent * (len(p) + len(q) - both):
                    a.append(x), b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return run


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    with_sets = pairs.join(sets.select(F.col("v").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("v").alias("b"), F.col("s").alias("sb")), "b")
    return with_sets.select("a", "b", "sa", "sb").mapInArrow(_verified(percent), "a long, b long")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of shingles, summed over a batch's sets."""
    for batch in batches:
        h, n = np.unique(np.frombuffer(b"".join(column(batch, "s")), np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n, pa.int64())], names=["h", "n"])
    released()


def prefix(h: np.ndarray, share: float, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set, of which a set of at least `share` its size and similarity has one among its own first."""
    weight = np.zeros(len(h), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        weight = np.where(frequent[at] == h, counts[at], 0)
    return h[np.lexsort((h, weight))[: len(h) - math.ceil(share * len(h) - 1e-9) + 1]]


def _prefixes(percent: int, shared):
    """Sets as rows of their first shingles, with their size and the largest size of a partner that can still be similar if this shingle is the first common one."""
    share = percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = shared.value
        for batch in batches:
            sets = [np.frombuffer(s, U64) for s in column(batch, "s")]
            first = [prefix(h, share, frequent, counts) for h in sets]
            n, size = np.fromiter(map(len, first), np.int64, len(first)), np.fromiter(map(len, sets), np.int64, len(sets))
            rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            sizes = np.repeat(size, n)
            own = [np.repeat(batch.column(batch.schema.get_field_index(c)).to_numpy(), n) for c in ("v", "comp")]
            h = np.concatenate(first) if first else np.zeros(0, U64)
            reach = (sizes - rank) * (1 + share) / share - sizes
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(own[0], pa.int64()), pa.array(own[1], pa.int64()), pa.array(sizes), pa.array(reach)], names=["h", "v", "comp", "size", "reach"])
        released()

    return run


def frequent_shingles(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of most occurrences in ascending order and their numbers: all from a power of two up, MAX_FREQUENT at most."""
    counts = cut(sets.select("s").mapInArrow(_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT), "minhash-frequent")
    doubling = F.floor(F.log2("n")).cast("int")
    total = least = 0
    for r in counts.groupBy(doubling.alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("d")).collect():  # a row for each power of two
        if (total := total + r["n"]) > MAX_FREQUENT:
            break
        least = r["d"]
    rows = counts.where(doubling >= least).toPandas() if least else None
    if rows is None or not len(rows):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    h, n = rows["h"].to_numpy().view(U64), rows["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def residual_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may link, by an exact prefix-filter join.

    members: (v, comp). Two sets similar enough share a shingle among the first of each; the
    partner's size must fit the place of that shingle in both.
    """
    own = cut(members.join(sets, "v"), "minhash-members")
    shared = members.sparkSession.sparkContext.broadcast(frequent_shingles(own))
    rows = cut(own.mapInArrow(_prefixes(percent, shared), "h long, v long, comp long, size long, reach double"), "minhash-prefixes")
    x, y = rows.alias("x"), rows.alias("y")
    t = percent / 100
    fits = (F.col("x.h") == F.col("y.h")) & (F.col("x.comp") < F.col("y.comp")) & (F.col("x.size") <= F.col("y.reach") + 1e-6) & (F.col("y.size") <= F.col("x.reach") + 1e-6) & (F.col("x.size") >= t * F.col("y.size") - 1e-6) & (F.col("y.size") >= t * F.col("x.size") - 1e-6)
    return x.join(y, fits).select(F.col("x.v").alias("a"), F.col("y.v").alias("b")).distinct()


def _rows(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, same, n_shingles, component_id, kept), a row for each id and text; same is a hash of the text."""
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("same"), F.col(text_col).alias("text"))
    sig = cut(own.mapInArrow(_signatures(k), SIG), "minhash-signatures")
    classes = sig.where("n_shingles > 0 and id is not null").groupBy("digest").agg(F.min(F.struct("id", "bands")).alias("x")).select("digest", "x.id", "x.bands", F.monotonically_increasing_id().alias("v"))
    classes = cut(classes, "minhash-classes")
    buckets = classes.select("v", F.explode("bands").alias("key"))
    first = buckets.groupBy("key").agg(F.min("v").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    shared = cut(buckets.join(first, "key").select("v", "rep", "key"), "minhash-buckets")
    needed = classes.select("v", "id", "digest").join(shared.select("v").distinct(), "v", "left_semi")
    sets = own.select("id", "text").join(needed.hint("merge"), "id").select("v", "digest", "text").mapInArrow(_full_sets(k), "v long, s binary").groupBy("v").agg(F.first("s").alias("s"))
    sets = cut(sets, "minhash-sets")
    stars = shared.where("v <> rep").select(F.col("rep").alias("a"), F.col("v").alias("b")).distinct()
    links = cut(verify(stars, sets, percent), "minhash-links")
    comp = cut(components(links, "minhash-components"), "minhash-components")
    placed = shared.join(comp.withColumnRenamed("id", "v"), "v", "left").select("key", "v", F.coalesce("component", "v").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    members = placed.join(mixed, "key", "left_semi").select("v", "comp").distinct()
    more = cut(verify(cut(residual_pairs(members, sets, percent), "minhash-residual"), sets, percent), "minhash-links")
    if not more.isEmpty():
        comp = components(comp.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more), "minhash-components")
    comp = comp.withColumnRenamed("id", "v")
    # Written first: a join of two tables can be split where one component holds many classes.
    least = cut(classes.select("v", "id").join(comp, "v").groupBy("component").agg(F.min("id").alias("least")), "minhash-least")
    of_class = cut(classes.select("v", "id", "digest").join(comp.join(least, "component").select("v", "least"), "v", "left").select("digest", F.coalesce("least", "id").alias("component_id")), "minhash-classes")
    rows = sig.select("id", "same", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("digest")).alias("digest")).dropDuplicates(["id", "same"])
    out = rows.where("digest is not null").join(of_class, "digest").select("id", "same", "n_shingles", "component_id")
    out = out.unionByName(rows.where("digest is null").select("id", "same", "n_shingles", F.col("id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of each document; see the module's notes."""
    return _rows(docs, k, percent, id_col, text_col).select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stand for their near-duplicate component, one for each id and text.

    Of rows that repeat an id and text the first by the other columns stays. Of rows that repeat an
    id with other texts each one is judged by its own text; those that share a component with
    a smaller id go. Rows of null id come through unchanged.
    """
    kept = _rows(docs.where("doc_id is not null"), k, percent, "doc_id", "text").where("kept").select(F.col("id").alias("_kept_id"), F.col("same").alias("_kept_same"))
    names = [c for c in docs.columns if c not in ("doc_id", "text")]
    own = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_same"), F.struct("text", *[F.col(f"`{c}`") for c in names], "doc_id").alias("_row"))
    rows = own.join(kept.hint("merge"), (own["_id"] == kept["_kept_id"]) & (own["_same"] == kept["_kept_same"]), "left_semi")
    one = rows.groupBy("_id", "_same").agg(F.min("_row").alias("_row")).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
    return one.unionByName(docs.where("doc_id is null"))


def op2_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2, percent=80)
