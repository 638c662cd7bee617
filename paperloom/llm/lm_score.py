"""Stupid-backoff scores of documents under an n-gram model of all other documents.

Words are runs of bytes other than space and \\t-\\r, A-Z lower-cased. For each word the longest
n-gram that ends in it and that occurs in another document gives c(n-gram) / c(its context), times
ALPHA for each order skipped; a single word gives c(word) / (words in other documents), a word
that no other document has counts as UNSEEN of a word. All counts are of the whole corpus less the
document's own occurrences. A document's score is the mean natural logarithm over its words.

The table n-gram -> count is partitioned by hash into buckets; documents' n-grams are exploded into
them, joined to their counts and sent back, where each document's terms are summed. `ngram_counts`
gives that table as rows. For scoring its rows and the exploded ones travel packed: one holds the
distinct n-grams that a chunk of documents has in a bucket, in ascending order of hash, as differences
with counts, in byte planes; that is the aggregation before the shuffle as well. N-grams that a bounded
sample of documents (SAMPLE) shows to be frequent are counted exactly over the corpus too, but as sums
within tasks, and broadcast: at most MAX_FREQUENT numbers. So no bucket gathers a frequent n-gram's rows.
The sample only decides the route; it changes no result. Within a bucket n-grams are told apart by 48
bits beside the bucket's own: two of 3 million share them with a probability of 0.02 in all.

Null and empty texts have no words and a null score. Rows that repeat an id are documents of their
own. Other columns are ignored, whatever their names; an empty table gives an empty result. docs must give the same rows in the same partitions when it is read
twice, as a table does; the operator fails rather than mix up chunks otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, chunks, column, encoded, mix, released, small_batches, unit_hash, word_hashes

ORDER = 3
ALPHA = 0.4
UNSEEN = 0.5
SAMPLE = 4000
SAMPLE_DOCS = 8
MAX_FREQUENT = 200_000
CHUNK = 4_000_000
#: Text bytes whose n-grams a bucket holds; one task holds a bucket of them in memory.
BUCKET_BYTES = 6_000_000
#: Bits that tell the n-grams of a bucket apart.
BITS = 48


def grams(words: np.ndarray, doc: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 1..order the hash of the k-gram that ends at each word; 0 where the document has no k words yet."""
    out, h = [], mix(words + U64(1))
    valid = np.ones(len(words), bool)
    out.append(h | U64(1))
    for k in range(2, order + 1):
        prev, valid_prev = h, valid
        h, valid = np.zeros(len(words), U64), np.zeros(len(words), bool)
        if len(words) > 1:
            valid[1:] = valid_prev[:-1] & (doc[1:] == doc[:-1])
            h[1:] = mix(prev[:-1] * U64(0x9E3779B97F4A7C15) + words[1:] + U64(k))
        out.append(np.where(valid, h | U64(1), U64(0)))
    return out


def _split(h: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket of each hash: equal ranges of hashes, told by the upper bits."""
    return ((h >> U64(32)) * U64(n_buckets) >> U64(32)).astype(np.int64)


def _within(h: np.ndarray, bucket: np.ndarray, n_buckets: int) -> np.ndarray:
    """Places of hashes in the ranges of their buckets, in BITS bits, in the order of the hashes."""
    first = ((bucket.astype(U64) << U64(32)) + U64(n_buckets - 1)) // U64(n_buckets)
    return (h - (first << U64(32))) >> U64(max(0, ((1 << 64) // n_buckets + (1 << 32)).bit_length() - BITS))


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as zstd-compressed byte planes, their number first."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    body = planes[: 8 - int((planes[::-1].any(axis=1)).argmax())] if planes.any() else planes[:1]
    return len(values).to_bytes(8, "little") + len(body).to_bytes(1, "little") + pa.Codec("zstd", 1).compress(body.tobytes(), asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n, planes = int.from_bytes(data[:8], "little"), data[8]
    out = np.zeros((n, 8), np.uint8)
    if n:
        body = pa.Codec("zstd").decompress(data[9:], decompressed_size=n * planes, asbytes=True)
        out[:, :planes] = np.frombuffer(body, np.uint8).reshape(planes, n).T
    return out.view("<u8").ravel()


class _Chunk:
    """Distinct n-grams of a chunk of texts, in ascending order, and where its words use them."""

    def __init__(self, texts: list[bytes], order: int, frequent: np.ndarray):
        words, self.doc = word_hashes(texts, lower=True)
        self.parts = grams(words, self.doc, order)
        flat = np.concatenate(self.parts) if len(words) else np.zeros(0, U64)
        used = np.flatnonzero(flat)
        self.keys, inverse, self.counts = np.unique(flat[used], return_inverse=True, return_counts=True)
        self.index = np.full(len(flat), -1)
        self.index[used] = inverse
        at = np.searchsorted(frequent, self.keys)
        self.frequent_at = np.where((at < len(frequent)) & (frequent[np.minimum(at, max(0, len(frequent) - 1))] == self.keys), at, -1) if len(frequent) else np.full(len(self.keys), -1)
        self.rare = np.flatnonzero(self.frequent_at < 0)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, list[bytes]]]:
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids, texts = batch.column(batch.schema.get_field_index("id")), encoded(column(batch, "text"))
        for a, b in chunks([len(t) for t in texts], CHUNK):
            own = ids.slice(a, b - a)
            yield f"{part}-{n}-{xxhash.xxh64_hexdigest(repr(own.to_pylist()))}", own, texts[a:b]
            n += 1


def _sampled(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = encoded(column(batch, "text"))
            for a, b in chunks([len(t) for t in texts], CHUNK):
                words, doc = word_hashes(texts[a:b], lower=True)
                h = np.concatenate([np.unique((doc.astype(U64) << U64(52)) | (g >> U64(12)))[:] for g in grams(words, doc, order)] or [np.zeros(0, U64)])
                keys, n = np.unique(h & U64((1 << 52) - 1), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], names=["h", "n"])
        released()

    return run


def _full_keys(order: int, shared):
    """Whole hashes of the n-grams whose upper 52 bits are among the frequent ones, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short = shared.value
        sums: dict[int, int] = {}
        for batch in batches:
            texts = encoded(column(batch, "text"))
            for a, b in chunks([len(t) for t in texts], CHUNK):
                words, doc = word_hashes(texts[a:b], lower=True)
                sums[0] = sums.get(0, 0) + len(words)
                if not len(short):
                    continue
                for g in grams(words, doc, order):
                    top = g >> U64(12)
                    at = np.minimum(np.searchsorted(short, top), len(short) - 1)
                    keys, n = np.unique(g[(short[at] == top) & (g != 0)], return_counts=True)
                    for k, v in zip(keys.tolist(), n.tolist()):
                        sums[k] = sums.get(k, 0) + v
        yield pa.RecordBatch.from_arrays([pa.array(np.array(list(sums), U64).view(np.int64)), pa.array(list(sums.values()), pa.int64())], names=["h", "n"])

    return run


def _exploded(order: int, n_buckets: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value[0]
        for name, _, texts in _pieces(batches):
            chunk = _Chunk(texts, order, frequent)
            keys, counts = chunk.keys[chunk.rare], chunk.counts[chunk.rare].astype(np.uint32)
            ends = np.searchsorted(_split(keys, n_buckets), np.arange(n_buckets + 1))
            rows = [k for k in range(n_buckets) if ends[k + 1] > ends[k]]
            low = _within(keys, _split(keys, n_buckets), n_buckets)
            steps = np.diff(low, prepend=U64(0))
            steps[ends[rows]] = low[ends[rows]]  # each row starts anew
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(rows, pa.int32()), pa.array([packed(steps[ends[k] : ends[k + 1]]) for k in rows], pa.binary()), pa.array([packed(counts[ends[k] : ends[k + 1]]) for k in rows], pa.binary())], names=["chunk", "bucket", "keys", "counts"])
        released()

    return run


def _joined(table: pa.Table) -> pa.Table:
    """One bucket: the counts of its n-grams over all chunks, and each chunk's n-grams joined to them."""
    steps = [unpacked(x) for x in table.column("keys").to_pylist()]
    sizes = np.array([len(x) for x in steps])
    keys = np.concatenate([np.cumsum(x, dtype=U64) for x in steps])
    del steps
    order = np.argsort(keys, kind="stable")
    new = np.diff(keys[order], prepend=keys[order[:1]] + U64(1)) != 0
    del keys
    counts = np.concatenate([unpacked(x) for x in table.column("counts").to_pylist()])
    sums = np.add.reduceat(counts[order], np.flatnonzero(new))
    total = np.empty(len(order), U64)
    total[order] = np.repeat(sums, np.diff(np.append(np.flatnonzero(new), len(order))))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    answers = [packed(total[a:b]) for a, b in zip(ends[:-1], ends[1:])]
    released()
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "ids": pa.nulls(len(answers), pa.list_(pa.int64())), "payload": pa.array(answers, pa.binary())})


def _text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd")
    for name, ids, texts in _pieces(batches):
        sizes = np.array([len(t) for t in texts], np.int64)
        body = b"".join(texts)
        payload = len(texts).to_bytes(8, "little") + len(body).to_bytes(8, "little") + sizes.tobytes() + codec.compress(body, asbytes=True)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([-1], pa.int32()), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([payload], pa.binary())], names=["chunk", "bucket", "ids", "payload"])


def _terms(chunk: _Chunk, total: np.ndarray, n_all: int, n_docs: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of each document and the sum of its words' logarithms."""
    m, doc = len(chunk.doc), chunk.doc
    n_words = np.bincount(doc, minlength=n_docs)
    if not m:
        return n_words, np.zeros(n_docs)
    others = []
    for k in range(order):
        index = chunk.index[k * m : (k + 1) * m]
        _, inverse, own = np.unique(doc * (len(total) + 1) + index + 1, return_inverse=True, return_counts=True)
        others.append(np.where(index >= 0, total[index] - own[inverse], 0))
    rest = np.maximum(n_all - n_words[doc], 1).astype(float)
    longest = np.zeros(m, np.int64)
    value = np.where(others[0] > 0, others[0], UNSEEN) / rest
    for k in range(1, order):
        before = np.concatenate([[1], others[k - 1][:-1]]).astype(float)
        found = others[k] > 0
        value = np.where(found, others[k] / np.maximum(before, 1), value)
        longest = np.where(found, k, longest)
    possible = np.zeros(m, np.int64)
    for k in range(1, order):
        possible += chunk.index[k * m : (k + 1) * m] >= 0
    logs = np.log(value) + (possible - longest) * np.log(ALPHA)
    return n_words, np.bincount(doc, weights=logs, minlength=n_docs)


def _scored(order: int, shared):
    def run(table: pa.Table) -> pa.Table:
        codec = pa.Codec("zstd")
        frequent, counts, n_all = shared.value
        rows = sorted(zip(table.column("bucket").to_pylist(), table.column("ids").to_pylist(), table.column("payload").to_pylist()), key=lambda r: r[0])
        (bucket, ids, payload), answers = rows[0], rows[1:]
        n, size = int.from_bytes(payload[:8], "little"), int.from_bytes(payload[8:16], "little")
        body = codec.decompress(payload[16 + 8 * n :], decompressed_size=size, asbytes=True) if size else b""
        ends = np.concatenate([[0], np.cumsum(np.frombuffer(payload[16 : 16 + 8 * n], np.int64))])
        chunk = _Chunk([body[a:b] for a, b in zip(ends[:-1], ends[1:])], order, frequent)
        told = np.concatenate([unpacked(p) for _, _, p in answers]).astype(np.int64) if answers else np.zeros(0, np.int64)
        if bucket != -1 or len(told) != len(chunk.rare):
            raise RuntimeError("the documents were dealt out differently when they were read again")
        total = np.where(chunk.frequent_at >= 0, counts[chunk.frequent_at] if len(counts) else 0, 0)
        total[chunk.rare] = told
        n_words, sums = _terms(chunk, total, n_all, n, order)
        del chunk, total, told, body
        released()
        return pa.table({"id": pa.array(ids, pa.int64()), "n_words": pa.array(n_words, pa.int64()), "log_sum": pa.array(np.where(n_words > 0, sums, 0.0)), "score": pa.array([s / w if w else None for s, w in zip(sums, n_words)], pa.float64())})

    return run


def _chunk_counts(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = encoded(column(batch, "text"))
            for a, b in chunks([len(t) for t in texts], CHUNK):
                for k, g in enumerate(grams(*word_hashes(texts[a:b], lower=True), order)):
                    h, n = np.unique(g[g != 0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k + 1), pa.int32()), pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["k", "h", "n"])
        released()

    return run


def ngram_counts(docs: DataFrame, order: int = ORDER, text_col: str = "text") -> DataFrame:
    """(k, h, n): occurrences of each k-gram, told by its hash, partitioned by hash."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(_chunk_counts(order), "k int, h long, n long")
    return rows.groupBy("k", "h").agg(F.sum("n").alias("n"))


def lm_scores(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, log_sum, score) of each document; see the module's notes."""
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n_docs, n_bytes = own.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    sample = own.where(unit_hash("id") < min(1.0, SAMPLE / max(1, n_docs)))
    seen = sample.mapInArrow(_sampled(order), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where((F.col("n") >= SAMPLE_DOCS) & (F.col("h") != 0))
    top = [r["h"] for r in seen.orderBy(F.desc("n"), "h").limit(MAX_FREQUENT).collect()]
    short = spark.sparkContext.broadcast(np.sort(np.array(top, np.int64).view(U64)))
    exact = own.mapInArrow(_full_keys(order, short), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).collect()  # at most MAX_FREQUENT and a few
    n_all = sum(r["n"] for r in exact if r["h"] == 0)
    keys = np.array([r["h"] for r in exact if r["h"] != 0], np.int64).view(U64)
    counts = np.array([r["n"] for r in exact if r["h"] != 0], np.int64)
    by = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[by], counts[by], n_all))
    n_buckets = max(4, -(-n_bytes // BUCKET_BYTES))
    exploded = own.mapInArrow(_exploded(order, n_buckets, shared), "chunk string, bucket int, keys binary, counts binary")
    answers = exploded.groupBy("bucket").applyInArrow(_joined, "chunk string, bucket int, ids array<long>, payload binary")
    texts = own.mapInArrow(_text_rows, "chunk string, bucket int, ids array<long>, payload binary")
    scored = texts.unionByName(answers).groupBy("chunk").applyInArrow(_scored(order, shared), "id long, n_words long, log_sum double, score double")
    return scored.withColumnRenamed("id", id_col)


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
