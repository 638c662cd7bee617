"""Shared pieces: lineage cuts in the shared folder, batch iteration, word hashing."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch; texts and sets may be long, so batches hold few rows.
ARROW_ROWS = 256
#: Text bytes that numpy code handles at once.
CHUNK_BYTES = 2_000_000
U64 = np.uint64
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_GOLD = U64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below the one that driver and executors share: spark.checkpoint.dir or, where that is unset (tests, single machines), the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/paperloom-{spark.sparkContext.applicationId}"


def clear_shared(spark: SparkSession) -> None:
    """Delete all lineage cuts of this application; tables that were read from them are lost."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def released() -> None:
    """Give a finished task's memory back: workers live on and would keep it beside the next stages."""
    for k in range(2):
        _powers[k] = _powers[k][:65_536].copy()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def chunks(sizes: list[int], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of at most 4000 rows whose sizes sum to about limit; a larger row is a range of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and (total + n > limit or i - start >= 4000):
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * _M1
    x = (x ^ (x >> U64(27))) * _M2
    return x ^ (x >> U64(31))


_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = mix(np.arange(1, 257, dtype=U64) * _GOLD)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, grown by doubling."""
    while len(_powers[0]) < n:
        size = len(_powers[0])
        for k, base in enumerate((_BASE, _INVERSE)):
            _powers[k] = np.concatenate([_powers[k], _powers[k] * U64(pow(base, size, 1 << 64))])
    return _powers[0][:n], _powers[1][:n]


def word_hashes(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, and the index of each word's text.

    Words are runs of bytes other than space and \\t to \\r; lower turns A-Z into a-z first.
    """
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if lower:
        buf = buf + (((buf >= 65) & (buf <= 90)).astype(np.uint8) << 5)
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=np.int8(1)))
    start, end = edge[::2], edge[1::2]
    up, down = _power_tables(len(buf) + 1)
    total = np.zeros(len(buf) + 1, U64)
    np.cumsum(_BYTES[buf] * up[:-1], out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(U64) * _GOLD)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return hashes, np.searchsorted(ends, start, side="right")


def shingle_hashes(words: np.ndarray, doc: np.ndarray, k: int, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of k words and of the whole sequence of texts with fewer words."""
    counts = np.bincount(doc, minlength=n_docs)
    if len(words) >= k:
        n = len(words) - k + 1
        h = np.full(n, k, U64)
        for j in range(k):
            h = mix(h * _GOLD + words[j : j + n])
        whole = doc[:n] == doc[k - 1 :]
        h, at = h[whole], doc[:n][whole]
    else:
        h, at = np.zeros(0, U64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = np.cumsum(counts) - counts
        extra = np.zeros(len(short), U64)
        for r, d in enumerate(short):
            x = np.full(1, counts[d], U64)
            for w in words[first[d] : first[d] + counts[d]]:
                x = mix(x * _GOLD + w)
            extra[r] = x[0]
        h, at = np.concatenate([h, extra]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        h, at = h[order], at[order]
    return h, at


def encoded(texts: list[str | None]) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


def checked_rows(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a table that must be small, with an error instead of an unbounded collect."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} {what}")
    return rows


def unit_hash(*columns: str) -> F.Column:
    """A double in [0, 1) from the columns' hash, the same in every run."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / F.lit(float(1 << 53))
