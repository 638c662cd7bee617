"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, every run of characters other than letters becomes one space, and all 1- to
3-grams of code points are hashed to 2**BITS features. The model is fitted on a bounded sample of
the labelled rows (about MAX_TRAIN of each label, chosen by a hash of the id); its log-probability
matrix has at most MAX_LABELS columns and is broadcast. Whole texts are scored: numpy looks up the
features' rows and sums them per document. The score is the winner's share among the languages'
geometric mean probabilities, raised to the power SHARPNESS, so it does not depend on length.

Null texts and texts without a letter are 'und' with score 0. Without labelled rows every text is
'und'. Rows whose label is null are not learned from. Ties go to the first label by code point. Rows
that repeat an id each get a row, a null id is never held out; other columns are ignored, whatever
their names. An empty table gives an empty result. More than MAX_LABELS labels are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, checked_rows, chunks, column, mix, small_batches, unit_hash

BITS = 16
ORDERS = (1, 2, 3)
MAX_TRAIN = 4000
MAX_LABELS = 500
SMOOTHING = 0.5
SHARPNESS = 20.0

_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all texts and the index of each one's text."""
    clean = [" " + _OTHER.sub(" ", t.lower()).strip() + " " for t in texts]
    points = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    doc = np.repeat(np.arange(len(clean)), [len(t) for t in clean])
    found, at = [], []
    for k in ORDERS:
        n = len(points) - k + 1
        if n <= 0:
            continue
        h = np.full(n, k, U64)
        for j in range(k):
            h = h * U64(0x9E3779B97F4A7C15) + points[j : j + n]
        whole = doc[:n] == doc[k - 1 :]
        found.append((mix(h) >> U64(64 - BITS)).astype(np.int32)[whole])
        at.append(doc[:n][whole])
    return np.concatenate(found), np.concatenate(at)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, labels = column(batch, "text"), column(batch, "label")
        for a, b in chunks([len(t) for t in texts], 500_000):
            f, at = features(texts[a:b])
            names, which = np.unique(np.array(labels[a:b], object), return_inverse=True)
            for i, name in enumerate(names):
                sums.setdefault(name, np.zeros(1 << BITS, np.int64))
                sums[name] += np.bincount(f[which[at] == i], minlength=1 << BITS)
    rows = [(name, np.flatnonzero(v), v) for name, v in sums.items()]
    for name, where, v in rows:
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(where), pa.string()), pa.array(where, pa.int64()), pa.array(v[where], pa.int64())], names=["label", "feature", "n"])


def fit(docs: DataFrame, max_train: int = MAX_TRAIN) -> tuple[list[str], np.ndarray]:
    """Labels and log-probabilities (features x labels) from rows (id, text, label)."""
    small_batches(docs.sparkSession)
    usable = docs.where(F.col("text").isNotNull() & F.col("label").isNotNull())
    sizes = {r["label"]: r["n"] for r in checked_rows(usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")), MAX_LABELS, "languages")}
    if not sizes:
        return [], np.zeros((1 << BITS, 0), np.float32)
    share = F.lit(0.0)
    for label, n in sizes.items():
        share = F.when(F.col("label") == label, min(1.0, max_train / n)).otherwise(share)
    counts = usable.where(unit_hash("id") < share).select("label", "text").mapInArrow(_count, "label string, feature long, n long").groupBy("label", "feature").agg(F.sum("n").alias("n"))
    packed = counts.groupBy("label").agg(F.collect_list(F.struct("feature", "n")).alias("x"))  # at most 2**BITS entries each
    labels = sorted(sizes)
    table = np.full((1 << BITS, len(labels)), SMOOTHING)
    for r in packed.toLocalIterator():
        x = np.array([(y["feature"], y["n"]) for y in r["x"]], np.int64)
        table[x[:, 0], labels.index(r["label"])] += x[:, 1]
    return labels, np.log(table / table.sum(axis=0)).astype(np.float32)


def _predict(shared):
    schema = pa.schema([("id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, table = shared.value
        for batch in batches:
            ids, texts = column(batch, "id"), column(batch, "text")
            texts = [t if t and _LETTER.search(t) else "" for t in texts]
            for a, b in chunks([len(t) for t in texts], 500_000):
                own = [i for i in range(a, b) if texts[i]]
                names, scores = ["und"] * (b - a), [0.0] * (b - a)
                if own and labels:
                    f, at = features([texts[i] for i in own])
                    n = np.bincount(at, minlength=len(own))
                    sums = np.stack([np.bincount(at, weights=table[f, j], minlength=len(own)) for j in range(len(labels))], axis=1)
                    mean = sums / n[:, None]
                    share = np.exp(SHARPNESS * (mean - mean.max(axis=1, keepdims=True)))
                    share /= share.sum(axis=1, keepdims=True)
                    for i, j, s in zip(own, mean.argmax(axis=1), share.max(axis=1)):
                        names[i - a], scores[i - a] = labels[j], float(s)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b], pa.int64()), pa.array(names), pa.array(scores)], schema=schema)

    return run


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """(id, lang_pred, score) of rows (id, text); the model is at most MAX_LABELS * 2**BITS floats."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(_predict(shared), "id long, lang_pred string, score double")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label"))
    held_out = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = fit(docs.where(~held_out))
    found = predict(docs.select("id", "text"), model)
    return found.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "lang_pred", "score")
