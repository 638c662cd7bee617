"""Repeated passages of lines, found by winnowing and deleted after their first occurrence.

A line is a \\n-separated piece of a text, compared by its words joined by one space. The passage
from a line is the shortest run of lines from there with at least min_words words, the passage up to
a line the shortest such run that ends there. Its hash is a fingerprint candidate; of every `window`
consecutive candidates of a kind in a document the smallest hash (the last of equal ones) is
selected, with a window of 1 all. Each line of a run of min_words words or more lies in a passage
within that run (from its line, up to its line, or from the run's first line), so with a window of 1
every line of a repeated run is deleted, whatever stands around it. Every fingerprint's first place,
by (id, line), is its source; each other place is matched to the source, the match is extended line
by line to both sides, and its lines are deleted from the later place. Lines are deleted only where an equal line
stands earlier, so one copy of everything remains. Repeats within one document count too.

A row is told by its id and its text: rows that repeat an id with another text are documents of their
own, in the order of a hash of their texts; rows that repeat an id and text count as one and have the
same lines deleted. Null and empty texts have no passages and come back unchanged. Rows of null ids
are never changed and are no source. Repeats of fewer than min_words words stay (short lines that
recur, such as headings or separators, are no passages). Other columns pass through, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut, released, small_batches

MIN_WORDS = 40
WINDOW = 1


def line_hashes(text: str | None) -> tuple[list[int], list[int]]:
    """A 64-bit hash and the number of words of each line."""
    if not text:
        return [], []
    hashes, counts = [], []
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        words = line.split()
        counts.append(len(words))
        hashes.append(xxhash.xxh64_intdigest(b" ".join(words)))
    return hashes, counts


def passages(counts: list[int], min_words: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The runs [first, last) of lines that are passages from their first line, and those up to their last line that aren't among them."""
    from_, up_to = [], []
    end = words = 0
    for start in range(len(counts)):
        while end < len(counts) and words < min_words:
            words += counts[end]
            end += 1
        if words < min_words:
            break
        from_.append((start, end))
        words -= counts[start]
    start = words = 0
    for end in range(1, len(counts) + 1):
        words += counts[end - 1]
        while words - counts[start] >= min_words and start < end - 1:
            words -= counts[start]
            start += 1
        if words >= min_words:
            up_to.append((start, end))
    known = set(from_)
    return from_, [x for x in up_to if x not in known]


def fingerprints(hashes: list[int], counts: list[int], min_words: int = MIN_WORDS, window: int = WINDOW) -> list[tuple[int, int]]:
    """Selected (fingerprint, line) pairs, in order of lines for each kind of passage."""
    out = []
    for runs in passages(counts, min_words):
        grams = []
        for start, end in runs:
            digest = xxhash.xxh64(counts[start].to_bytes(8, "little"))
            for h in hashes[start:end]:
                digest.update(h.to_bytes(8, "little"))
            grams.append(digest.intdigest() - (1 << 63))
        picked = []
        for a in range(max(1, len(grams) - window + 1) if grams else 0):
            least = min(range(a, min(a + window, len(grams))), key=lambda i: (grams[i], -i))
            if not picked or picked[-1] != least:
                picked.append(least)
        out += [(grams[i], runs[i][0]) for i in picked]
    return out


def extend(own: np.ndarray, source: np.ndarray, at: int, source_at: int) -> tuple[int, int]:
    """The run [first, last) of own lines around at that equals the source's lines around source_at."""
    back = min(at, source_at)
    differ = np.flatnonzero(own[at - back : at][::-1] != source[source_at - back : source_at][::-1])
    first = at - (int(differ[0]) if len(differ) else back)
    on = min(len(own) - at, len(source) - source_at)
    differ = np.flatnonzero(own[at : at + on] != source[source_at : source_at + on])
    return first, at + (int(differ[0]) if len(differ) else on)


def _key(batch: pa.RecordBatch) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(c)) for c in ("id", "same")]


def _scan(min_words: int, window: int):
    schema = pa.schema([("id", pa.int64()), ("same", pa.int64()), ("fps", pa.list_(pa.struct([("fp", pa.int64()), ("line", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[{"fp": f, "line": i} for f, i in fingerprints(*line_hashes(t), min_words, window)] for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([*_key(batch), pa.array(rows, schema.field(2).type)], schema=schema)
        released()

    return run


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [np.array(line_hashes(t)[0], np.uint64).tobytes() for t in column(batch, "text")]
        yield pa.RecordBatch.from_arrays([*_key(batch), pa.array(packed, pa.binary())], names=["id", "same", "lines"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    for batch in batches:
        out = []
        for own, source, places in zip(column(batch, "lines"), column(batch, "source_lines"), column(batch, "places")):
            own, source = np.frombuffer(own, np.uint64), np.frombuffer(source, np.uint64)
            found: list[tuple[int, int]] = []
            for p in sorted(places, key=lambda p: (p["line"], p["source_line"])):
                same = [(a, b) for a, b, shift in found if shift == p["line"] - p["source_line"] and a <= p["line"] < b]
                if not same:
                    found.append((*extend(own, source, p["line"], p["source_line"]), p["line"] - p["source_line"]))
            out.append([{"a": a, "b": b} for a, b, _ in found])
        yield pa.RecordBatch.from_arrays([*_key(batch), pa.array(out, run_type)], names=["id", "same", "runs"])


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, window: int = WINDOW) -> DataFrame:
    """(id, same, runs): for each document with repeats, told by id and a hash of its text, the runs [a, b) of its lines to delete."""
    small_batches(docs.sparkSession)
    key = ["id", "same"]
    own = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("same"), F.col(text_col).alias("text"))
    prints = own.mapInArrow(_scan(min_words, window), "id long, same long, fps array<struct<fp: long, line: int>>").select(*key, F.inline("fps"))
    prints = cut(prints, "lines-fingerprints")
    # A fingerprint whose first and last place are one has no other, even if rows repeat an id and text.
    first = prints.groupBy("fp").agg(F.min(F.struct(*key, "line")).alias("s"), F.max(F.struct(*key, "line")).alias("e")).where("s <> e").select("fp", "s")
    first = cut(first, "lines-sources").select("fp", F.col("s.id").alias("source"), F.col("s.same").alias("source_same"), F.col("s.line").alias("source_line"))
    places = prints.join(first, "fp").where("id <> source or same <> source_same or line <> source_line").groupBy(*key, "source", "source_same").agg(F.collect_set(F.struct("line", "source_line")).alias("places"))
    places = cut(places, "lines-places")
    needed = places.select(*key).unionByName(places.select(F.col("source").alias("id"), F.col("source_same").alias("same"))).distinct()
    lines = own.join(needed.hint("merge"), key, "left_semi").mapInArrow(_hash_rows, "id long, same long, lines binary").dropDuplicates(key)
    lines = cut(lines, "lines-hashes")
    both = places.join(lines, key).join(lines.select(F.col("id").alias("source"), F.col("same").alias("source_same"), F.col("lines").alias("source_lines")), ["source", "source_same"])
    runs = both.mapInArrow(_runs, "id long, same long, runs array<struct<a: int, b: int>>")
    return cut(runs.groupBy(*key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("runs")))).alias("runs")), "lines-runs")


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with their text cut, and the numbers of all and of deleted lines."""
    for batch in batches:
        texts, n_lines, n_removed = [], [], []
        for text, runs in zip(column(batch, "text"), column(batch, "runs")):
            lines = text.split("\n") if text else []
            gone = set()
            for r in runs or []:
                gone.update(range(r["a"], min(r["b"], len(lines))))
            texts.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text)
            n_lines.append(len(lines))
            n_removed.append(len(gone))
        rest = batch.column(batch.schema.get_field_index("rest"))
        yield pa.RecordBatch.from_arrays([rest, pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], names=["rest", "text", "n_lines", "n_removed"])
    released()


def _cut_rows(docs: DataFrame, id_col: str, text_col: str, min_words: int, window: int) -> DataFrame:
    """(rest, text, n_lines, n_removed) of each row; rest holds the other columns."""
    runs = repeated_runs(docs, id_col, text_col, min_words, window).select(F.col("id").alias("run_id"), F.col("same").alias("run_same"), "runs")
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    slim = docs.select(F.col(id_col).alias("id"), F.struct(*others).alias("rest"), F.col(text_col).alias("text"))
    joined = slim.where("id is not null").withColumn("same", F.xxhash64("text")).join(runs.hint("merge"), (F.col("id") == F.col("run_id")) & (F.col("same") == F.col("run_same")), "left").select("rest", "text", "runs")
    joined = joined.unionByName(slim.where("id is null").select("rest", "text", F.lit(None).cast("array<struct<a: int, b: int>>").alias("runs")))
    return joined.mapInArrow(_cleaned, f"rest {dict(slim.dtypes)['rest']}, text string, n_lines long, n_removed long")


def _unpacked(docs: DataFrame, text_col: str) -> list[F.Column]:
    return [F.col("text").alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in docs.columns]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, window: int = WINDOW) -> DataFrame:
    """docs with later repeated runs of lines deleted from the text, and with _n_lines and _n_removed in place of columns so named."""
    own = docs.drop("_n_lines", "_n_removed")
    done = _cut_rows(own, id_col, text_col, min_words, window)
    return done.select(*_unpacked(own, text_col), F.col("n_lines").alias("_n_lines"), F.col("n_removed").alias("_n_removed"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs, same columns, with repeated runs deleted; documents whose whole text goes are left out."""
    done = _cut_rows(docs, "doc_id", "text", MIN_WORDS, WINDOW)
    return done.where("not (n_removed > 0 and trim(text) = '')").select(*_unpacked(docs, "text"))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "text", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"))
