"""Token counts of whole texts through a cache that is keyed by content and tokenizer digests.

The content digest is SHA-256 of the text's UTF-8 bytes (counts depend on every byte, so the
normalisation is only null to empty); the tokenizer digest is SHA-256 of its vocabulary file, so a
new version never meets old counts. Digests without a stored count are encoded once for each distinct
text, and the counts are appended to the cache, a Parquet table. Copies within a task are merged
before the shuffle. Appending twice is harmless: of several counts of a digest the largest is
taken, and they are equal. Counts come back by a join of two written tables, whose skewed parts adaptive
execution splits, as one text may be a third of all rows. Null texts count as empty and have no tokens.
Rows that repeat an id each get a row. Other columns are ignored, whatever their names. An empty
table gives an empty result and leaves the cache as it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, cut, fresh_path, released, small_batches

VOCABULARY = "piece_bpe_32k.model"
LIMIT = 4096
CACHE = "content binary, tokenizer string, n_tokens long"

_loaded: dict = {}


def tokenizer(name: str):
    """A function from texts to their lists of ids; loaded once in each process."""
    if name not in _loaded:
        path = public_tokenizers.path(name)
        if name.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[name] = lambda texts: model.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            fast = Tokenizer.from_file(path)
            fast.no_truncation()
            fast.no_padding()
            _loaded[name] = lambda texts: [e.ids for e in fast.encode_batch(texts, add_special_tokens=False)]
    return _loaded[name]


def tokenizer_digest(name: str) -> str:
    with open(public_tokenizers.path(name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _counts(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(name)
        for batch in batches:
            n = [len(encode([t])[0]) for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("content")), pa.array(n, pa.int64())], names=["content", "n_tokens"])
        released()

    return run


def cached(spark: SparkSession, path: str, digest: str) -> DataFrame:
    """Stored counts for a tokenizer; an absent cache is an empty one."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "content binary, n_tokens long")
    rows = spark.read.schema(CACHE).parquet(path).where(F.col("tokenizer") == digest)
    return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, cache_path: str, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of each row; the cache at cache_path is read and appended to."""
    spark = docs.sparkSession
    small_batches(spark)
    digest = tokenizer_digest(vocabulary)
    text = F.coalesce(F.col(text_col), F.lit(""))
    content = F.unhex(F.sha2(text.cast("binary"), 256))
    keyed = docs.select(text.alias("text"), content.alias("content"))
    misses = keyed.join(cached(spark, cache_path, digest).select("content"), "content", "left_anti")
    fresh = misses.groupBy("content").agg(F.first("text").alias("text")).mapInArrow(_counts(vocabulary), "content binary, n_tokens long")
    fresh.select("content", F.lit(digest).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    slim = cut(docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), content.alias("content")), "token-rows")
    stored = cut(cached(spark, cache_path, digest).join(slim.select("content").distinct(), "content", "left_semi"), "token-counts")
    return slim.join(stored, "content").select(F.col("id").alias(id_col), "n_bytes", "n_tokens")


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """Starts from an empty cache of its own, so that every call does the whole work."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, fresh_path(spark, "token-cache")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
