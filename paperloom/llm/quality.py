"""Quality rules by tokeniser fertility, with bands per language or script.

Two public vocabularies measure each text: chars_per_token and token_entropy (bits per token, over
log2 of the number of tokens) by both, byte_share (fall-back byte pieces among all tokens) by the one
that has such pieces. Documents are grouped by language or, where that is null, by the script of most
letters of the whole text. A figure of a short text varies more, so chars_per_token and byte_share are
taken as their distance from the group's median times the square root of the number of tokens, and
token_entropy within the doubling of tokens that a text falls into. Where that has fewer than
MIN_GROUP documents, the group's next doublings to both sides are taken in until there are POOL
documents or all of the group, and token_entropy is taken less a line over log2 of the number of tokens
that is fitted to the medians of these doublings, as it falls with a text's length. The quartiles of
these over all documents of a group give its bands; what lies outside is counted in quartile ranges,
which are the wider the fewer documents tell them (by WIDEN / their number). A text is rejected if its
shortfall, the ranges by which chars_per_token lies below the lower quartile, on average over the
vocabularies, and those of token_entropy, summed over them, is above SHORT, or if byte_share lies more than
BYTES ranges above its upper quartile. Every document that passes the base rules shapes bands and is judged
by them. Groups of fewer than MIN_GROUP documents share one group.

The base rules count words (runs of characters other than space and \\t to \\r), their code points,
symbols, repeated lines and words in repeated three-word windows; they reject texts with fewer than
50 words or with more than half of the words in such windows. Null and empty texts have no words
and are rejected. Rows that repeat an id each get a row; other columns are ignored, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import CHUNK_BYTES, chunks, column, cut, encoded, released, shingle_hashes, small_batches, word_hashes

#: The first has byte pieces; its number of tokens tells a text's doubling.
VOCABULARY = "piece_bpe_32k.model"
SECOND = "byte_bpe_multi_50k.tiktoken"
MIN_WORDS = 50
MIN_GROUP = 100
#: Documents that tell the entropy of a doubling with fewer than MIN_GROUP.
POOL = 500
SHORT = 3.75
BYTES = 4.0
#: Narrowest quartile ranges, so that a uniform group rejects nothing by chance.
LEAST = {"z_chars": 0.5, "z_chars_2": 0.5, "z_bytes": 0.05, "token_entropy": 0.02, "token_entropy_2": 0.02}
#: Ranges told by n documents are taken as 1 + WIDEN / n of theirs.
WIDEN = 20
#: Weight, in documents one doubling off, that holds a fitted line level.
LEVEL = 10.0

_SCRIPT = regex.compile(r"(?P<Latin>\p{Latin})|(?P<Cyrillic>\p{Cyrillic})|(?P<Greek>\p{Greek})|(?P<Arabic>\p{Arabic})|(?P<Hebrew>\p{Hebrew})|(?P<Han>\p{Han})|(?P<Kana>[\p{Hiragana}\p{Katakana}])|(?P<Hangul>\p{Hangul})|(?P<Devanagari>\p{Devanagari})|(?P<Other>\p{L})")
_SYMBOL = regex.compile(r"[#*$%&|<>]")
_model: list = []


def _pieces():
    """The first vocabulary's encoder, a mask of its byte pieces, and the second one's encoder; loaded once in each process."""
    if not _model:
        import sentencepiece
        import tiktoken

        sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(VOCABULARY))
        with open(public_tokenizers.path(SECOND), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        second = tiktoken.Encoding(SECOND, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _model.extend([sp, np.array([sp.is_byte(i) for i in range(sp.get_piece_size())]), second])
    return _model


def entropy(ids: np.ndarray) -> float:
    """Bits per token over log2 of the number of tokens."""
    n = len(ids)
    if not n:
        return 0.0
    counts = np.bincount(ids)
    counts = counts[counts > 0]
    return float(np.log2(n) - (counts * np.log2(counts)).sum() / n) / max(1.0, float(np.log2(n)))


_script_of: dict[int, str | None] = {}


def script(text: str) -> str:
    """Script of most letters of the whole text, ties to the later name; 'none' without letters."""
    counts: dict[str, int] = {}
    points, n = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
    for point, times in zip(points.tolist(), n.tolist()):
        if point not in _script_of:
            m = _SCRIPT.match(chr(point))
            _script_of[point] = m.lastgroup if m else None
        if name := _script_of[point]:
            counts[name] = counts.get(name, 0) + times
    return max(counts, key=lambda k: (counts[k], k)) if counts else "none"


def repeated_words(words: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Words of each text that lie in a three-word window which the text holds twice or more."""
    n = len(words) - 2
    if n <= 0:
        return np.zeros(n_docs, np.int64)
    whole = np.flatnonzero(doc[:n] == doc[2:])
    h, at = shingle_hashes(words, doc, 3, n_docs)
    counts = np.bincount(doc, minlength=n_docs)
    long_ = counts[at] >= 3
    h, at = h[long_], at[long_]
    key = (at.astype(np.uint64) << np.uint64(52)) | (h >> np.uint64(12))
    order = np.argsort(key, kind="stable")
    equal = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    marked = np.zeros(len(words), bool)
    for shift in range(3):
        marked[whole[twice] + shift] = True
    return np.bincount(doc[marked], minlength=n_docs)


COLUMNS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("n_tokens", pa.int64()), ("chars_per_token", pa.float64()), ("byte_share", pa.float64()), ("token_entropy", pa.float64()), ("script", pa.string()), ("n_tokens_2", pa.int64()), ("chars_per_token_2", pa.float64()), ("token_entropy_2", pa.float64())]


def measure(texts: list[str]) -> list[list]:
    """The COLUMNS of each text, as lists."""
    sp, is_byte, second = _pieces()
    raw = encoded(texts)
    out: list[list] = [[] for _ in COLUMNS]
    for a, b in chunks([len(t) for t in raw], CHUNK_BYTES // 2):
        words, doc = word_hashes(raw[a:b], lower=False)
        n_words = np.bincount(doc, minlength=b - a)
        repeats = repeated_words(words, doc, b - a)
        for i, text in enumerate(texts[a:b]):
            lines = [x for x in text.split("\n") if x.encode("utf-8", "surrogatepass").strip(b" \t\n\r\x0b\x0c")]
            spaces = sum(map(text.count, " \t\n\x0b\x0c\r"))
            ids = np.asarray(sp.encode(text, num_threads=1), np.int64)
            n = len(ids)
            share, per = (float(is_byte[ids].mean()), len(text) / n) if n else (0.0, 0.0)
            more = np.asarray(second.encode_ordinary(text), np.int64)
            values = (int(n_words[i]), len(text) - spaces, len(_SYMBOL.findall(text)), len(lines) - len(set(lines)), int(repeats[i]), n, per, share, entropy(ids), script(text), len(more), len(text) / max(1, len(more)), entropy(more))
            for to, v in zip(out, values):
                to.append(v)
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [n for n in batch.schema.names if n != "text"]
        texts = [t or "" for t in column(batch, "text")]
        made = measure(texts)
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in keep] + [pa.array(v, t) for v, (_, t) in zip(made, COLUMNS)], names=keep + [n for n, _ in COLUMNS])
    released()


def _outside(value: str, quartiles: str, known: str, above: bool) -> F.Column:
    """Quartile ranges by which value lies above or below the quartiles, told by `known` documents; 0 inside or without them."""
    low, high = F.col(quartiles)[0], F.col(quartiles)[1]
    by = F.col(value) - high if above else low - F.col(value)
    wide = F.greatest(high - low, F.lit(LEAST[value])) * (1 + F.lit(float(WIDEN)) / F.col(known))
    return F.coalesce(F.greatest(by / wide, F.lit(0.0)), F.lit(0.0))


#: Bands are broadcast up to this number of rows; beyond it they are joined by a shuffle.
MAX_BROADCAST = 20_000


def _banded(rows: DataFrame, bands: DataFrame, on: list[str]) -> DataFrame:
    few = bands.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    return rows.join(F.broadcast(bands) if few else bands, on, "left")


ENTROPIES = ("token_entropy", "token_entropy_2")


def _entropy_bands(rows: DataFrame, fits: F.Column) -> DataFrame:
    """(band, doubling, at_log, length_known, and for both entropies e: e_q, e_slope): quartiles of e at log2 of n_tokens = at_log, what they change by from there, and the documents that tell them.

    A doubling of MIN_GROUP fitting documents has its own quartiles and slope 0; another has those of
    the doublings around it that hold POOL, along a line through their medians.
    """
    log = F.log2("n_tokens")
    medians = [F.percentile_approx(e, 0.5, 2000).alias(f"{e}_y") for e in ENTROPIES]
    cells = rows.where(fits).groupBy("band", "doubling").agg(F.count(F.lit(1)).alias("n"), F.avg(log).alias("x"), *medians)
    cells = cut(cells, "quality-cells")
    wanted = cells.select("band", F.col("doubling").alias("at"))
    far = F.abs(F.col("at") - F.col("doubling"))
    near = wanted.join(cells, "band").withColumn("far", far)
    # Documents of the doublings nearer than this one; those as near on the other side come along.
    w = Window.partitionBy("band", "at").orderBy("far")
    near = near.withColumn("nearer", F.coalesce(F.sum("n").over(w.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    near = near.withColumn("own", F.max(F.when(F.col("far") == 0, F.col("n"))).over(Window.partitionBy("band", "at")))
    near = near.where(F.when(F.col("own") >= MIN_GROUP, F.col("far") == 0).otherwise(F.col("nearer") < POOL))
    # Weighted least squares over the doublings' medians, so that odd documents don't tilt the line.
    n, x = F.col("n"), F.col("x")
    sums = near.groupBy("band", "at").agg(F.sum(n).alias("s"), F.sum(n * x).alias("sx"), F.sum(n * x * x).alias("sxx"), *[F.sum(n * F.col(f"{e}_y") * v).alias(f"{e}_s{k}") for e in ENTROPIES for k, v in (("y", F.lit(1.0)), ("xy", x))])
    slopes = [((F.col("s") * F.col(f"{e}_sxy") - F.col("sx") * F.col(f"{e}_sy")) / (F.col("s") * F.col("sxx") - F.col("sx") * F.col("sx") + LEVEL * F.col("s"))).alias(f"{e}_slope") for e in ENTROPIES]
    lines = sums.select("band", "at", (F.col("sx") / F.col("s")).alias("at_log"), *slopes)
    plan = near.select("band", "at", "doubling", "own").join(lines, ["band", "at"])
    plan = cut(plan.select("band", "at", "doubling", "at_log", *[F.when(F.col("own") >= MIN_GROUP, 0.0).otherwise(F.col(f"{e}_slope")).alias(f"{e}_slope") for e in ENTROPIES]), "quality-near")
    few = plan.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    pooled = rows.where(fits).select("band", "doubling", "n_tokens", *ENTROPIES).join(F.broadcast(plan) if few else plan, ["band", "doubling"])
    level = lambda e: F.col(e) - F.col(f"{e}_slope") * (log - F.col("at_log"))
    return pooled.groupBy("band", F.col("at").alias("doubling"), "at_log", *[f"{e}_slope" for e in ENTROPIES]).agg(F.count(F.lit(1)).alias("length_known"), *[F.percentile_approx(level(e), [0.25, 0.75], 2000).alias(f"{e}_q") for e in ENTROPIES])


def judged(docs: DataFrame, keep: list[str], text_col: str = "text", lang_col: str | None = "lang", short: float = SHORT, most_bytes: float = BYTES) -> DataFrame:
    """docs' columns in `keep` with the measured ones, base_failed, shortfall, byte_excess and kept.

    Names in `keep` are prefixed by k_, so that they can't clash with measured ones.
    """
    small_batches(docs.sparkSession)
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    slim = docs.select(*[F.col(f"`{c}`").alias(f"k_{c}") for c in keep], lang.alias("lang"), F.col(text_col).alias("text"))
    types = {pa.int64(): "long", pa.float64(): "double", pa.string(): "string"}
    schema = ", ".join([f"`{n}` {t}" for n, t in slim.dtypes if n != "text"] + [f"{n} {types[t]}" for n, t in COLUMNS])
    rows = cut(slim.mapInArrow(_measured, schema), "quality-figures")
    rows = rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    fits = ~F.col("base_failed")
    rows = rows.withColumn("own_group", F.coalesce("lang", "script"))
    large = rows.where(fits).groupBy("own_group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_GROUP).select("own_group", F.col("own_group").alias("band"))
    rows = _banded(rows, cut(large, "quality-groups"), ["own_group"]).withColumn("band", F.coalesce("band", F.lit("*")))
    figures = {"z_chars": ("chars_per_token", "n_tokens"), "z_chars_2": ("chars_per_token_2", "n_tokens_2"), "z_bytes": ("byte_share", "n_tokens")}
    middle = rows.where(fits).groupBy("band").agg(*[F.percentile_approx(f, 0.5, 2000).alias(f"{f}_mid") for f, _ in figures.values()])
    rows = _banded(rows, cut(middle, "quality-middles"), ["band"])
    rows = rows.withColumns({z: (F.col(f) - F.col(f"{f}_mid")) * F.sqrt(n) for z, (f, n) in figures.items()})
    rows = rows.withColumn("doubling", F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int"))
    quartiles = rows.where(fits).groupBy("band").agg(F.count(F.lit(1)).alias("known"), *[F.percentile_approx(z, [0.25, 0.75], 2000).alias(f"{z}_q") for z in figures])
    out = _banded(_banded(rows, cut(quartiles, "quality-quartiles"), ["band"]), cut(_entropy_bands(rows, fits), "quality-lengths"), ["band", "doubling"])
    off = F.log2(F.greatest("n_tokens", F.lit(1))) - F.col("at_log")
    moved = lambda e: F.transform(f"{e}_q", lambda q: q + F.col(f"{e}_slope") * off)
    out = out.withColumns({f"{e}_q": moved(e) for e in ENTROPIES})
    chars = (_outside("z_chars", "z_chars_q", "known", False) + _outside("z_chars_2", "z_chars_2_q", "known", False)) / 2
    spread = sum((_outside(e, f"{e}_q", "length_known", False) for e in ENTROPIES[1:]), _outside(ENTROPIES[0], f"{ENTROPIES[0]}_q", "length_known", False))
    out = out.withColumn("shortfall", chars + spread).withColumn("byte_excess", _outside("z_bytes", "z_bytes_q", "known", True))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("shortfall") <= short) & (F.col("byte_excess") <= most_bytes))


def quality(docs: DataFrame, id_col: str = "doc_id", **params) -> DataFrame:
    """A row for each document: id, the measured columns, base_failed, shortfall, byte_excess, kept."""
    return judged(docs, [id_col], **params).select(F.col(f"k_{id_col}").alias(id_col), *[n for n, _ in COLUMNS], "base_failed", "shortfall", "byte_excess", "kept")


def passing(docs: DataFrame) -> DataFrame:
    """docs, same columns, without the rows that the rules reject. Rows travel with their figures, so no join moves texts."""
    return judged(docs, docs.columns).where("kept").select(*[F.col(f"`k_{c}`").alias(c) for c in docs.columns])


def op7_fertility_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "chars_per_token", "byte_share", "token_entropy", "n_tokens_2", "chars_per_token_2", "token_entropy_2", "shortfall", "byte_excess")
