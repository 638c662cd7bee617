"""Text functions on columns: sentences, character classes, numerals, clean-up."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentence ends of the two profiles, closing marks that stay with a sentence, softer breaks.
ENDS = {"zh": "。!！？?", "latin": "。!！？?."}
CLOSERS = "”’）)"
SOFT = ":：;；"
LONGEST = 510

# Digits of written numbers.
CHINESE_DIGITS = {"零": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
CHINESE_UNITS = {"十": 10, "百": 100, "千": 1000}


def sentences(text: Column, profile: str = "latin", longest: int = LONGEST) -> Column:
    """Sentences of a text in order, without empty ones.

    A sentence ends after an end mark that no closing mark follows, or after six dots; pieces longer
    than `longest` are split after softer marks, then cut. Null gives null.
    """
    ends = ENDS[profile]
    cut = F.split(text, rf"(?<=[{ends}])(?![{CLOSERS}{'.' if '.' in ends else ''}])|(?<=\.{{6}})(?!\.)")
    soft = F.flatten(F.transform(cut, lambda s: F.when(F.length(s) > longest, F.split(s, f"(?<=[{SOFT}])")).otherwise(F.array(s))))
    hard = F.flatten(F.transform(soft, lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(s) / F.lit(longest)) - 1, F.lit(0)).cast("int")), lambda k: F.substring(s, k * longest + 1, F.lit(longest)))))
    return F.filter(hard, lambda s: s != "")


def windows(text: Column, size: int, overlap: float = 0.25) -> Column:
    """Pieces of `size` code points, each starting (1 - overlap) * size after the one before."""
    step = max(1, int(size * (1 - overlap)))
    last = F.ceil(F.greatest(F.length(text) - size, F.lit(0)) / F.lit(step)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(text, k * step + 1, F.lit(size)))


def strip(text: Column) -> Column:
    """Without leading and trailing white space of any script."""
    return F.regexp_replace(text, r"^[\s\u3000\u00a0]+|[\s\u3000\u00a0]+$", "")


def has_chinese(text: Column) -> Column:
    return text.rlike(r"[\u4e00-\u9fff]")


def has_arabic(text: Column) -> Column:
    return text.rlike(r"[\u0600-\u06ff]")


def is_latin_word(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z]+$")


def open_brackets(text: Column) -> Column:
    """Opening minus closing brackets."""
    return F.length(F.regexp_replace(text, r"[^《（(]", "")) - F.length(F.regexp_replace(text, r"[^》）)]", ""))


def chinese_number(text: Column) -> Column:
    """Value of a written number up to 9999, or null if other characters occur."""
    digits = F.create_map(*[x for k, v in CHINESE_DIGITS.items() for x in (F.lit(k), F.lit(v))])
    units = F.create_map(*[x for k, v in CHINESE_UNITS.items() for x in (F.lit(k), F.lit(v))])
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    start = F.struct(F.lit(0).alias("total"), F.lit(-1).alias("digit"))

    def step(state: Column, c: Column) -> Column:
        unit, digit = F.try_element_at(units, c), F.try_element_at(digits, c)
        times = F.when(state["digit"] < 0, F.lit(1)).otherwise(state["digit"])
        return F.when(unit.isNotNull(), F.struct((state["total"] + times * unit).alias("total"), F.lit(-1).alias("digit"))).otherwise(F.struct(state["total"].alias("total"), F.coalesce(digit, F.lit(0)).alias("digit")))

    value = F.aggregate(chars, start, step, lambda s: s["total"] + F.greatest(s["digit"], F.lit(0)))
    return F.when(text.rlike("^[零一二三四五六七八九十百千]+$"), value)


def collapsed(symbols: Column, blank) -> Column:
    """Symbols without repeats of the one before and then without blanks."""
    return F.filter(F.filter(symbols, lambda c, i: (i == 0) | (c != symbols[F.greatest(i - 1, F.lit(0))])), lambda c: c != blank)


def collapsed_text(text: Column, blank: str) -> Column:
    """collapsed() of a text's characters, in one pass; the array's form takes the square of a text's length."""
    return F.replace(F.regexp_replace(text, r"(?s)(.)\1+", "$1"), F.lit(blank), F.lit(""))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty texts."""
    return F.lit(1.0) - F.coalesce(F.try_divide(F.levenshtein(a, b).cast("double"), F.greatest(F.length(a), F.length(b))), F.lit(0.0))


def edit_distance(a: str, b: str) -> int:
    """Edit distance of whole texts: told by length where one text is the other with characters left out, else a column of the table at once, as bits of one number."""
    if len(a) > len(b):
        a, b = b, a
    rest = iter(b)
    if all(c in rest for c in a):
        return len(b) - len(a)
    m, at = len(a), {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | (1 << i)
    full, top, distance = (1 << m) - 1, 1 << (m - 1), m
    more, less = full, 0  # rows where the column's values grow or shrink by one
    for c in b:
        eq = at.get(c, 0)
        x = (((eq & more) + more) ^ more) | eq
        up, down = less | (full & ~(x | more)), more & x
        distance += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & full, (down << 1) & full
        more, less = down | (full & ~(eq | less | up)), up & (eq | less)
    return distance


def whole_similarity(a: Column, b: Column) -> Column:
    """similarity() of long texts, whose whole table of distances would take too long."""

    @F.pandas_udf("long")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or t is None else edit_distance(s, t) for s, t in zip(x, y)], dtype="Int64")

    return F.lit(1.0) - F.coalesce(F.try_divide(distance(a, b).cast("double"), F.greatest(F.length(a), F.length(b))), F.lit(0.0))


def heading_depth(cid: Column) -> Column:
    return F.size(F.split(cid, r"\."))


def tidy_latex(text: Column) -> Column:
    """Without empty groups, spaces before scripts and trailing blanks."""
    out = text
    for _ in range(3):  # groups nest
        out = F.regexp_replace(out, r"\\(?:text|mathrm|mathbf|operatorname)?\s*\{\s*\}|(?<![\\a-zA-Z}\]])\{\s*\}", "")
    out = F.regexp_replace(out, r"\s*([_^])\s*", "$1")
    return F.regexp_replace(F.regexp_replace(out, r"\s{2,}", " "), r"(?:\\[,;:!]|\\quad|\\qquad|~|\s)+$", "")


def html_escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def contains_math(text: Column) -> Column:
    """Whether the text begins or ends with a dollar sign."""
    return text.startswith("$") | text.endswith("$")


def is_latex(text: Column) -> Column:
    """Whether the text has a command or escape, or a pair of dollar signs."""
    return text.rlike(r"(?s)\\.|\$.*\$")


def clean_name(text: Column) -> Column:
    """Underscores for characters that names shouldn't hold."""
    # Fixed value: these characters.
    return F.regexp_replace(text, "[|@#!¡·$€%&()=?¿^*;:,¨´><+]", "_")


def softmax(scores: Column) -> Column:
    """Shares of an array's exponentials, taken from its largest value; empty stays empty."""
    e = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, v: a + v))


def language_codes(langs: Column, codes: dict[str, str], strict: bool = False) -> Column:
    """An array of languages with names (keys of `codes`, in title case) replaced by codes; what is neither stays, or fails if strict."""
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    known = F.array(*[F.lit(c) for c in sorted(set(codes.values()))])
    fail = F.raise_error(F.lit("a language is neither a known name nor a code"))

    def code(x: Column) -> Column:
        found = F.coalesce(F.try_element_at(table, F.initcap(x)), x)
        return F.when(F.array_contains(known, found), found).otherwise(fail.cast("string")) if strict else found

    return F.transform(langs, code)


def reversed_runs(text: Column) -> Column:
    """Right-to-left text in reading order: reversed, while runs of Latin letters, digits and marks keep theirs."""
    # Fixed value: the characters of such runs.
    run = "a-zA-Z0-9 :*./%+-"
    return F.array_join(F.reverse(F.regexp_extract_all(text, F.lit(f"(?s)[{run}]+|[^{run}]"), F.lit(0))), "")


def _without_tail(text: str, least: int) -> str:
    """text without the copies of its longest repeated tail; candidates are where its last `least` characters recur."""
    n = len(text)
    if n < 2 * least:
        return text
    end = text[-least:]
    at = text.find(end, n - least - max(n // 2 - 1, 0))
    while 0 <= at <= n - 2 * least:
        r = n - least - at
        tail = text[n - r :]
        if text[n - 2 * r : n - r] == tail:
            while n >= r and text.endswith(tail, 0, n):
                n -= r
            return text[:n]
        at = text.find(end, at + 1)
    return text


def without_repeated_tail(text: Column, least: int = 15) -> Column:
    """The text up to its longest tail that stands twice or more at its end, of `least` to half of its code points. Null gives null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _without_tail(t, least))

    return run(text)


def known_prefixes(words: DataFrame, known: DataFrame, word: str = "word") -> DataFrame:
    """(word, matches): prefixes of each distinct word that `known` holds, shorter ones first; one of a single character goes if there are others."""
    known = known.select(F.col(word).alias("_known")).where("_known <> ''").distinct()
    longest = known.agg(F.max(F.length("_known"))).first()[0] or 0
    stems = words.select(word).where(F.length(word) > 0).distinct().select(word, F.explode(F.sequence(F.lit(1), F.least(F.length(word), F.lit(max(longest, 1))))).alias("_n"))
    found = stems.withColumn("_known", F.substring(word, F.lit(1), F.col("_n"))).join(known, "_known")
    matches = F.transform(F.array_sort(F.collect_list(F.struct("_n", "_known"))), lambda x: x["_known"])
    few = F.when((F.size("m") > 1) & (F.length(F.col("m")[0]) == 1), F.slice("m", F.lit(2), F.size("m") - 1)).otherwise(F.col("m"))
    return found.groupBy(word).agg(matches.alias("m")).select(word, few.alias("matches"))


def decoded(codes: Column, symbols: Column, stop: int | None = None, ignored: tuple[int, ...] = (), without_repeats: bool = False) -> Column:
    """Symbols of a list of codes up to the stop code, without ignored ones; attention-like decoders keep repeats, others drop them."""
    end = F.array_position(codes, stop) if stop is not None else F.lit(0)
    own = F.when(end > 0, F.slice(codes, F.lit(1), F.greatest(end - 1, F.lit(0)).cast("int"))).otherwise(codes)
    if without_repeats:
        own = F.filter(own, lambda c, i: (i == 0) | (c != F.get(own, i - 1)))
    kept = F.filter(own, lambda c: ~c.isin(*ignored)) if ignored else own
    return F.transform(kept, lambda c: F.get(symbols, c))


def contents_headings(text: Column) -> Column:
    """Headings of a table of contents: lines without spaces up to the leader, which is the text's most frequent character and must stand twice; a line without it goes on in the next one.

    Short lines without a leader (page numbers) and the title line are left out. Null gives null.
    """
    chars = F.filter(F.split(text, ""), lambda c: (c != "") & (c != "\n"))
    counted = F.transform(F.array_distinct(chars), lambda c: F.struct(F.size(F.filter(chars, lambda d: d == c)).alias("n"), c.alias("c")))
    leader = F.aggregate(counted, F.struct(F.lit(0).alias("n"), F.lit("").alias("c")), lambda best, x: F.when(x["n"] > best["n"], x).otherwise(best))["c"]
    lines = F.transform(F.split(text, "\n"), lambda x: F.replace(x, F.lit(" "), F.lit("")))
    state = F.struct(F.lit("").alias("held"), F.slice(F.array(F.lit("")), 1, 0).alias("out"))

    def step(s: Column, line: Column) -> Column:
        own = F.concat(s["held"], line)
        at = F.position(leader, own)
        skipped = (line == "目录") | ((F.position(leader, line) == 0) & (F.length(line) < 8) & (s["held"] == ""))
        waits = (at == 0) & (s["held"] == "")
        fits = (at > 1) & (F.substr(own, at + 1, F.lit(1)) == leader)
        done = F.when(fits, F.concat(s["out"], F.array(F.left(own, at - 1)))).otherwise(s["out"])
        return F.when(skipped, s).when(waits, F.struct(own.alias("held"), s["out"].alias("out"))).otherwise(F.struct(F.lit("").alias("held"), done.alias("out")))

    return F.aggregate(lines, state, step, lambda s: s["out"])
