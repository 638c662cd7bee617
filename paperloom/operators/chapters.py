"""Chapters: heading rules, counters, the chapter tree and as-of assignment of elements."""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import chinese_number
from .ordered import as_of


class Rule(NamedTuple):
    name: str
    pattern: str
    numeral: str  # chinese, digits, upper, lower, none


#: Heading rules in order; the first match counts. The pattern's group is the number.
RULES = (
    Rule("part", r"^第\s*([零一二三四五六七八九十百千]+)\s*[章编篇]", "chinese"),
    Rule("section", r"^第\s*([零一二三四五六七八九十百千]+)\s*节", "chinese"),
    Rule("article", r"^第\s*([零一二三四五六七八九十百千]+)\s*条", "chinese"),
    Rule("list_cn", r"^([零一二三四五六七八九十百千]+)\s*、", "chinese"),
    Rule("paren_cn", r"^[（(]([零一二三四五六七八九十百千]+)[）)]", "chinese"),
    Rule("chapter", r"^Chapter\s+(\d+)", "digits"),
    Rule("third", r"^\d+\.\d+\.(\d+)(?!\.?\d)", "digits"),
    Rule("second", r"^\d+\.(\d+)(?!\.?\d)", "digits"),
    Rule("list", r"^(\d+)\s*[、.．]", "digits"),
    Rule("paren", r"^[（(](\d+)[）)]", "digits"),
    Rule("half_paren", r"^(\d+)[）)]", "digits"),
    Rule("letter", r"^([A-Z])\s*[、.]", "upper"),
    Rule("small_letter", r"^([a-z])\s*[、.)）]", "lower"),
    Rule("portion", r"^第\s*([零一二三四五六七八九十百千]+)\s*部分", "chinese"),
    Rule("half_paren_cn", r"^([零一二三四五六七八九十百千]+)[）)]", "chinese"),
    Rule("space_cn", r"^([零一二三四五六七八九十百千]+)\s+\S", "chinese"),
    Rule("attachment", r"^附件([一二三四五六七八九十]{1,3})", "chinese"),
    # Headings without a number.
    Rule("contents", r"^(目录)", "none"),
    Rule("notice", r"^((?:特别|重要|重大)(?:风险|内容|事项)提示|声明|释义)", "none"),
    Rule("customized", r"^(调查人员声明|实地调查|外围信息采集及其他方式|营销背景)", "none"),
)
#: Headings of digits and Latin letters as SQL has them: blanks are those of RE2, dotted numbers may go on.
LATIN_RULES = (
    Rule("chapter", r"^Chapter[\t\n\f\r ]+(\d+)", "digits"),
    Rule("third", r"^\d+\.\d+\.(\d+)", "digits"),
    Rule("second", r"^\d+\.(\d+)", "digits"),
    Rule("list", r"^(\d+)[\t\n\f\r ]*[、.]", "digits"),
    Rule("paren", r"^[（(](\d+)[）)]", "digits"),
    Rule("half_paren", r"^(\d+)[）)]", "digits"),
    Rule("letter", r"^([A-Z])[\t\n\f\r ]*[、.]", "upper"),
    Rule("small_letter", r"^([a-z])[\t\n\f\r ]*[、.)）]", "lower"),
)
LONGEST_TITLE = 40
DEEPEST = 6


def rule_of(text: Column, rules=RULES) -> Column:
    """Position of the first matching rule, or null; titles are short."""
    found = F.coalesce(*[F.when(text.rlike(r.pattern), F.lit(i)) for i, r in enumerate(rules)])
    return F.when(F.length(text) < LONGEST_TITLE, found)


def number_of(text: Column, rule: Column, rules=RULES) -> Column:
    """The number in a title under its rule, or null if it can't be read."""
    out = F.lit(None).cast("int")
    for i, r in enumerate(rules):
        group = F.regexp_extract(text, r.pattern, 1)
        value = chinese_number(group) if r.numeral == "chinese" else F.try_to_number(group, F.lit("999999999")).cast("int") if r.numeral == "digits" else F.lit(None).cast("int") if r.numeral == "none" else F.ascii(group)
        out = F.when(rule == i, value).otherwise(out)
    return out


def titled(elements: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """elements with rule, rule name and number; null where the text is no title."""
    names = F.array(*[F.lit(r.name) for r in rules])
    out = elements.withColumn("rule", rule_of(F.col(text_col), rules))
    return out.withColumn("rule_name", F.get(names, F.col("rule"))).withColumn("num", number_of(F.col(text_col), F.col("rule"), rules))


def as_of_chapter(elements: DataFrame, keys: list[str], idx: str, is_title: Column, name: str = "chapter_idx", root: int = -1) -> DataFrame:
    """The position of the last title at or before each element; `root` before the first."""
    return as_of(elements, keys, [idx], F.when(is_title, F.col(idx)), name, root)


def counters(titles: DataFrame, keys: list[str], idx: str, level: str, num: str, levels: int = 8) -> DataFrame:
    """Numbered ids from levels: a title sets its level's counter and resets deeper ones to 1.

    Levels that never change in the document are left out of the ids; a title without level has a
    null id. A fold over the document's titles, within the engine.
    """
    start = F.struct(F.array_repeat(F.lit(1), levels).alias("c"), F.array_repeat(F.lit(False), levels).alias("moved"), F.slice("rows", 1, 0).alias("done"), F.array().cast("array<array<int>>").alias("seen"))

    def step(s: Column, row: Column) -> Column:
        at = row[level]
        counted = F.transform(s["c"], lambda v, i: F.when(i < at, v).when(i == at, F.coalesce(row[num], v)).otherwise(1))
        moved = F.transform(s["moved"], lambda v, i: v | ((i == at) & row[num].isNotNull()))
        c = F.when(at.isNull(), s["c"]).otherwise(counted)
        m = F.when(at.isNull(), s["moved"]).otherwise(moved)
        path = F.when(at.isNull(), F.lit(None).cast("array<int>")).otherwise(F.slice(c, F.lit(1), at + 1))
        return F.struct(c.alias("c"), m.alias("moved"), F.array_append(s["done"], row).alias("done"), F.array_append(s["seen"], path).alias("seen"))

    rows = titles.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(idx, level, num))).alias("rows"))
    folded = rows.withColumn("f", F.aggregate("rows", start, step))
    ids = F.transform(F.arrays_zip(F.col("f.done").alias("row"), F.col("f.seen").alias("path")), lambda z: F.struct(z["row"][idx].alias(idx), F.array_join(F.filter(z["path"], lambda v, i: F.col("f.moved")[i]).cast("array<string>"), ".").alias("cid")))
    return folded.select(*keys, F.inline(ids)).withColumn("cid", F.when(F.col("cid") != "", F.col("cid")))


def tree(titles: DataFrame, keys: list[str], idx: str = "idx", text: str = "text") -> DataFrame:
    """(keys, idx, cid, parent_cid, depth): chapter tree of titles with rule, numeral type and num.

    A title joins the nearest ancestor level whose last child follows the same rule with a number one
    or two less; otherwise it opens a level below the title before it. Deeper than DEEPEST is dropped.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        nodes: list[dict] = [{"parent": None, "children": [], "depth": 0}]
        for row in pdf.sort_values(idx).itertuples(index=False):
            rule, num = getattr(row, "rule"), getattr(row, "num")
            parent = None
            if len(nodes) == 1:
                parent = 0
            else:
                at = nodes[-1]["parent"]
                while at is not None:
                    last = nodes[nodes[at]["children"][-1]] if nodes[at]["children"] else None
                    if last and last["rule"] == rule and num - last["num"] in (1, 2):
                        parent = at
                        break
                    at = nodes[at]["parent"]
                parent = len(nodes) - 1 if parent is None else parent
            nodes[parent]["children"].append(len(nodes))
            nodes.append({"parent": parent, "children": [], "depth": nodes[parent]["depth"] + 1, "rule": rule, "num": num, "idx": getattr(row, idx)})
        out, open_ = [], [(c, "1", str(k)) for k, c in reversed(list(enumerate(nodes[0]["children"], 1)))]
        while open_:
            n, above, place = open_.pop()
            cid = f"{above}.{place}"
            if nodes[n]["depth"] < DEEPEST:
                out.append((*key, nodes[n]["idx"], cid, above, nodes[n]["depth"]))
                open_ += [(c, cid, str(k)) for k, c in reversed(list(enumerate(nodes[n]["children"], 1)))]
        return pd.DataFrame(out, columns=[*keys, idx, "cid", "parent_cid", "depth"])

    types = dict(titles.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in [*keys, idx]) + ", cid string, parent_cid string, depth int"
    usable = titles.where("rule is not null and num is not null").select(*keys, idx, "rule", "num")
    return usable.groupBy(*keys).applyInPandas(run, schema)


def sentence_numbers(elements: DataFrame, keys: list[str], idx: str, sentences: str) -> DataFrame:
    """pid and sid within each key: one per element, and the number of sentences up to it."""
    w = Window.partitionBy(*keys).orderBy(idx)
    before = F.coalesce(F.sum(sentences).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return elements.withColumn("pid", F.row_number().over(w)).withColumn("sid", before.cast("long"))
