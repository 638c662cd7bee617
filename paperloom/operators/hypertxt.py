"""Document views, scopes, nesting and rendering of exploded elements (doc_id, idx, type, text, pid, sid, cid)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import heading_depth, html_escaped

GRANULARITIES = ("title", "sentence", "paragraph", "segment", "table", "document")


def joined(df: DataFrame, keys: list[str], order: list[str], text: str = "text", separator: str = "") -> DataFrame:
    """Texts of each key put together in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda x: x[text])
    return df.groupBy(*keys).agg(F.array_join(parts, separator).alias(text), F.count(F.lit(1)).alias("n_parts"))


def view(elements: DataFrame, granularity: str) -> DataFrame:
    """(doc_id, key, text) at a granularity; segments are the paragraphs between tables."""
    if granularity not in GRANULARITIES:
        raise ValueError(f"granularity is one of {GRANULARITIES}")
    if granularity in ("title", "table", "sentence"):
        kind = {"title": "title", "table": "table", "sentence": "text"}[granularity]
        return elements.where(F.col("type") == kind).select("doc_id", F.col("idx").alias("key"), "text")
    if granularity == "document":
        return joined(elements.where("type <> 'table'"), ["doc_id"], ["idx"], separator="\n").select("doc_id", F.lit(0).alias("key"), "text")
    if granularity == "paragraph":
        return joined(elements.where("type = 'text'"), ["doc_id", "pid"], ["idx"]).select("doc_id", F.col("pid").alias("key"), "text")
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    runs = elements.withColumn("key", F.sum((F.col("type") == "table").cast("int")).over(w)).where("type = 'text'")
    paragraphs = joined(runs, ["doc_id", "key", "pid"], ["idx"])
    return joined(paragraphs, ["doc_id", "key"], ["pid"], separator="\n").select("doc_id", "key", "text")


def scope(elements: DataFrame, include: list, exclude: list | None = None, key: str = "idx") -> DataFrame:
    """Elements whose key is in a scope and not in an exclusion."""
    out = elements.where(F.col(key).isin(include))
    return out.where(~F.col(key).isin(exclude)) if exclude else out


def in_scope(elements: DataFrame, include: DataFrame, exclude: DataFrame | None = None, keys: tuple[str, ...] = ("doc_id", "idx")) -> DataFrame:
    """Elements whose keys stand in one table of keys and not in another; null keys match nothing. Tables of any size."""
    on = list(keys)
    out = elements.join(include.select(*on).distinct(), on, "left_semi")
    return out if exclude is None else out.join(exclude.select(*on).distinct(), on, "left_anti")


def text_of(elements: DataFrame, granularity: str, keys: DataFrame) -> DataFrame:
    """(doc_id, key, text) of the asked (doc_id, key) at a granularity; the empty text where there is none."""
    found = keys.select("doc_id", "key").distinct().join(view(elements, granularity), ["doc_id", "key"], "left")
    return found.withColumn("text", F.coalesce("text", F.lit("")))


def with_ids(texts: DataFrame, known: DataFrame) -> DataFrame:
    """Texts of documents with their known gid; unknown ones are numbered after the largest known."""
    most = known.groupBy("doc_id").agg(F.max("gid").alias("_most"))
    found = texts.select("doc_id", "text").distinct().join(known, ["doc_id", "text"], "left").join(most, "doc_id", "left")
    fresh = F.row_number().over(Window.partitionBy("doc_id", F.col("gid").isNull()).orderBy("text"))
    return found.withColumn("gid", F.coalesce("gid", F.coalesce("_most", F.lit(-1)) + fresh)).drop("_most")


def nested(elements: DataFrame) -> DataFrame:
    """One row for each document: its chapters map and its elements in order."""
    row = F.struct("idx", "type", "text", "pid", "sid", "cid")
    chapters = F.map_from_entries(F.array_sort(F.collect_list(F.when((F.col("type") == "title") & F.col("cid").isNotNull(), F.struct("cid", "text")))))
    latest = F.row_number().over(Window.partitionBy("doc_id", "cid", "type").orderBy(F.desc("idx")))
    kept = elements.withColumn("_n", latest)
    titles = kept.where("type = 'title' and _n = 1").groupBy("doc_id").agg(chapters.alias("chapters"))
    return elements.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("context")).join(titles, "doc_id", "left")


def markdown_line(kind: Column, text: Column, cid: Column) -> Column:
    """An element as Markdown: headings by depth, formulas in dollars, tables as they are."""
    head = F.concat(F.repeat(F.lit("#"), heading_depth(cid)), F.lit(" "), html_escaped(text))
    return F.when(kind == "title", head).when(kind == "formula", F.concat(F.lit("$"), text, F.lit("$"))).when(kind == "table", text).otherwise(html_escaped(text))


def to_markdown(elements: DataFrame) -> DataFrame:
    lines = elements.withColumn("md", markdown_line(F.col("type"), F.col("text"), F.coalesce("cid", F.lit("1"))))
    return joined(lines, ["doc_id"], ["idx"], "md", "\n\n").select("doc_id", F.col("md").alias("markdown"))


def merged_scopes(scopes: DataFrame, keys: list[str], view: str = "view", values: str = "values") -> DataFrame:
    """The sorted distinct values of several scopes for each view."""
    return scopes.select(*keys, view, F.explode(values).alias("_v")).groupBy(*keys, view).agg(F.array_sort(F.collect_set("_v")).alias(values))


def with_title(context: DataFrame, titles: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, idx, sid, pid, type, text) with each title as the text of the first element with sid 0, or as an element before all others where there is none.

    titles: one row (id, title) a document, of documents without elements too.
    """
    fields = ["idx", "sid", "pid", "type", "text"]
    heads = context.groupBy(id_col).agg(F.min(F.when(F.col("sid") == 0, F.col("idx"))).alias("_head"), F.min("idx").alias("_first"))
    rows = context.join(heads.join(titles, id_col), id_col, "left")
    text = F.when((F.col("idx") == F.col("_head")) & F.col("title").isNotNull(), F.col("title")).otherwise(F.col("text"))
    kept = rows.select(id_col, *[text.alias("text") if c == "text" else F.col(c) for c in fields])
    added = titles.join(heads, id_col, "left").where("_head is null and title is not null").select(id_col, F.coalesce(F.col("_first") - 1, F.lit(0)).cast(dict(context.dtypes)["idx"]).alias("idx"), F.lit(0).alias("sid"), F.lit(0).alias("pid"), F.lit("title").alias("type"), F.col("title").alias("text"))
    return kept.unionByName(added)


def nested_tables(docs: DataFrame, id_col: str = "doc_id", nested: str = "nested_tables") -> DataFrame:
    """(id, key, table_id, table) of a map whose keys begin with the number of the outer table and a bar."""
    return docs.select(id_col, F.explode(nested).alias("key", "table")).select(id_col, "key", F.split_part("key", F.lit("|"), F.lit(1)).try_cast("int").alias("table_id"), "table")
