"""Sources: tables, texts, tagged texts, dictionaries, page ranges, binary files and a layout made from texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def page_range(pages: DataFrame, ranges: str, page: str = "page_no") -> DataFrame:
    """Pages named by ranges such as '1-3,7'; the filter reaches the scan."""
    wanted = F.lit(False)
    for part in ranges.split(","):
        lo, _, hi = part.strip().partition("-")
        wanted = wanted | F.col(page).between(int(lo), int(hi or lo))
    return pages.where(wanted)


def running_doctop(pages: DataFrame) -> DataFrame:
    """Pages with the height of all pages before them in the document."""
    w = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("doctop", F.coalesce(F.sum("height").over(w), F.lit(0.0)))


def binary_files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """(path, modificationTime, length, content) of the files of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)


def tagged_text(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Elements of texts with cells 'r0,c0,r1,c1|value' between <table> and </table> lines.

    (id, idx, type, text, table_no, r0, c0, r1, c1); cell columns are null in text rows.
    """
    lines = texts.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("idx", "line"))
    w = Window.partitionBy(id_col).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    opened, closed = F.sum((F.col("line") == "<table>").cast("int")).over(w), F.sum((F.col("line") == "</table>").cast("int")).over(w)
    marked = lines.withColumn("table_no", opened).withColumn("_in", opened > closed).where("line not in ('<table>', '</table>')")
    cell = [F.when(F.col("_in"), F.regexp_extract("line", r"^(\d+),(\d+),(\d+),(\d+)\|", k).try_cast("int")).alias(n) for k, n in enumerate(("r0", "c0", "r1", "c1"), 1)]
    text = F.when(F.col("_in"), F.regexp_replace("line", r"^\d+,\d+,\d+,\d+\|", "")).otherwise(F.col("line"))
    return marked.select(id_col, "idx", F.when(F.col("_in"), "cell").otherwise("text").alias("type"), text.alias("text"), F.when(F.col("_in"), F.col("table_no")).alias("table_no"), *cell)


def dictionary(spark: SparkSession, path: str, space: bool = True) -> DataFrame:
    """(index, symbol) of a file with one symbol a line; 0 is the blank, a space may come last."""
    lines = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id())
    ranked = lines.withColumn("index", F.row_number().over(Window.orderBy("_at"))).select("index", F.col("value").alias("symbol"))  # a symbol list is small
    extra = [(0, "")] + ([(-1, " ")] if space else [])
    out = ranked.unionByName(spark.createDataFrame(extra, "index int, symbol string"))
    size = ranked.count()
    return out.withColumn("index", F.when(F.col("index") == -1, size + 1).otherwise(F.col("index")))


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def delimited(spark: SparkSession, path: str, schema: str, separator: str = "\t") -> DataFrame:
    return spark.read.schema(schema).option("sep", separator).option("mode", "DROPMALFORMED").csv(path)


def word_layout(docs: DataFrame, char_width: int = 10, line_height: int = 12, lines_a_page: int = 50) -> DataFrame:
    """Monospaced boxes of the words of texts: a page has 50 lines, a word stands where its characters do.

    Words are dealt out by page once, so that what follows by page needs no shuffle of its own.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    pages = lines.withColumn("page_no", F.floor(F.col("line_no") / lines_a_page).cast("int")).repartition("doc_id", "page_no")
    words = pages.select("doc_id", "page_no", "line_no", F.posexplode(F.split("line", " ")).alias("word_no", "text"))
    w = Window.partitionBy("doc_id", "page_no", "line_no").orderBy("word_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0))
    top = F.pmod("line_no", F.lit(lines_a_page)) * line_height
    placed = words.withColumn("x0", start * char_width).where("text <> ''")
    return placed.select("doc_id", "page_no", "line_no", "word_no", "text", "x0", (F.col("x0") + F.length("text") * char_width).alias("x1"), top.alias("top"), (top + 10).alias("bottom"))


def order_boxes(lineitem: DataFrame) -> DataFrame:
    """Boxes made from order lines, one image for each order; for checks on the driver's tables."""
    x0, y0 = F.col("l_partkey") % 60, F.col("l_suppkey") % 40
    return lineitem.select(
        F.col("l_orderkey").alias("image_id"), ((F.col("l_partkey") * 1000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")).alias("box_id"), F.col("l_returnflag").alias("label"), F.col("l_linestatus").alias("side"), F.col("l_extendedprice").alias("score"),
        x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + 5 + F.col("l_quantity")).alias("x1"), (y0 + 5 + F.col("l_partkey") % 17).cast("double").alias("y1"))
