"""Core operators: golden values, invariants, and queries against SQL on the smallest tables."""

import random
import sys
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from paperloom import queries as Q
from paperloom.functions import geometry as G
from paperloom.functions import text as T
from paperloom.operators import boxes, chapters, hypertxt, metrics, ordered, paragraphs, tables
from paperloom.plans import plugins
from paperloom.sources import readers, sinks
from paperloom.streaming import flows
from tools.compare import normal

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got, want = Q.QUERIES[name](spark, SF).toPandas(), duck.execute(Q.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_sentences(spark):
    row = spark.createDataFrame([("他说：“好。”然后走了。真的!？是吗",)], "t string").select(T.sentences(F.col("t"), "zh").alias("s")).first()
    assert row.s == ["他说：“好。”然后走了。", "真的!", "？", "是吗"]
    long = spark.createDataFrame([("a" * 1200, None)], "t string, n string").select(T.sentences(F.col("t")).alias("s"), T.sentences(F.col("n")).alias("z")).first()
    assert [len(x) for x in long.s] == [510, 510, 180] and long.z is None


def test_chinese_numerals(spark):
    values = {"十": 10, "十二": 12, "二十": 20, "三十五": 35, "一百零三": 103, "二千": 2000, "七": 7, "a": None, "": None}
    rows = spark.createDataFrame([(k,) for k in values], "t string").select("t", T.chinese_number(F.col("t")).alias("v")).collect()
    assert {r.t: r.v for r in rows} == values
    sizes = Q.chinese_numerals(spark, SF)
    assert sizes.where("value is null or value <> p_size").count() == 0


def test_nms_is_a_fixpoint_and_agrees_with_a_loop(spark):
    rng = random.Random(0)
    rows = [(k % 5, k, rng.choice("ab"), float(rng.randint(1, 20)), *(lambda x, y: (x, y, x + rng.randint(3, 20), y + rng.randint(3, 20)))(float(rng.randint(0, 30)), float(rng.randint(0, 30)))) for k in range(200)]
    df = spark.createDataFrame(rows, "image_id int, box_id int, label string, score double, x0 double, y0 double, x1 double, y1 double")

    def iou(a, b):
        w, h = min(a[6], b[6]) - max(a[4], b[4]), min(a[7], b[7]) - max(a[5], b[5])
        i = max(w, 0) * max(h, 0)
        return i / ((a[6] - a[4]) * (a[7] - a[5]) + (b[6] - b[4]) * (b[7] - b[5]) - i)

    kept = []
    for r in sorted(rows, key=lambda r: (-r[3], r[1])):
        if not any(k[0] == r[0] and k[2] == r[2] and round(iou(k, r), 6) >= 0.2 for k in kept):
            kept.append(r)
    once = boxes.nms(df, ["image_id"], 0.2)
    assert {r.box_id for r in once.collect()} == {r[1] for r in kept}
    assert boxes.nms(once, ["image_id"], 0.2).count() == len(kept)


def test_reading_order_of_clear_lines(spark):
    lines = [[11, 12, 13, 14], [21, 22, 23], [31], [41, 42]]
    rows = [(1, b, 20.0 * k, 30.0 * i + k % 2, 20.0 * k + 15, 30.0 * i + 20 + k % 2) for i, line in enumerate(lines) for k, b in enumerate(line)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "image_id int, box_id int, x0 double, y0 double, x1 double, y1 double")
    got = boxes.reading_order(df, ["image_id"]).orderBy("line_no", "place").groupBy("line_no").agg(F.collect_list("box_id").alias("b")).orderBy("line_no").collect()
    assert [r.b for r in got] == lines


def test_heading_rules(spark):
    want = {"第三部分 总则": ("portion", 3), "目录": ("contents", None), "重大风险提示": ("notice", None), "附件二": ("attachment", 2), "3．范围": ("list", 3), "三）范围": ("half_paren_cn", 3), "十二 范围": ("space_cn", 12), "营销背景说明": ("customized", None), "第二章 x": ("part", 2), "一、x": ("list_cn", 1), "一起": (None, None), "": (None, None), None: (None, None)}
    got = chapters.titled(spark.createDataFrame([(t,) for t in want], "text string")).collect()
    assert {r.text: (r.rule_name, r.num) for r in got} == want


def test_geometry_of_degenerate_boxes(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 2.0, 2.0, 2.0, 0.0, 4.0, 2.0)], "ax0 double, ay0 double, ax1 double, ay1 double, bx0 double, by0 double, bx1 double, by1 double")
    a, b = (G.box(names=tuple(f"{p}{n}" for n in ("x0", "y0", "x1", "y1"))) for p in "ab")
    assert [tuple(r) for r in df.select(G.iou(a, b), G.touches(a, b), G.share_of(a, b)).collect()] == [(0.0, False, 0.0), (0.0, True, 0.0)]


def test_chapter_tree_and_counters(spark):
    texts = ["Chapter 1", "1. A", "2. B", "(1) x", "(2) y", "3. C", "Chapter 2", "1. D", "第三章 E", "plain"]
    df = chapters.titled(spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id int, idx int, text string"))
    tree = {r.idx: r.cid for r in chapters.tree(df, ["doc_id"]).collect()}
    assert tree == {0: "1.1", 1: "1.1.1", 2: "1.1.2", 3: "1.1.2.1", 4: "1.1.2.2", 5: "1.1.3", 6: "1.2", 7: "1.2.1", 8: "1.2.1.1"}
    level = F.when(F.col("rule_name") == "chapter", 0).when(F.col("rule_name") == "list", 1).when(F.col("rule_name") == "paren", 3)
    ids = chapters.counters(df.where("rule is not null").withColumn("level", level), ["doc_id"], "idx", "level", "num").collect()
    assert {r.idx: r.cid for r in ids} == {0: "1", 1: "1.1", 2: "1.2", 3: "1.2.1", 4: "1.2.2", 5: "1.3", 6: "2", 7: "2.1", 8: None}


def test_tables(spark):
    cells = spark.createDataFrame([(1, 0, 0, 1, 2, "head"), (1, 1, 0, 2, 1, "a"), (1, 1, 1, 2, 2, "b")], "table_id int, r0 int, c0 int, r1 int, c1 int, text string")
    assert tables.to_html(cells, ["table_id"]).first().html == '<table><tr><td colspan="2">head</td></tr><tr><td>a</td><td>b</td></tr></table>'
    assert tables.to_markdown(cells, ["table_id"]).first().markdown == "| head | head |\n| --- | --- |\n| a | b |"
    both = tables.stacked(cells, cells, ["table_id"]).collect()
    assert sorted((r.r0, r.text) for r in both) == [(0, "head"), (1, "a"), (1, "b"), (2, "a"), (2, "b")]
    shapes = spark.createDataFrame([(1, 0.0, 0.0, 9.0, 5.0), (1, 0.0, 5.0, 4.0, 9.0), (1, 4.0, 5.0, 9.0, 9.0)], "t int, x0 double, y0 double, x1 double, y1 double")
    grid = {(r.r0, r.c0, r.r1, r.c1) for r in tables.grid(shapes, ["t"]).collect()}
    assert grid == {(0, 0, 1, 2), (1, 0, 2, 1), (1, 1, 2, 2)}


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(0)
    for _ in range(60):
        cost = rng.random((rng.integers(1, 6), rng.integers(1, 6)))
        n, m = cost.shape
        best = min(sum(cost[r, c] for r, c in zip(range(n), p)) for p in permutations(range(m), n)) if n <= m else min(sum(cost[r, c] for c, r in zip(range(m), p)) for p in permutations(range(n), m))
        pairs = metrics.assignment(cost)
        assert len(pairs) == min(n, m) and abs(sum(cost[p] for p in pairs) - best) < 1e-9


def test_text_matching_and_tree_distance(spark):
    a = spark.createDataFrame([(1, 1, "hello world"), (1, 2, "abc")], "g int, id int, text string")
    b = spark.createDataFrame([(1, 7, "hello worl"), (1, 8, "zzz")], "g int, id int, text string")
    assert [(r.left_id, r.right_id) for r in metrics.matched_texts(a, b, ["g"]).collect()] == [(1, 7)]
    leaf = lambda x, *c: (x, list(c))
    differ = lambda x, y: float(x != y)
    assert metrics.tree_distance(leaf("a", leaf("b"), leaf("c")), leaf("a", leaf("b", leaf("d")), leaf("e")), differ) == 2.0
    assert metrics.tree_distance(leaf("a"), leaf("a"), differ) == 0.0


def test_paragraphs():
    line = lambda t, k, x1=100.0, title=False, size=10.0: paragraphs.Line(t, 0.0, x1, 12.0 * k, 12.0 * k + 10, size, title)
    got = paragraphs.paragraphs([line("第一章", 0, 30.0, True), line("甲乙丙丁", 1), line("戊己。", 2, 40.0), line("庚辛（壬。", 3), line("癸）子", 4, 60.0), line("丑寅", 5, 20.0)], 100.0)
    assert "".join(got) == "第一章甲乙丙丁戊己。庚辛（壬。癸）子丑寅" and got[:2] == ["第一章", "甲乙丙丁戊己。"]


def test_views_and_scope(spark):
    rows = [(1, 0, "title", "T", 0, "1"), (1, 1, "text", "a", 1, None), (1, 2, "text", "b", 1, None), (1, 3, "table", "x", 2, None), (1, 4, "text", "c", 3, None)]
    e = spark.createDataFrame([(d, i, k, t, p, p, c) for d, i, k, t, p, c in rows], "doc_id int, idx int, type string, text string, pid int, sid int, cid string")
    assert sorted(r.text for r in hypertxt.view(e, "segment").collect()) == ["ab", "c"]
    assert hypertxt.view(e, "document").first().text == "T\na\nb\nc"
    assert hypertxt.scope(e, [1, 2, 3], [2]).count() == 2
    assert hypertxt.nested(e).first().chapters == {"1": "T"}
    with pytest.raises(ValueError):
        hypertxt.view(e, "sentences")


def test_clusters(spark):
    df = spark.createDataFrame([(1, v) for v in (1.0, 2.0, 2.5, 9.0, 9.5, 20.0)], "k int, v double")
    assert ordered.tolerance_clusters(df, ["k"], "v", 1.0).groupBy("cluster").count().orderBy("cluster").toPandas()["count"].tolist() == [3, 2, 1]
    spans = spark.createDataFrame([(1, 0.0, 10.0), (1, 2.0, 3.0), (1, 11.0, 12.0), (1, 20.0, 21.0)], "k int, a double, b double")
    assert sorted((r.a, r.b) for r in ordered.merged_intervals(spans, ["k"], "a", "b", 1.0).collect()) == [(0.0, 12.0), (20.0, 21.0)]


def test_sources_and_sinks(spark, tmp_path):
    t = readers.tagged_text(spark.createDataFrame([(1, "intro\n<table>\n0,0,1,2|head\n1,0,2,1|a\n</table>\nend")], "doc_id int, text string"))
    assert [(r.type, r.text, r.c1) for r in t.orderBy("idx").collect()] == [("text", "intro", None), ("cell", "head", 2), ("cell", "a", 1), ("text", "end", None)]
    (tmp_path / "d.txt").write_text("a\nb\n")
    assert {r["index"]: r.symbol for r in readers.dictionary(spark, str(tmp_path / "d.txt")).collect()} == {0: "", 1: "a", 2: "b", 3: " "}
    df = spark.createDataFrame([(1, 0.123456, bytearray(b"x"), [1])], "b int, a double, c binary, d array<int>")
    assert df.select(sinks.json_text(df)).first()[0] == '{"b":1,"a":0.1235,"c":"eA==","d":[1]}'
    assert sinks.flat_columns(df, ("c",)) == ["c", "a", "b"]
    sinks.write_csv(df.drop("c"), str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).columns == ["a", "b"]
    pages = spark.createDataFrame([(1, p, 10.0) for p in range(1, 9)], "doc_id int, page_no int, height double")
    assert readers.page_range(pages, "1-2,5").count() == 3 and readers.running_doctop(pages).agg(F.max("doctop")).first()[0] == 70.0


def test_stream_gives_the_batch_rows(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    out = flows.tumbling(flows.stream(spark, str(tmp_path / "in"), events.schema), late="400 days")
    out.writeStream.outputMode("complete").format("memory").queryName("t_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert normal(spark.table("t_out").toPandas()) == normal(flows.tumbling(events).toPandas())


def test_plugins(spark):
    plugins.MODELS.add("double", lambda: lambda frame: pd.DataFrame({"x": frame["id"] * 2}))
    assert sorted(r.x for r in plugins.infer(spark.range(3), "double", "x long").collect()) == [0, 2, 4]
    with pytest.raises(KeyError):
        plugins.CUTTERS.get("none")
    assert plugins.options("high", merge_tables=False).keep_headers


def test_entry_works_without_the_training_data_modules(tmp_path):
    """In a copy without them, also with the caches that Python leaves behind."""
    import shutil
    import subprocess

    top = Path(__file__).resolve().parents[1]
    shutil.copytree(top / "paperloom", tmp_path / "paperloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and e.oracle_sql() and not [n for n in q if n.startswith(('op1', 'op2', 'pipeline'))]"
    for left in (False, True):
        if left:
            (tmp_path / "paperloom" / "llm" / "__pycache__").mkdir(parents=True)
        subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_edit_distance_matches_brute_force(spark):
    rng = random.Random(12)
    texts = ["", "é", "th" * 50] + ["".join(rng.choice("abt\U0001f600") for _ in range(rng.choice([1, 5, 70, 130]))) for _ in range(30)]
    for a in texts:
        for b in texts:
            assert T.edit_distance(a, b) == brute_distance(a, b)
    pairs = spark.createDataFrame([(a, b) for a in texts[:8] for b in texts[:8]] + [(None, "a"), ("a", None)], "a string, b string")
    both = pairs.select(T.similarity(F.col("a"), F.col("b")).alias("x"), T.whole_similarity(F.col("a"), F.col("b")).alias("y")).collect()
    assert [r.x for r in both] == [r.y for r in both]


def test_whole_queries_read_texts_to_their_end(spark, tmp_path):
    rng = random.Random(13)
    texts = [None, "", "e" * 70, "ab " * 30 + "the thin, then é\U0001f600\U0001f600\n\n", "e" * 900 + "b"] + ["".join(rng.choice("abeth \n") for _ in range(rng.choice([10, 90, 400]))) for _ in range(20)]
    rows = [(i, t, "en" if i % 3 else None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, t in enumerate(texts):
        if t:
            kept = "".join(c for k, c in enumerate(t) if k == 0 or c != t[k - 1])
            want[i] = kept.replace("e", "")
    assert {r.doc_id: r.label for r in Q.ctc_collapse(spark, str(tmp_path)).collect()} == want
    sums = {}
    for _, t, lang in rows:
        a = "".join(c for c in t or "" if " " <= c <= "~")
        p, g = a.replace(" ", ""), a.replace("th", "t").replace(" ", "")
        n, same, like = sums.get(lang, (0, 0, 0.0))
        sums[lang] = n + 1, same + (p == g), like + 1 - brute_distance(p, g) / max(1, len(p), len(g))
    got = {r.lang: r for r in Q.ocr_accuracy(spark, str(tmp_path)).collect()}
    assert {k: r.n for k, r in got.items()} == {k: n for k, (n, _, _) in sums.items()}
    assert all(abs(got[k].accuracy - same / n) < 2e-6 and abs(got[k].similarity - like / n) < 2e-6 for k, (n, same, like) in sums.items())


def test_components_fail_rather_than_stop_early(spark):
    nodes = spark.createDataFrame([(0, i) for i in range(40)], "image_id int, id int")
    edges = spark.createDataFrame([(0, i, i + 1) for i in range(39)], "image_id int, a int, b int")
    with pytest.raises(RuntimeError):
        boxes.components(edges, nodes, ["image_id"], rounds=2).collect()
    assert {r.component for r in boxes.components(edges, nodes, ["image_id"]).collect()} == {0}


def test_box_components_in_one_shuffle(spark, tmp_path):
    """Chains over Arrow batches, boxes that share an id, a box without an image."""
    rng = random.Random(3)
    rows = [(k % 9 if k % 9 < 8 else None, rng.randint(1, 90), rng.randint(0, 60), k % 3, float(rng.randint(1, 50)), 1.0, "A", "O") for k in range(300)]
    rows += [(20, 5, 1007, 1, 9.0, 1.0, "A", "O"), (20, 6, 7, 1, 9.0, 1.0, "A", "O"), (None, 5, 7, 1, 9.0, 1.0, "A", "O"), (None, 5, 7, 1, 9.0, 1.0, "A", "O")]
    names = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"]
    pd.DataFrame(rows, columns=names).astype({"l_orderkey": "Int64"}).to_parquet(tmp_path / "lineitem.parquet", index=False)
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    most = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        got = Q.box_components(spark, str(tmp_path))
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
        assert normal(got.toPandas()) == normal(con.execute(Q.ORACLES["box_components"]).df())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)


def test_average_precision_of_ranges(spark, tmp_path, monkeypatch):
    """Many ranges, equal and null scores, repeated rows; no frame that looks ahead from every row."""
    monkeypatch.setattr(metrics, "RANGED_ROWS", 50, raising=False)
    rng = random.Random(5)
    rows = [(rng.randint(1, 40), rng.randint(1, 200), rng.randint(0, 60), k % 3, 2.0, rng.choice([None, *(float(x) for x in range(1, 150))]), "AN"[k % 20 == 0], "O") for k in range(900)]
    names = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"]
    pd.DataFrame(rows + rows[:30], columns=names).to_parquet(tmp_path / "lineitem.parquet", index=False)
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    got = Q.ap_per_class(spark, str(tmp_path))
    assert "currentrow$(), unboundedfollowing$()" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert normal(got.toPandas()) == normal(con.execute(Q.ORACLES["ap_per_class"]).df())


def test_rule_hits_of_odd_headings_match_sql(spark, tmp_path):
    """Dotted numbers of four parts, Chinese and full-width headings, blanks that only one engine knows."""
    odd = ["10.0.0.1 x", "1.2.3.", "1.2.34567", "1.2.3.4.5", "192.168.1", "3.14.x", "3．范围", "第二章 x", "一、x", "目录", "附件二", "三）范围", "（三）x", "(4) y", "5) z", "6 、 z", "7\x0b. z", "A\x0b. z", "A . z", "b\f) z", "Chapter\x0b3", "Chapter  4", "Chapter4", "É. z", "٣. z", "1.", "1" * 39 + ".", "1" * 38 + ".", "", "9.\r", "x。y"]
    pd.DataFrame({"doc_id": [1, 2, 3], "text": ["\n".join(f"{a}\n" * 4 + "-" for a in odd), "h\n" + "\n".join(odd), None]}).to_parquet(tmp_path / "documents.parquet", index=False)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    assert normal(Q.chapter_rule_hits(spark, str(tmp_path)).toPandas()) == normal(con.execute(Q.ORACLES["chapter_rule_hits"]).df())


def test_equal_intervals_share_the_run_they_open(spark):
    df = spark.createDataFrame([(1, 0.0, 25.0), (1, 59.0, 91.0), (1, 59.0, 91.0)], "image_id int, x0 double, x1 double").repartition(3)
    assert sorted((r.x0, r.x1, r.n) for r in ordered.merged_intervals(df, ["image_id"], "x0", "x1", 3.0).collect()) == [(0.0, 25.0, 1), (59.0, 91.0, 2)]


def test_joined_edges_of_null_bounds_match_sql(spark, tmp_path):
    """Null bounds come last; equal intervals as the SQL has them on one thread (on more, its two sorts may order them differently)."""
    rng = random.Random(3)
    rows = [(k, p, 1, i, q, 1.0, "A", "O") for i, (k, p, q) in enumerate([(1, 0, 1.0), (1, 20, None), (1, 20, 2.0), (1, None, 3.0), (2, 30, 1.0), (2, 0, 1.0), (2, 30, 1.0), (None, None, None), *((rng.randint(3, 60), rng.choice([None, *range(60)]), rng.choice([None, 1.0, 5.0, float("nan")])) for _ in range(400))])]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    got = normal(Q.edge_join(spark, str(tmp_path)).toPandas())
    assert got == normal(con.execute(Q.ORACLES["edge_join"]).df())
    assert ("1.000000", "3.000000", "1.000000", "20.000000", "27.000000") in got
