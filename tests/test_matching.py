"""Order-dependent matches and folds: hand-made cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom import page_queries as Q
from paperloom.functions import text as T
from paperloom.operators import boxes as B
from paperloom.operators import matching as A
from paperloom.operators import tables as TB
from paperloom.plans import plugins

SF = "/root/testdata/sf0.001"
BOX = "image_id int, box_id int, x0 double, y0 double, x1 double, y1 double"


def boxes(spark, rows, image=1):
    return spark.createDataFrame([(image, i, *map(float, b)) for i, b in enumerate(rows)], BOX)


def sides(df):
    return {r.box_id: (r.x0, r.y0, r.x1, r.y1) for r in df.collect()}


def test_match_shares():
    assert A.match_shares(np.array([[0.9, 0.0]]), np.array([[0.8, 0.0]])) == (1.0, 1.0)
    assert A.match_shares(np.array([[0.5, 0.45]]), np.array([[0.95, 0.9]])) == pytest.approx((0.8, 1.6))
    assert A.match_shares(np.array([[0.95], [0.9]]), np.array([[0.45], [0.5]])) == pytest.approx((1.6, 0.8))
    assert A.match_shares(np.array([[0.2]]), np.array([[0.2]])) == (0.0, 0.0)


def test_detection_matches_of_an_image(spark):
    df = boxes(spark, [(0, 0, 10, 10), (20, 0, 40, 10), (0, 0, 10, 9), (20, 0, 30, 10), (30, 0, 40, 10), (60, 60, 70, 70)])
    r = A.detection_matches(df, ["image_id"], F.col("box_id") < 2).first()
    assert (r.n_truth, r.n_found, r.recall_sum, r.precision_sum) == (2, 4, 1.8, pytest.approx(2.6))


def test_polygons():
    square = lambda x, y, n: np.array([(x, y), (x + n, y), (x + n, y + n), (x, y + n)], float)
    assert A.polygon_iou(square(0, 0, 2), square(1, 0, 2)) == pytest.approx(1 / 3)
    assert A.polygon_iou(square(0, 0, 2)[::-1], square(1, 1, 2)) == pytest.approx(1 / 7)
    assert A.polygon_iou(square(0, 0, 1), square(5, 5, 1)) == 0.0
    diamond = np.array([(0, -1), (1, 0), (0, 1), (-1, 0)], float)
    assert A.polygon_iou(diamond, square(-1, -1, 2)) == pytest.approx(0.5)
    rng = random.Random(2)
    for _ in range(30):
        a, b = ((rng.uniform(0, 5), rng.uniform(0, 5), rng.uniform(1, 5)) for _ in range(2))
        i = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0, min(a[1] + a[2], b[1] + b[2]) - max(a[1], b[1]))
        assert A.polygon_iou(square(*a), square(*b)) == pytest.approx(i / (a[2] ** 2 + b[2] ** 2 - i))


def test_stacks_and_growth(spark):
    df = boxes(spark, [(0, 0, 50, 30), (0, 15, 50, 60), (0, 58, 50, 90), (80, 0, 99, 30)])
    assert sides(A.merged_stacks(df, ["image_id"])) == {0: (0, 0, 50, 60), 2: (0, 58, 50, 90), 3: (80, 0, 99, 30)}
    df = boxes(spark, [(20, 20, 40, 30), (43, 20, 60, 30), (45, 25, 58, 40)])
    assert sides(A.roomier(df, ["image_id"], 5.0, 100.0, 100.0)) == {0: (15, 15, 40, 35), 1: (43, 20, 60, 30), 2: (45, 25, 58, 40)}
    df = boxes(spark, [(20, 20, 40, 40), (42, 20, 60, 40), (5, 60, 10, 80)])
    got = sides(A.wider(df, ["image_id"], 100.0, F.col("box_id") != 1))
    assert got == {0: (20, 20, 40, 40), 1: (42, 20, 60, 40), 2: (1, 60, 14, 80)}
    df = boxes(spark, [(0, 0, 30, 10), (2, 12, 30, 22), (60, 0, 90, 10), (0, 60, 30, 70)])
    assert sorted((r.stack, r.place, r.box_id) for r in A.stacks(df, ["image_id"]).collect()) == [(0, 0, 0), (0, 1, 1), (1, 0, 2), (2, 0, 3)]


def test_collated_lines(spark):
    row = [("a", 0, 5), ("b", 5, 10), ("b", 5.3, 10), ("c", 20, 25), (" ", 26, 30), ("d", 80, 85)]
    df = spark.createDataFrame([(1, k, t, float(x0), float(x1), 0.0, 10.0) for k, (t, x0, x1) in enumerate(row)], "p int, char_no int, text string, x0 double, x1 double, top double, size double")
    assert [(r.line, r.text) for r in A.collated_lines(df, ["p"]).collect()] == [(0, "ab c"), (1, "d")]
    assert A.collated_lines(df.where("text = ' '"), ["p"]).count() == 0


def test_table_columns(spark):
    up, down = [(0, 2), (2, 4), (4, 7), (7, 8), (9, 11)], [(0, 3), (3, 5), (5, 6), (6, 8), (9, 10)]
    a, b = A.columns_by_rule(up, down)
    assert [x[1] for x in a] == [x[1] for x in b] and a[:4] == b[:4] == [(0, 3), (3, 5), (5, 8), (8, 10)]
    assert A.columns_by_place([0, 50, 100], [2, 30, 52, 99]) == ([0, 2, 3], [0, 1, 2, 3])
    df = spark.createDataFrame([(1, [0.0, 50.0], [1.0, 20.0, 53.0])], "t int, u array<double>, v array<double>")
    assert tuple(A.paired_tables(df, ["t"], "u", "v").first()) == (1, [0, 2], [0, 1, 2])


def test_table_similarity():
    a = "<table><tr><td>ab</td><td colspan=2>c</td></tr></table>"
    assert A.table_similarity(a, a) == 1.0 and A.table_similarity(None, "") == 1.0 and A.table_similarity(a, "") == 0.0
    assert A.table_similarity(a, a.replace("ab", "ax")) == pytest.approx(1 - 0.5 / 4)
    assert A.table_similarity(a, a.replace("ab", "ax"), structure_only=True) == 1.0
    assert A.table_similarity(a, a.replace("colspan=2", "")) == pytest.approx(0.75)


def test_crossing_cells_and_exports(spark):
    rows = [(1, 0, 0, 1, 1, ""), (1, 0, 1, 1, 2, "x"), (1, 0, 2, 1, 3, "y"), (1, 1, 0, 2, 1, "a"), (1, 1, 1, 2, 2, "1,5"), (1, 1, 2, 2, 3, "2"), (1, 2, 0, 3, 3, "total"), (1, 3, 0, 4, 1, "b"), (1, 3, 1, 4, 3, "3")]
    cells = spark.createDataFrame(rows, "t int, r0 int, c0 int, r1 int, c1 int, text string")
    assert [r.cell for r in TB.crossing_cells(cells, ["t"], "a", "x").collect()] == ["1,5"]
    assert TB.crossing_cells(cells, ["t"], "b", "x").count() == 0
    assert TB.to_csv(cells, ["t"]).first().csv == ',x,y\na,"1,5",2\ntotal,total,total\nb,3,3'
    assert '<cell r0="1" c0="1" r1="2" c1="2">1,5</cell>' in TB.to_xml(cells, ["t"]).first().xml


def test_texts(spark):
    got = spark.createDataFrame([("目录\n第一章 总则......1\n第二章 很长的标题要\n换行....2\n12\n附 则...3",), (None,), ("",)], "t string").select(T.contents_headings(F.col("t"))).collect()
    assert [r[0] for r in got] == [["第一章总则", "第二章很长的标题要换行", "附则"], None, []]
    made = plugins.attempted(spark.createDataFrame([("1",), ("x",), (None,)], "t string"), "t", lambda v: str(int(v) + 1)).collect()
    assert [r.value for r in made] == ["2", None, None] and made[1].error.startswith("ValueError") and made[2].error.startswith("TypeError")
    assert spark.range(1).select(plugins.first_answer(F.lit(None), F.lit("rule"))).first()[0] == "rule"


def test_tiles_give_the_same_pairs(spark):
    from paperloom import queries

    b = queries._boxes(spark, SF)
    one = b.withColumn("image_id", F.lit(1)).limit(600).cache()
    plain, tiled = (sorted(map(tuple, B.iou_pairs(one, ["image_id"], 0.1, tile=t).collect())) for t in (None, 16.0))
    assert plain == tiled and len(plain) > 100


@pytest.mark.parametrize("name", ["detection_matches", "polygons_without_overlap", "merged_stacks", "roomier_boxes", "wider_texts", "box_stacks", "collated_lines", "table_scores"])
def test_queries_without_sql_run(spark, name):
    assert getattr(Q, name)(spark, SF).count() > 50


def test_mended_formulas_and_merged_borders(spark):
    from paperloom.operators import regions as P

    rows = [(1, 0, "text", "a"), (1, 1, "embedding", "x,"), (1, 2, "text", "， b"), (1, 3, "embedding", "y\\."), (1, 4, "text", ". c"), (2, 0, "isolated", "z"), (2, 1, "text", "(1.2)"), (3, 0, "isolated", "z"), (3, 1, "text", "(1) no"), (3, 2, "text", " ")]
    df = spark.createDataFrame([(line, place, kind, text, 10.0 * place, 0.0, 10.0 * place + 9, 10.0) for line, place, kind, text in rows], "line int, place int, kind string, text string, x0 double, y0 double, x1 double, y1 double")
    got = {(r.line, r.place): (r.text, r.x1) for r in P.mended_formulas(df, ["line"]).collect()}
    assert got == {(1, 0): ("a", 9), (1, 1): ("x", 19), (1, 2): ("， b", 29), (1, 3): ("y\\.", 39), (1, 4): (". c", 49), (2, 0): ("z \\tag{1.2}", 19), (3, 0): ("z", 9), (3, 1): ("(1) no", 19)}
    lines = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0), (1, 2, 2.0, 9.0, 20.0), (1, 3, 4.0, 19.0, 30.0), (1, 4, 2.0, 60.0, 70.0), (2, 1, 0.0, 0.0, 1.0)], "image_id int, box_id int, at double, lo double, hi double")
    merged = sorted((r.image_id, r.line, r.at, r.lo, r.hi, r.n) for r in P.merged_borders(lines, ["image_id"], 2.0).collect())
    assert merged == [(1, 1, 2.0, 0.0, 30.0, 3), (1, 4, 2.0, 60.0, 70.0, 1), (2, 1, 0.0, 0.0, 1.0, 1)]


def test_corners_and_views(spark):
    from paperloom.functions import geometry as G
    from paperloom.operators import hypertxt as H

    df = spark.createDataFrame([([(10.0, 9.0), (0.0, 1.0), (9.0, 0.0), (1.0, 10.0)],)], "p array<struct<x: double, y: double>>")
    assert [tuple(p) for p in df.select(G.ordered_corners(F.col("p"))).first()[0]] == [(0, 1), (9, 0), (10, 9), (1, 10)]
    elements = spark.createDataFrame([(1, 0, "title", "T", 0), (1, 1, "text", "a.", 1), (1, 2, "text", "b.", 1)], "doc_id int, idx int, type string, text string, pid int")
    keys = spark.createDataFrame([(1, 1), (1, 7)], "doc_id int, key int")
    assert sorted((r.key, r.text) for r in H.text_of(elements, "paragraph", keys).collect()) == [(1, "a.b."), (7, "")]


def test_implied_columns_and_strategies(spark):
    from paperloom.operators import regions as P

    words = spark.createDataFrame([(1, 0.0, 9.0, 0.0, 9.0), (1, 0.5, 7.0, 10.0, 19.0), (1, 1.0, 12.0, 20.0, 29.0), (1, 30.0, 40.0, 0.0, 9.0), (1, 31.0, 45.0, 10.0, 19.0), (1, 60.0, 70.0, 0.0, 9.0)], "p int, x0 double, x1 double, top double, bottom double")
    assert sorted((r.x, r.y0, r.y1) for r in P.implied_columns(words, ["p"], 2).collect()) == [(0, 0, 29), (30, 0, 29), (45, 0, 29)]
    assert P.implied_columns(words, ["p"], 9).count() == 0
    edges = spark.createDataFrame([(1, "line", "v", 5.0, 5.0, 0.0, 9.0), (1, "rect", "v", 6.0, 6.0, 0.0, 9.0), (1, "rect", "h", 0.0, 9.0, 3.0, 3.0)], "p int, kind string, orientation string, x0 double, x1 double, top double, bottom double")
    count = lambda v, h, x=None: P.table_edges(edges, words, ["p"], v, h, x, (2, 2)).groupBy("orientation").count().orderBy("orientation").collect()
    assert [tuple(r) for r in count("lines", "lines")] == [("h", 1), ("v", 2)] and [tuple(r) for r in count("lines_strict", "text")] == [("h", 3), ("v", 1)]
    assert [tuple(r) for r in count("text", "explicit")] == [("v", 3)] and [tuple(r) for r in count("explicit", "explicit", edges)] == [("h", 1), ("v", 2)]
    assert P.table_edges(edges, words, ["p"], "explicit", "explicit").count() == 0
    with pytest.raises(ValueError):
        P.table_edges(edges, words, ["p"], "other")


def test_nms_measures(spark):
    df = boxes(spark, [(0, 0, 10, 10), (0, 0, 10, 40), (50, 0, 60, 10)]).withColumn("score", 1.0 - F.col("box_id") / 10)
    kept = lambda **k: sorted(r.box_id for r in B.nms(df, ["image_id"], 0.5, label=None, **k).collect())
    assert kept() == [0, 1, 2] and kept(measure="kept") == [0, 2] and kept(measure="own") == [0, 1, 2]
    assert kept(measure="own", keep_higher=False) == [1, 2] and kept(measure="kept", keep_higher=False) == [0, 1, 2]


def test_table_similarity_without_search(monkeypatch):
    """Random tables against the whole search and the parser; like shapes of small changes and long texts need no search."""
    import random

    from paperloom.operators import metrics

    def whole(a, b, structure_only):
        def read(page):
            reader = A._Tables()
            reader.feed(page or "")
            plain = lambda n: (n[0] if isinstance(n[0], str) else (*n[0][:3], "".join(n[0][3])), [plain(c) for c in n[1]])
            return plain(reader.root)

        x, y = read(a), read(b)
        size = lambda t: 1 + sum(map(size, t[1]))
        if not x[1] or not y[1]:
            return float(not x[1] and not y[1])
        cost = lambda p, q: float(p != q) if isinstance(p, str) or isinstance(q, str) else 1.0 if p[:3] != q[:3] else 0.0 if structure_only else 1 - metrics._similar(p[3], q[3])
        return 1 - metrics.tree_distance(x, y, cost) / max(size(x), size(y))

    rng = random.Random(2)

    def table():
        span = lambda: rng.choice(["", "", ' colspan="2"', ' rowspan="2"', ' rowspan="2" colspan="3"', ' colspan="0"', ' class="x"'])
        text = lambda: rng.choice(["", "p12", "p13", "q1 2", "a&amp;b", "<b>p1</b>", "多行\n字", "p" * 50])
        return "<table>" + "".join("<tr>" + "".join(f"<td{span()}>{text()}</td>" for _ in range(rng.randint(0, 4))) + "</tr>" for _ in range(rng.randint(0, 3))) + "</table>"

    for _ in range(400):
        a = table()
        b = rng.choice([table(), a, a.replace("p1", "q"), a.replace("p", "ab")])
        for flag in (False, True):
            assert round(A.table_similarity(a, b, flag), 6) == round(whole(a, b, flag), 6), (a, b)
    shifted = "<table><tr>" + "".join(f"<td>{c * 3}</td>" for c in "abcde") + "</tr></table>", "<table><tr>" + "".join(f"<td>{c * 3}</td>" for c in "bcdef") + "</tr></table>"
    assert A.table_similarity(*shifted) == pytest.approx(1 - 2 / 7)
    monkeypatch.setattr(A, "tree_distance", None)
    assert A.table_similarity("<table><tr><td>p12</td><td>x</td></tr></table>", "<table><tr><td>q2</td><td>x</td></tr></table>") == pytest.approx(1 - 2 / 3 / 4)
