"""Layout, suppression and text operators against loops and small cases."""

import datetime
import math
import random

from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import boxes, hypertxt, layout, metrics

SCHEMA = "image_id int, box_id int, label string, score double, x0 double, y0 double, x1 double, y1 double"


def made(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        x, y = float(rng.randint(0, 30)), float(rng.randint(0, 30))
        rows.append((k % 4, k, rng.choice("ab"), rng.randint(1, 99) / 100 + k / 1e6, x, y, x + rng.randint(3, 20), y + rng.randint(3, 20)))
    return rows


def area(r):
    return (r[6] - r[4]) * (r[7] - r[5])


def common(a, b):
    return max(min(a[6], b[6]) - max(a[4], b[4]), 0) * max(min(a[7], b[7]) - max(a[5], b[5]), 0)


def iou(a, b):
    return common(a, b) / (area(a) + area(b) - common(a, b))


def test_area_suppression(spark):
    rows, kept = made(1), []
    for r in sorted(rows, key=lambda r: (-area(r), r[1])):
        if not any(k[0] == r[0] and round(common(k, r) / area(r), 6) >= 0.5 for k in kept):
            kept.append(r)
    got = boxes.area_suppressed(spark.createDataFrame(rows, SCHEMA), ["image_id"]).collect()
    assert {r.box_id for r in got} == {r[1] for r in kept} and len(got) == len(kept)


def test_soft_suppression(spark):
    rows, want = made(2), {}
    for image in range(4):
        rest = {r[1]: [r, r[3]] for r in rows if r[0] == image}
        while rest:
            top = max(rest, key=lambda k: (rest[k][1], -k))
            r, s = rest.pop(top)
            want[top] = s
            for k in list(rest):
                rest[k][1] *= math.exp(-iou(rest[k][0], r) ** 2 / 0.5)
                if rest[k][1] <= 0.05:
                    del rest[k]
    got = {r.box_id: r.score for r in boxes.soft_nms(spark.createDataFrame(rows, SCHEMA), ["image_id"], least_score=0.05).collect()}
    assert got.keys() == want.keys() and 0 < len(got) < len(rows)
    assert all(abs(got[k] - want[k]) < 1e-5 for k in got)


def test_filtered_suppression(spark):
    df = spark.createDataFrame(made(3), SCHEMA)
    for agnostic in (False, True):
        out = boxes.filtered_nms(df, ["image_id"], 0.3, 0.2, ["a", "b"], agnostic, most=5)
        rows = {r.box_id: r for r in out.collect()}
        assert rows and min(r.score for r in rows.values()) > 0.3 and max(r["count"] for r in out.groupBy("image_id").count().collect()) <= 5
        ids = [r for r in made(3) if r[1] in rows]
        assert not any(a[1] < b[1] and a[0] == b[0] and (agnostic or a[2] == b[2]) and iou(a, b) >= 0.2 for a in ids for b in ids)
    assert {r.label for r in boxes.filtered_nms(df, ["image_id"], classes=["a"]).collect()} == {"a"}


def test_greedy_matches(spark):
    truth, found, want = made(4), made(5), []
    for a in truth:
        for b in found:
            if a[0] == b[0] and round(iou(a, b), 6) > 0.3 and not any(a[1] == x or b[1] == y for x, y in want):
                want.append((a[1], b[1]))
    got = boxes.greedy_matches(spark.createDataFrame(truth, SCHEMA), spark.createDataFrame(found, SCHEMA), ["image_id"], 0.3)
    assert sorted((r.truth, r.found) for r in got.collect()) == sorted(want) and want


def test_repeated_tails(spark):
    def slow(t, least=15):
        best = max((r for r in range(least, len(t) // 2) if t[-2 * r : -r] == t[-r:]), default=None)
        if best is None:
            return t
        tail = t[-best:]
        while t.endswith(tail):
            t = t[:-best]
        return t

    rng = random.Random(6)
    texts = ["", "a", "ab" * 50, "x" * 31, "x" * 30, "start " + "the same thing again. " * 5, "no repeats in here at all, none"]
    texts += ["".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) + "".join(rng.choice("ab") for _ in range(rng.randint(1, 25))) * rng.randint(1, 5) for _ in range(200)]
    got = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select(T.without_repeated_tail(F.col("t")).alias("r")).collect()
    assert [r.r for r in got] == [*map(slow, texts), None]


def test_text_helpers(spark):
    row = spark.createDataFrame([("אב abc 12 גד", [1.0, 1.0], [])], "t string, s array<double>, e array<double>").select(T.reversed_runs(F.col("t")).alias("r"), T.softmax(F.col("s")).alias("s"), T.softmax(F.col("e")).alias("e")).first()
    assert row.r == "דג abc 12 בא" and row.s == [0.5, 0.5] and row.e == []
    words = spark.createDataFrame([("abcd",), ("a",), ("zz",), ("",), (None,)], "word string")
    known = spark.createDataFrame([("a",), ("ab",), ("abc",), (None,)], "word string")
    assert {r.word: r.matches for r in T.known_prefixes(words, known).collect()} == {"abcd": ["ab", "abc"], "a": ["a"]}


def test_titles_and_nested_tables(spark):
    rows = spark.createDataFrame([(1, 0, 0, 0, "text", "old"), (1, 1, 1, 1, "text", "x"), (2, 0, 5, 1, "text", "y"), (4, 0, 0, 0, "text", "kept")], "doc_id int, idx int, sid int, pid int, type string, text string")
    titles = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (4, None)], "doc_id int, title string")
    got = sorted((r.doc_id, r.idx, r.text) for r in hypertxt.with_title(rows, titles).collect())
    assert got == [(1, 0, "A"), (1, 1, "x"), (2, -1, "B"), (2, 0, "y"), (3, 0, "C"), (4, 0, "kept")]
    nested = hypertxt.nested_tables(spark.createDataFrame([(1, {"3|0": "t", "x": "u"}), (2, None)], "doc_id int, nested_tables map<string,string>"))
    assert sorted((r.key, r.table_id) for r in nested.collect()) == [("3|0", 3), ("x", None)]


def test_page_helpers(spark):
    now = datetime.datetime(2024, 1, 3)
    files = spark.createDataFrame([("old", datetime.datetime(2024, 1, 1)), ("new", datetime.datetime(2024, 1, 2, 12))], "path string, modificationTime timestamp")
    assert [r.path for r in layout.expired(files, F.lit(now)).collect()] == ["old"]
    chars = spark.createDataFrame([("a", 0.753), ("(cid:1)", 0.0), ("b", 0.0), ("c", None)], "text string, color double")
    assert [r.text for r in layout.readable_chars(chars, color="color").collect()] == ["a", "b", "c"][1:]
    pages = spark.createDataFrame([(1, 1, "a1", "a1"), (1, 2, None, "a2"), (1, 3, None, "b3"), (1, 4, None, "b4"), (1, 5, "5", None), (1, 6, None, "6"), (2, 1, None, "1")], "doc_id int, page_no int, known string, candidate string")
    got = {(r.doc_id, r.page_no): r.page_number for r in layout.continued_page_numbers(pages).collect()}
    assert got == {(1, 1): "a1", (1, 2): "a2", (1, 3): None, (1, 4): None, (1, 5): "5", (1, 6): "6", (2, 1): None}
    empty = spark.createDataFrame([], SCHEMA)
    assert metrics.class_weights(empty).count() == layout.distance_threshold(empty, ["image_id"]).count() == boxes.soft_nms(empty, ["image_id"]).count() == 0
