"""Runs, twins, neighbours in tables, language codes and settings on small cases and against loops."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import ordered, tables
from paperloom.plans import plugins


def test_consecutive_runs(spark):
    rows = [("a", v) for v in (3, 1, 2, 2, 7, None, 9, 10)] + [("b", None)]
    got = ordered.consecutive_runs(spark.createDataFrame(rows, "k string, v long"), ["k"], "v").collect()
    assert sorted(tuple(r) for r in got) == [("a", 1, 3, 3), ("a", 7, 7, 1), ("a", 9, 10, 2)]
    assert ordered.consecutive_runs(spark.createDataFrame([], "k string, v long"), ["k"], "v").count() == 0


def test_without_twins_keeps_the_first_of_each_chain(spark):
    rows = [(1, 0, "a", 10.0, 5.0), (1, 1, "a", 10.5, 5.4), (1, 2, "a", 11.2, 6.1), (1, 3, "b", 10.0, 5.0), (1, 4, "a", 10.0, 9.0), (2, 5, "a", 10.0, 5.0), (2, 6, None, 1.0, 1.0), (2, 7, None, 1.0, 1.0)]
    chars = spark.createDataFrame(rows, "page int, char_no int, text string, doctop double, x0 double")
    got = ordered.without_twins(chars, ["page"], same=("text",))
    assert sorted(r.char_no for r in got.collect()) == [0, 3, 4, 5, 6] and got.columns == chars.columns


def followed(cells, down):
    out = set()
    for t, name, *a in cells:
        span, lo, hi = ((1, 3), 0, 2) if down else ((0, 2), 1, 3)
        later = sorted((b for b in cells if b[0] == t and all(b[2 + i] == a[i] for i in span) and b[2 + lo] >= a[hi]), key=lambda b: b[2 + lo])
        for k, b in enumerate(later):
            if k and b[2 + lo] != later[k - 1][2 + hi]:
                break
            out.add((t, name, b[1], k))
    return out


@pytest.mark.parametrize("down", [False, True])
def test_followers_equal_a_loop(spark, down):
    rng = random.Random(4)
    cells = []  # (table, name, r0, c0, r1, c1)
    for t in range(6):
        for r in range(5):
            c = 0
            while c < 8:
                wide = rng.choice((1, 1, 2))
                if rng.random() < 0.8:
                    cells.append((t, f"{r}.{c}", r, c, r + 1, c + wide))
                c += wide
    df = spark.createDataFrame(cells, "t int, name string, r0 int, c0 int, r1 int, c1 int")
    got = [tuple(r) for r in tables.followers(df, ["t"], "name", down).collect()]
    assert len(got) == len(set(got)) and set(got) == followed(cells, down) and got


def test_full_width(spark):
    cells = spark.createDataFrame([(1, "head", 0, 0, 1, 3), (1, "x", 1, 0, 2, 2), (1, "y", 1, 2, 2, 3), (2, "only", 0, 1, 1, 2)], "t int, name string, r0 int, c0 int, r1 int, c1 int")
    assert {r.name for r in tables.full_width(cells, ["t"]).collect()} == {"head", "only"}


def test_language_codes(spark):
    rows = spark.createDataFrame([(["english", "de", "elvish"],), ([],), (None,)], "langs array<string>")
    codes = {"English": "en", "German": "de"}
    assert [r[0] for r in rows.select(T.language_codes(F.col("langs"), codes)).collect()] == [["en", "de", "elvish"], [], None]
    with pytest.raises(PySparkException):
        rows.select(T.language_codes(F.col("langs"), codes, strict=True)).collect()


def test_merged_settings_leave_their_arguments():
    base = {"a": {"x": 1, "y": {"z": 2}}, "b": 3}
    assert plugins.merged_settings(base, {"a": {"y": {"w": 4}}, "b": {"c": 5}}) == {"a": {"x": 1, "y": {"z": 2, "w": 4}}, "b": {"c": 5}}
    assert base == {"a": {"x": 1, "y": {"z": 2}}, "b": 3}
