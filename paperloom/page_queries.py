"""Queries of page regions, formulas and running figures, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import geometry as G
from .functions import latex as X
from .functions import text as T
from .operators import boxes as B
from .operators import hypertxt as H
from .operators import matching as A
from .operators import metrics as M
from .operators import regions as P
from .operators import tables as TB
from .queries import BOXES, CELLS, LAYOUT, OVERLAP, _boxes, _cells, _docs, query
from .sources import readers as R

SIZED = f"{LAYOUT}, sized AS (SELECT *, (8 + length(text) % 5)::DOUBLE AS size FROM layout)"
SIZES = f"""{SIZED}, firsts AS (SELECT doc_id, page_no, line_no, arg_min(size, word_no) AS s, min(x0) AS f0, CASE WHEN arg_max(text, word_no) <> '。' THEN arg_max(x1, word_no) ELSE list(x1 ORDER BY word_no)[-2] END AS f1 FROM sized GROUP BY ALL),
sizes AS (SELECT doc_id, page_no, least(list_sort(list(s))[1], 100.0) AS min_size, least(coalesce(list_sort(list(s))[2], 100.0), 100.0) AS second_size, greatest(max(s), 0.0) AS max_size, least(min(f0), 100)::BIGINT AS min_x0, greatest(max(f1), 0)::BIGINT AS max_x1 FROM firsts GROUP BY ALL)"""


def _sized(spark, sf):
    return R.word_layout(_docs(spark, sf)).withColumn("size", (8 + F.length("text") % 5).cast("double"))


@query(f"WITH {SIZES} SELECT * FROM sizes")
def page_sizes(spark, sf):
    got = P.page_sizes(_sized(spark, sf), ["doc_id", "page_no"])
    return got.withColumn("min_x0", F.col("min_x0").cast("long")).withColumn("max_x1", F.col("max_x1").cast("long"))


@query(f"WITH {SIZES}, head AS (SELECT doc_id, page_no, arg_min(size, word_no) AS s, min(top) AS top, trim(string_agg(text, ' ' ORDER BY word_no)) AS header FROM sized WHERE (doc_id, page_no, line_no) IN (SELECT doc_id, page_no, min(line_no) FROM sized GROUP BY ALL) GROUP BY ALL), big AS (SELECT doc_id, page_no, max(size) AS largest FROM sized GROUP BY ALL) SELECT doc_id, page_no, header FROM head JOIN sizes USING (doc_id, page_no) JOIN big USING (doc_id, page_no) WHERE top < 60 AND s <= second_size + 1 AND s < largest - 0.5 AND header <> ''")
def header_candidates(spark, sf):
    return P.headers(_sized(spark, sf), ["doc_id", "page_no"], 600.0)


def _edges(spark, sf):
    b = _boxes(spark, sf)
    kind = F.when(F.col("box_id") % 3 == 0, "line").otherwise("rect")
    upright = F.col("box_id") % 2 == 0
    grey = F.when(F.col("box_id") % 7 == 0, 0.651).when(F.col("box_id") % 7 == 1, 1.0).when(F.col("box_id") % 7 > 2, 0.2)
    return b.select("image_id", "box_id", kind.alias("kind"), F.when(upright, "v").otherwise("h").alias("orientation"), "x0", F.when(upright, F.col("x0")).otherwise(F.col("x1") - 5).alias("x1"), F.col("y0").alias("top"), F.when(upright, F.col("y1") - 5).otherwise(F.col("y0")).alias("bottom"), grey.alias("grey"))


@query(f"WITH {BOXES}, e AS (SELECT image_id, box_id, box_id % 2 = 0 AS v, box_id % 3 = 0 AS line, CASE WHEN box_id % 2 = 0 THEN y1 - 5 - y0 ELSE x1 - 5 - x0 END AS n, CASE WHEN box_id % 7 = 0 THEN 0.651 WHEN box_id % 7 = 1 THEN 1.0 WHEN box_id % 7 > 2 THEN 0.2 END AS grey FROM boxes) SELECT image_id, box_id, CASE WHEN v THEN 'v' ELSE 'h' END AS orientation FROM e WHERE line AND n >= 3 AND coalesce(grey NOT IN (0.651, 1.0), true)")
def filtered_edges(spark, sf):
    return P.edges_of(_edges(spark, sf), kind="line", least=3.0, color="grey").select("image_id", "box_id", "orientation")


BANDS = f"""{BOXES}, t AS (SELECT image_id, floor(y0)::BIGINT AS lo, floor(y1)::BIGINT AS hi FROM boxes WHERE label = 'R'),
bands AS (SELECT image_id, row_number() OVER w - 1 AS band, lag(hi, 1, 0) OVER w AS lo, lo AS hi FROM t WINDOW w AS (PARTITION BY image_id ORDER BY lo, hi) UNION ALL SELECT image_id, count(*), max((lo, hi))[2], 100 FROM t GROUP BY image_id)"""


@query(f"WITH {BANDS} SELECT b.image_id, b.box_id, min(band)::INTEGER AS band FROM boxes b JOIN bands s ON b.image_id = s.image_id AND b.y0 >= s.lo AND b.y1 < s.hi WHERE b.label <> 'R' GROUP BY ALL")
def table_bands(spark, sf):
    b = _boxes(spark, sf)
    return P.in_bands(b.where("label <> 'R'"), P.bands(b.where("label = 'R'"), ["image_id"], 0, 100), ["image_id"])


KIND = "CASE label WHEN 'R' THEN 'figure' WHEN 'A' THEN 'figure caption' ELSE 'plain text' END"


@query(f"WITH {BOXES}, k AS (SELECT *, {KIND} AS kind FROM boxes), n AS (SELECT *, lead(kind) OVER w AS nk, lead(x0) OVER w AS nx0, lead(y0) OVER w AS ny0, lead(x1) OVER w AS nx1 FROM k WINDOW w AS (PARTITION BY image_id ORDER BY box_id)), m AS (SELECT *, coalesce(kind = 'figure' AND nk = 'figure caption' AND ny0 - y1 > -6 AND ny0 - y1 < 80, false) AS j FROM n) SELECT image_id, box_id, CASE WHEN j THEN least(x0, nx0) ELSE x0 END AS x0, CASE WHEN j THEN greatest(0.0, y0) ELSE y0 END AS y0, CASE WHEN j THEN greatest(x1, nx1) ELSE x1 END AS x1, CASE WHEN j THEN greatest(y1, ny0 - 16) ELSE y1 END AS y1 FROM m")
def figure_captions(spark, sf):
    kind = F.when(F.col("label") == "R", "figure").when(F.col("label") == "A", "figure caption").otherwise("plain text")
    return P.captioned(_boxes(spark, sf).withColumn("kind", kind), ["image_id"]).select("image_id", "box_id", "x0", "y0", "x1", "y1")


SIDES = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) / greatest(1, least(a.x1 - a.x0, b.x1 - b.x0)) * (greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) / greatest(1, least(a.y1 - a.y0, b.y1 - b.y0)))"


@query(f"WITH {BOXES}, p AS (SELECT a.image_id, a.box_id, arg_max(b.x0, (round({SIDES}, 6), -b.box_id)) AS f0, arg_max(b.x1, (round({SIDES}, 6), -b.box_id)) AS f1, max(round({SIDES}, 6)) AS v FROM boxes a JOIN boxes b ON a.image_id = b.image_id WHERE a.side = 'O' AND b.side = 'F' GROUP BY ALL), j AS (SELECT a.*, f0, f1 FROM boxes a LEFT JOIN (SELECT * FROM p WHERE v >= 0.1) USING (image_id, box_id) WHERE a.side = 'O') SELECT image_id, box_id, x0, y0, x1, y1 FROM j WHERE f0 IS NULL UNION ALL SELECT image_id, box_id, x0, y0, least(x1, f0), y1 FROM j WHERE f0 IS NOT NULL AND least(x1, f0) - x0 >= 2 UNION ALL SELECT image_id, box_id, greatest(x0, f1), y0, x1, y1 FROM j WHERE f1 IS NOT NULL AND x1 - greatest(x0, f1) >= 2")
def cropped_texts(spark, sf):
    b = _boxes(spark, sf)
    return P.cropped_by(b.where("side = 'O'"), b.where("side = 'F'"), ["image_id"])


LINED = f"{BOXES}, lb AS (SELECT *, CASE WHEN abs(y0 - lag(y0) OVER w) >= 0.4 * lag(y1 - y0) OVER w THEN 1 ELSE 0 END AS f FROM boxes WINDOW w AS (PARTITION BY image_id ORDER BY y0, x0, box_id)), lined AS (SELECT *, sum(f) OVER (PARTITION BY image_id ORDER BY y0, x0, box_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS line_no FROM lb)"


@query(f"WITH {LINED}, t AS (SELECT image_id, line_no, min(y0) AS top FROM lined GROUP BY ALL), n AS (SELECT image_id, line_no, lead(top, 1, 100.0) OVER (PARTITION BY image_id ORDER BY line_no) AS below FROM t), g AS (SELECT l.*, y1 + CASE WHEN side = 'O' AND y1 < below THEN least(floor((below - y1) / 3), floor(0.2 * (y1 - y0))) ELSE 0 END AS ny1 FROM lined l JOIN n USING (image_id, line_no)), r AS (SELECT image_id, line_no, max(ny1) AS reach FROM g GROUP BY ALL), u AS (SELECT image_id, line_no, lag(reach, 1, 0.0) OVER (PARTITION BY image_id ORDER BY line_no) AS above FROM r) SELECT image_id, box_id, y0 - CASE WHEN side = 'O' AND y0 > above THEN least(floor((y0 - above) / 3), floor(0.2 * (y1 - y0))) ELSE 0 END AS y0, ny1 AS y1 FROM g JOIN u USING (image_id, line_no)")
def taller_texts(spark, sf):
    lined = B.reading_order(_boxes(spark, sf), ["image_id"])
    return P.taller(lined, ["image_id"], 100.0, is_text=F.col("side") == "O").select("image_id", "box_id", F.col("y0").cast("double").alias("y0"), F.col("y1").cast("double").alias("y1"))


@query()
def merged_texts(spark, sf):
    lined = B.reading_order(_boxes(spark, sf), ["image_id"]).withColumn("kind", F.when(F.col("side") == "O", "text").otherwise("formula"))
    return P.merged_neighbours(lined, ["image_id", "line_no"])


@query()
def anchored_order(spark, sf):
    return P.anchored_lines(_boxes(spark, sf), ["image_id"])


HELD = "round(greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) / ((a.x1 - a.x0) * (a.y1 - a.y0)), 6)"


@query(f"WITH {BOXES}, m AS (SELECT a.image_id, a.box_id AS package, arg_max(b.box_id, ({HELD}, b.score, -b.box_id)) AS box_id FROM boxes a JOIN boxes b ON a.image_id = b.image_id WHERE a.side = 'O' AND b.side = 'F' AND {HELD} >= 0.5 GROUP BY ALL), n AS (SELECT image_id, box_id, count(*) AS n FROM m GROUP BY ALL), c AS (SELECT image_id, box_id, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, box_id) = 1 AS first FROM boxes WHERE side = 'F') SELECT image_id, box_id, coalesce(n, 0) AS n_packages FROM c LEFT JOIN n USING (image_id, box_id) WHERE first OR n IS NOT NULL")
def holding_boxes(spark, sf):
    b = _boxes(spark, sf)
    return P.holding(b.where("side = 'F'"), b.where("side = 'O'"), ["image_id"])


@query(f"WITH {BOXES}, r AS (SELECT image_id, box_id, x0, x1, max(x1) OVER (PARTITION BY image_id ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT image_id, box_id, x0, x0 + (x1 - x0) / 8 AS x1 FROM boxes)) SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY x0, x1)::INTEGER AS place, (x0 + reach) / 2 AS at, x0 - reach AS gap FROM r WHERE x0 - reach > 1")
def gap_separators(spark, sf):
    thin = _boxes(spark, sf).select("image_id", "x0", (F.col("x0") + (F.col("x1") - F.col("x0")) / 8).alias("x1"))
    return P.separators(thin, ["image_id"], least=1.0)


@query("WITH m AS (SELECT l_suppkey AS mask, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS i, l_quantity > 20 AS marked FROM lineitem), g AS (SELECT mask, i, i - row_number() OVER (PARTITION BY mask ORDER BY i) AS g FROM m WHERE marked), r AS (SELECT mask, g, min(i) AS a, max(i) AS b, count(*) AS n FROM g GROUP BY ALL) SELECT mask, row_number() OVER (PARTITION BY mask ORDER BY a)::INTEGER AS run, (a + b) // 2 AS at, n FROM r")
def mask_run_middles(spark, sf):
    rows = R.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("mask"), F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")).cast("long").alias("i"), (F.col("l_quantity") > 20).alias("marked"))
    return P.run_middles(rows, ["mask"])


@query(f"WITH {LAYOUT}, g AS (SELECT *, sum(CASE WHEN top - p <= 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_no ORDER BY top RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM (SELECT *, lag(top) OVER (PARTITION BY doc_id, page_no ORDER BY top) AS p FROM layout)), r AS (SELECT doc_id, page_no, g, min(top) AS y, max(bottom) AS b, min(x0) AS x0, max(x1) AS x1 FROM g GROUP BY ALL HAVING count(*) >= 5), e AS (SELECT doc_id, page_no, min(x0) AS x0, max(x1) AS x1, max(b) AS b FROM r GROUP BY ALL) SELECT doc_id, page_no, y::BIGINT AS y, e.x0::BIGINT AS x0, e.x1::BIGINT AS x1 FROM r JOIN e USING (doc_id, page_no) UNION ALL SELECT doc_id, page_no, b::BIGINT, x0::BIGINT, x1::BIGINT FROM e")
def word_implied_rows(spark, sf):
    got = P.implied_rows(R.word_layout(_docs(spark, sf)), ["doc_id", "page_no"], 5)
    return got.select("doc_id", "page_no", *[F.col(c).cast("long").alias(c) for c in ("y", "x0", "x1")])


ANGLES = "round(atan2((box_id % 5 - 2)::DOUBLE, x1 - x0), 6)"


@query(f"WITH {BOXES}, a AS (SELECT image_id, {ANGLES} AS a, sqrt((x1 - x0) ** 2 + (box_id % 5 - 2) ** 2) > 3 * (y1 - y0) AS long FROM boxes), l AS (SELECT image_id, list_sort(list(a) FILTER (long)) AS l, list_sort(list(a) FILTER (NOT long)) AS o FROM a GROUP BY ALL) SELECT image_id, CASE WHEN len(l) > 0 THEN l[len(l) // 2 + 1] ELSE o[len(o) // 2 + 1] END AS angle FROM l")
def dominant_angles(spark, sf):
    b = _boxes(spark, sf)
    corners = b.select("image_id", "x0", "y0", "x1", (F.col("y0") + F.col("box_id") % 5 - 2).alias("y1"), F.col("x1").alias("x2"), (F.col("y0") + F.col("box_id") % 5 - 2 + F.col("y1") - F.col("y0")).alias("y2"))
    return P.dominant_angle(corners, ["image_id"])


@query()
def distinct_ranks(spark, sf):
    """Places of the lines of an order from made logits, one for each line."""
    rows = R.table(spark, sf, "lineitem")
    own = Window.partitionBy("l_orderkey")
    rows = rows.withColumn("n", F.count(F.lit(1)).over(own)).withColumn("i", F.row_number().over(own.orderBy("l_linenumber", "l_partkey")))
    logits = F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda k: F.pmod(F.col("l_partkey") * k * 7919 + F.col("l_suppkey"), F.lit(1000)) / 1000)
    return P.ranked(rows.select("l_orderkey", "i", logits.alias("logits")), ["l_orderkey"])


HULL = "(greatest(a.x1, b.x1) - least(a.x0, b.x0))"
TALL = "(greatest(a.y1, b.y1) - least(a.y0, b.y0))"


@query(f"WITH {BOXES}, p AS (SELECT a.image_id, a.box_id AS a, b.box_id AS b, a.x1 - a.x0 AS wa, a.y1 - a.y0 + 1e-7 AS ha, b.x1 - b.x0 AS wb, b.y1 - b.y0 + 1e-7 AS hb, {HULL} AS cw, {TALL} AS ch, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS i, ((b.x0 + b.x1 - a.x0 - a.x1) ** 2 + (b.y0 + b.y1 - a.y0 - a.y1) ** 2) / 4 AS r FROM boxes a JOIN boxes b ON a.image_id = b.image_id AND a.box_id < b.box_id AND a.side = 'O' AND b.side = 'F'), u AS (SELECT *, wa * ha + wb * hb - i + 1e-7 AS u, r / (cw ** 2 + ch ** 2 + 1e-7) AS d, 4 / pi() ** 2 * (atan(wb / hb) - atan(wa / ha)) ** 2 AS v, cw * ch + 1e-7 AS c FROM p) SELECT image_id, a, b, round(i / u - (c - u) / c, 5) + 0.0 AS giou, round(i / u - d, 5) + 0.0 AS diou, round(i / u - (d + v * v / (v - i / u + 1 + 1e-7)), 5) + 0.0 AS ciou FROM u")
def iou_variants(spark, sf):
    b = _boxes(spark, sf)
    x, y = G.box("l"), G.box("r")
    joined = B.pairs(b.where("side = 'O'"), b.where("side = 'F'"), ["image_id"], condition=F.col("l.box_id") < F.col("r.box_id"))
    return joined.select("l.image_id", F.col("l.box_id").alias("a"), F.col("r.box_id").alias("b"), *[(F.round(v, 5) + 0.0).alias(n) for v, n in zip(G.iou_variants(x, y), ("giou", "diou", "ciou"))])


@query("WITH p AS (SELECT l_orderkey, list(l_extendedprice ORDER BY l_linenumber, l_extendedprice) AS p FROM lineitem GROUP BY ALL), k AS (SELECT l_orderkey, p, unnest(generate_series(0, 4)) AS k FROM p), x AS (SELECT *, k * (len(p) - 1) / 4.0 AS x, least(floor(k * (len(p) - 1) / 4.0), greatest(len(p) - 2, 0))::BIGINT AS lo FROM k) SELECT l_orderkey, k::INTEGER AS k, round(p[lo + 1] + (coalesce(p[lo + 2], p[lo + 1]) - p[lo + 1]) * (x - lo), 4) AS value FROM x")
def resampled_prices(spark, sf):
    lists = R.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_extendedprice"))), lambda x: x["l_extendedprice"]).alias("p"))
    return lists.select("l_orderkey", F.posexplode(G.resampled(F.col("p"), 5)).alias("k", "value")).withColumn("value", F.round("value", 4))


@query("SELECT l_suppkey, round(0.1 * avg(l_tax) + 0.9 * avg(l_discount), 6) AS fitness FROM lineitem GROUP BY l_suppkey")
def fitness_scores(spark, sf):
    per = R.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("p"), F.max("l_quantity").alias("r"), F.avg("l_tax").alias("m"), F.avg("l_discount").alias("mm"))
    return per.select("l_suppkey", F.round(M.fitness(*map(F.col, ("p", "r", "m", "mm"))), 6).alias("fitness"))


@query("SELECT l_orderkey, round(coalesce(avg(l_discount) FILTER (l_linestatus = 'F'), 0), 6) AS mean, round(exp(avg(ln(l_discount + 1e-8))), 6) AS geometric FROM lineitem GROUP BY l_orderkey")
def decode_confidence(spark, sf):
    got = M.confidence(R.table(spark, sf, "lineitem"), ["l_orderkey"], "l_discount", F.col("l_linestatus") == "F")
    return got.select("l_orderkey", F.round("mean", 6).alias("mean"), F.round("geometric", 6).alias("geometric"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, sum(l_quantity) OVER w AS total, count(l_quantity) OVER w AS n, round(avg(l_quantity) OVER w, 6) AS mean FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def running_meter(spark, sf):
    got = M.running(R.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "l_quantity")
    return got.select("l_orderkey", "l_linenumber", "l_partkey", "total", "n", F.round("mean", 6).alias("mean"))


@query("WITH l AS (SELECT o_custkey, o_orderkey, o_totalprice, list(o_totalprice) OVER w AS l, avg(o_totalprice) OVER w AS m FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT o_orderkey, list_sort(l)[(len(l) - 1) // 2 + 1] AS median, round(m, 4) AS mean FROM l")
def smoothed_prices(spark, sf):
    got = M.smoothed(R.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"], "o_totalprice", 5)
    return got.select("o_orderkey", "median", F.round("mean", 4).alias("mean"))


@query("SELECT l_orderkey, l_returnflag, string_agg(DISTINCT l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber || ':' || l_returnflag) AS lines FROM lineitem GROUP BY ALL")
def inverted_maps(spark, sf):
    """A map from lines to flags turned into one from flags to lines."""
    line = F.concat_ws(":", "l_linenumber", "l_returnflag")
    maps = R.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.map_from_entries(F.collect_set(F.struct(line.alias("k"), F.col("l_returnflag").alias("v")))).alias("m"))
    turned = maps.select("l_orderkey", F.explode("m").alias("line", "l_returnflag"))
    return turned.groupBy("l_orderkey", "l_returnflag").agg(F.array_join(F.array_sort(F.collect_list("line")), ",").alias("lines"))


CODES = "abcdefghijklmnopqrstuvwxyz "


@query(f"SELECT n_nationkey, length(n_name)::INTEGER AS n, list_concat(list_transform(string_split(lower(n_name), ''), lambda c: strpos('{CODES}', c)), list_transform(generate_series(1, 25 - length(n_name)), lambda k: 0))::VARCHAR AS codes FROM nation")
def label_codes(spark, sf):
    """Names as numbers of their characters, 0 behind the end, as a recogniser's labels are."""
    name = F.lower("n_name")
    own = F.transform(F.filter(F.split(name, ""), lambda c: c != ""), lambda c: F.position(c, F.lit(CODES)))
    padded = F.concat(own, F.array_repeat(F.lit(0), F.lit(25) - F.size(own)))
    return R.table(spark, sf, "nation").select("n_nationkey", F.length("n_name").alias("n"), F.concat(F.lit("["), F.array_join(padded, ", "), F.lit("]")).alias("codes"))


@query("""SELECT n_nationkey, '{"image":"' || n_name || '.png","label":"' || n_comment || '"}' AS row FROM (SELECT n_nationkey, n_name, lower(n_name) || ' ' || n_regionkey AS n_comment FROM nation)""")
def label_rows(spark, sf):
    """Rows of a label file, image and label between a tab, as JSON."""
    rows = R.table(spark, sf, "nation").select("n_nationkey", F.concat("n_name", F.lit(".png\t"), F.lower("n_name"), F.lit(" "), "n_regionkey").alias("line"))
    cells = F.split("line", "\t")
    return rows.select("n_nationkey", F.to_json(F.struct(cells[0].alias("image"), cells[1].alias("label"))).alias("row"))


@query(r"""SELECT l_orderkey, l_linenumber, '$\mathrm{q' || l_linenumber || '}_{' || l_suppkey || l_returnflag || '}' || CASE WHEN l_linestatus = 'F' THEN ',' ELSE '-' END || l_partkey || '$' AS text FROM lineitem""")
def markdown_formulas(spark, sf):
    sign = F.when(F.col("l_linestatus") == "F", ",  ").otherwise(" - ")
    made = F.concat(F.lit(r"\mathrm{ q  }"), F.col("l_linenumber"), F.lit(" _{ "), F.col("l_suppkey"), F.lit("  "), F.col("l_returnflag"), F.lit("}"), sign, F.col("l_partkey"), F.lit(" "))
    return R.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.to_markdown(F.regexp_replace(made, " _", "_")).alias("text"))


@query(r"""SELECT l_orderkey, l_linenumber, 'x^{' || l_linenumber || '}+\frac{' || l_partkey || '}{' || l_suppkey || '}' || CASE WHEN l_linestatus = 'F' THEN '_{0}' ELSE '' END AS text FROM lineitem""")
def tidy_formulas(spark, sf):
    made = F.concat(F.lit("x ^ { "), F.col("l_linenumber"), F.lit(r" } + \left \frac { "), F.col("l_partkey"), F.lit(" }{"), F.col("l_suppkey"), F.lit(r" } _ {\hat { } }"), F.when(F.col("l_linestatus") == "F", r" _ { 0 } \quad \, ").otherwise(r" \qquad"))
    return R.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.tidy(made).alias("text"))


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations WHERE text <> '' GROUP BY conv_id")
def smart_joined_turns(spark, sf):
    turns = R.table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("p"))
    return turns.select("conv_id", X.smart_joined(F.col("p")).alias("text")).where("text <> ''")


@query("SELECT p_partkey, p_name AS heading FROM part")
def cleaned_headings(spark, sf):
    remark = F.when(F.col("p_partkey") % 2 == 0, "  单位：万元 √/ 万美元").otherwise("")
    return R.table(spark, sf, "part").select("p_partkey", X.cleaned_heading(F.concat("p_name", remark)).alias("heading"))


@query(f"WITH {CELLS}, u AS (SELECT table_id, r0 AS r, unnest(generate_series(c0, c1 - 1)) AS c, CASE WHEN r0 = 0 THEN '\"' || text || ',\"\"' || '\"' ELSE text END AS text FROM cells), l AS (SELECT table_id, r, string_agg(text, ',' ORDER BY c) AS line FROM u GROUP BY ALL) SELECT table_id, string_agg(line, chr(10) ORDER BY r) AS csv FROM l GROUP BY table_id")
def table_csv(spark, sf):
    marked = F.when(F.col("r0") == 0, F.concat("text", F.lit(',"'))).otherwise(F.col("text"))
    return TB.to_csv(_cells(spark, sf).withColumn("text", marked), ["table_id"])


@query(f"""WITH {CELLS} SELECT table_id, '<table>' || string_agg('<cell r0="' || r0 || '" c0="' || c0 || '" r1="' || r1 || '" c1="' || c1 || '">' || text || '&lt;</cell>', '' ORDER BY r0, c0) || '</table>' AS xml FROM cells GROUP BY table_id""")
def table_xml(spark, sf):
    return TB.to_xml(_cells(spark, sf).withColumn("text", F.concat("text", F.lit("<"))), ["table_id"])


@query("WITH c AS (SELECT l_orderkey, list(l_suppkey % 6 ORDER BY l_linenumber, l_partkey, l_suppkey) AS c FROM lineitem GROUP BY ALL), s AS (SELECT l_orderkey, CASE WHEN list_position(c, 5) > 0 THEN c[1:list_position(c, 5) - 1] ELSE c END AS c FROM c) SELECT l_orderkey, coalesce(array_to_string(list_transform(list_filter(c, lambda x: x <> 0), lambda x: substring('abcdef', (x + 1)::INTEGER, 1)), ''), '') AS label FROM s")
def decoded_tokens(spark, sf):
    """Codes up to the stop code 5, without the padding 0."""
    codes = R.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: (x["l_suppkey"] % 6).cast("int")).alias("c"))
    symbols = F.array(*[F.lit(x) for x in "abcdef"])
    return codes.select("l_orderkey", F.array_join(T.decoded(F.col("c"), symbols, stop=5, ignored=(0,)), "").alias("label"))


CLASS_IOU = f"round({OVERLAP} / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {OVERLAP}), 6)"


def _hits(side: str, other: str) -> str:
    return f"(SELECT label, count(*) AS n, count(*) FILTER (best >= 0.3) / count(*) AS share FROM (SELECT a.label, a.image_id, a.box_id, max({CLASS_IOU}) AS best FROM (SELECT * FROM boxes WHERE side = '{side}') a LEFT JOIN (SELECT * FROM boxes WHERE side = '{other}') b ON a.image_id = b.image_id AND a.label = b.label GROUP BY ALL) GROUP BY label)"


@query(f"WITH {BOXES}, p AS {_hits('O', 'F')}, t AS {_hits('F', 'O')} SELECT label, coalesce(p.n, 0) AS n_pred, coalesce(t.n, 0) AS n_truth, round(coalesce(p.share, 0), 6) AS precision, round(coalesce(t.share, 0), 6) AS recall, round(coalesce(2 * p.share * t.share / nullif(p.share + t.share, 0), 0), 6) AS f FROM p FULL JOIN t USING (label)")
def class_hits(spark, sf):
    b = _boxes(spark, sf)
    return M.class_hits(b.where("side = 'O'"), b.where("side = 'F'"), ["image_id"], 0.3)


@query(f"WITH {BOXES}, h AS (SELECT a.image_id, b.box_id, string_agg('w' || a.box_id, ' ' ORDER BY a.x0, 'w' || a.box_id) AS text FROM boxes a JOIN boxes b ON a.image_id = b.image_id WHERE a.side = 'O' AND b.side = 'F' AND round({OVERLAP} / ((a.x1 - a.x0) * (a.y1 - a.y0)), 6) >= 0.5 GROUP BY ALL) SELECT b.image_id, b.box_id, coalesce(text, '') AS text FROM boxes b LEFT JOIN h USING (image_id, box_id) WHERE b.side = 'F'")
def aligned_texts(spark, sf):
    b = _boxes(spark, sf).withColumn("text", F.concat(F.lit("w"), "box_id"))
    return B.aligned_texts(b.where("side = 'F'"), b.where("side = 'O'"), ["image_id"])


@query(f"WITH {BOXES} SELECT image_id, box_id, round(x0 / 3)::BIGINT AS x0, round(y1 / 3)::BIGINT AS y1 FROM boxes WHERE score >= 20000 AND box_id % 14 NOT IN (12, 13)")
def layout_elements(spark, sf):
    thirds = _boxes(spark, sf).withColumns({c: F.col(c) / 3 for c in ("x0", "y0", "x1", "y1")}).withColumn("category", F.col("box_id") % 14)
    return B.sorted_out(thirds, 20000.0)[0].select("image_id", "box_id", "x0", "y1")


@query("SELECT l_returnflag AS model, unnest(['least', 'mean']) AS name, unnest([min(l_discount), round(avg(l_discount), 6)]) AS value FROM lineitem GROUP BY l_returnflag")
def figures_by_model(spark, sf):
    made = M.by_model(R.table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "model"), "model", {"least": F.min("l_discount"), "mean": F.round(F.avg("l_discount"), 6)})
    return made.select("model", F.explode("figures").alias("name", "value"))


@query()
def detection_matches(spark, sf):
    return A.detection_matches(_boxes(spark, sf), ["image_id"], F.col("side") == "F")


@query()
def polygons_without_overlap(spark, sf):
    """Boxes as slanted quadrangles."""
    b = _boxes(spark, sf)
    slant = F.col("box_id") % 5
    corners = F.array("x0", F.col("y0") + slant, F.col("x1"), "y0", "x1", F.col("y1"), F.col("x0"), F.col("y1") + slant)
    return A.polygon_nms(b.select("image_id", "box_id", "score", corners.alias("points")), ["image_id"], 0.2)


@query()
def merged_stacks(spark, sf):
    return A.merged_stacks(_boxes(spark, sf), ["image_id"], depth=4.0)


@query()
def roomier_boxes(spark, sf):
    return A.roomier(_boxes(spark, sf), ["image_id"], 6.0, 120.0, 80.0, F.col("label") != "R")


@query()
def wider_texts(spark, sf):
    return A.wider(_boxes(spark, sf), ["image_id"], 120.0, F.col("side") == "O")


@query()
def box_stacks(spark, sf):
    return A.stacks(_boxes(spark, sf), ["image_id"])


@query()
def collated_lines(spark, sf):
    words = _sized(spark, sf)
    number = F.col("line_no") * 100_000 + F.col("word_no")
    return A.collated_lines(words.withColumn("char_no", number), ["doc_id", "page_no", "line_no"], space=5.0)


@query()
def table_scores(spark, sf):
    """HTML tables compared with themselves with one text changed."""
    pages = TB.to_html(_cells(spark, sf), ["table_id"])
    return A.table_scores(pages.withColumn("pred", F.regexp_replace("html", "p1", "q")), "pred", "html").select("table_id", "similarity")


@query(f"WITH {SIZES}, tail AS (SELECT doc_id, page_no, arg_max(size, word_no) AS s, arg_max(bottom, word_no) AS bottom, trim(string_agg(text, ' ' ORDER BY word_no)) AS number FROM sized WHERE (doc_id, page_no, line_no) IN (SELECT doc_id, page_no, max(line_no) FROM sized GROUP BY ALL) GROUP BY ALL), big AS (SELECT doc_id, page_no, max(size) AS largest FROM sized GROUP BY ALL) SELECT doc_id, page_no, number FROM tail JOIN sizes USING (doc_id, page_no) JOIN big USING (doc_id, page_no) WHERE bottom > 0.9 * 100 - 5 AND number <> '' AND length(replace(number, ' ', '')) <= 9 AND NOT regexp_matches(number, '[^{P.PAGE_NUMBER}]') AND s <= second_size + 2 AND s < largest - 0.7".replace("FROM layout)", "FROM (SELECT * REPLACE (CASE WHEN (line_no + 1) % 50 = 0 OR line_no % 3 = 0 THEN regexp_replace(text, '[^0-9 ]', '1', 'g') ELSE text END AS text) FROM layout))"))
def page_number_candidates(spark, sf):
    """Pages of 100 units; every third line made of digits."""
    marked = F.when(((F.col("line_no") + 1) % 50 == 0) | (F.col("line_no") % 3 == 0), F.regexp_replace("text", "[^0-9 ]", "1")).otherwise(F.col("text"))
    return P.page_numbers(_sized(spark, sf).withColumn("text", marked), ["doc_id", "page_no"], 100.0)


COLUMNS = "cols AS (SELECT image_id, x0, x1, CASE WHEN box_id % 3 = 0 THEN 'full column' WHEN box_id % 3 = 1 THEN 'sub column' ELSE 'other' END AS kind, y0, box_id FROM boxes WHERE side = 'F'), numbered AS (SELECT *, CASE kind WHEN 'sub column' THEN row_number() OVER (PARTITION BY image_id, kind = 'sub column' ORDER BY x0, y0, box_id) - 1 WHEN 'full column' THEN -1 ELSE -2 END::INTEGER AS column_no FROM cols)"


@query(f"WITH {BOXES}, {COLUMNS}, m AS (SELECT a.image_id, a.box_id, max((round((least(a.x1, b.x1) - greatest(a.x0, b.x0)) / greatest(1, least(a.x1 - a.x0, b.x1 - b.x0)), 6), column_no))[2] AS c FROM boxes a JOIN numbered b ON a.image_id = b.image_id AND a.x0 < b.x1 AND b.x0 < a.x1 WHERE a.side = 'O' GROUP BY ALL) SELECT b.image_id, b.box_id, coalesce(c, 0)::INTEGER AS column_no FROM boxes b LEFT JOIN m USING (image_id, box_id) WHERE b.side = 'O'")
def element_columns(spark, sf):
    b = _boxes(spark, sf)
    kind = F.when(F.col("box_id") % 3 == 0, "full column").when(F.col("box_id") % 3 == 1, "sub column").otherwise("other")
    columns = P.numbered_columns(b.where("side = 'F'").withColumn("kind", kind), ["image_id"])
    return P.column_of(b.where("side = 'O'"), columns, ["image_id"]).select("image_id", "box_id", "column_no")


CHARS = "chars AS (SELECT p_partkey, i, substring(t, i::INTEGER, 1) AS char, i * 3 + CASE WHEN i % 4 = 0 THEN 0 ELSE -(i % 4) END * 1 + CASE WHEN i > 9 THEN 5 ELSE 0 END AS col FROM (SELECT p_partkey, t, unnest(generate_series(1, length(t))) AS i FROM (SELECT p_partkey, '中文' || p_name || '字' AS t FROM part)))"


@query(f"WITH {CHARS}, b AS (SELECT *, char BETWEEN '一' AND '鿿' AS cn, col - lag(col) OVER w AS step, lag(char BETWEEN '一' AND '鿿') OVER w AS pcn FROM chars WINDOW w AS (PARTITION BY p_partkey ORDER BY i)), g AS (SELECT *, sum(CASE WHEN cn <> pcn OR step > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY p_partkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS word FROM b) SELECT p_partkey, word::BIGINT AS word, CASE WHEN bool_or(cn) THEN 'cn' ELSE 'en&num' END AS state, string_agg(char, '' ORDER BY i) AS text, min(col) AS first, max(col) AS last FROM g GROUP BY ALL HAVING true")
def decoded_words(spark, sf):
    text = F.concat(F.lit("中文"), "p_name", F.lit("字"))
    chars = R.table(spark, sf, "part").select("p_partkey", F.posexplode(F.filter(F.split(text, ""), lambda c: c != "")).alias("i", "char")).withColumn("i", F.col("i") + 1)
    place = F.col("i") * 3 - F.col("i") % 4 + F.when(F.col("i") > 9, 5).otherwise(0)
    return P.words_of_codes(chars.withColumn("col", place), ["p_partkey"])


@query("WITH c AS (SELECT p_partkey, p_name AS above, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS below, CASE WHEN p_partkey % 2 = 0 THEN p_name || p_brand END AS over_, p_type AS under_ FROM part) SELECT p_partkey, above = '' OR below = '' OR CASE WHEN over_ IS NOT NULL THEN levenshtein(above || below, over_) < 0.3 * length(above || below) AND levenshtein(above || below, over_) < levenshtein(above, over_) ELSE levenshtein(above || below, under_) < 0.3 * length(above || below) AND levenshtein(above || below, under_) < levenshtein(below, under_) END AS joined FROM c")
def joined_cells(spark, sf):
    cell = R.table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("above"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_brand")).alias("below"), F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", "p_brand")).alias("over"), F.col("p_type").alias("under"))
    return cell.select("p_partkey", TB.joins_across(*map(F.col, ("above", "below", "over", "under"))).alias("joined"))


@query("SELECT p_partkey AS page, p_size AS line, round(coalesce(max(CASE WHEN n.n_name IS NOT NULL THEN 1 - levenshtein(p_name, n_name) / greatest(length(p_name), length(n_name)) END), 0), 6) AS similarity FROM part LEFT JOIN nation n ON p_size % 25 = n_regionkey GROUP BY ALL")
def best_references(spark, sf):
    lines = R.table(spark, sf, "part").select(F.col("p_partkey").alias("page"), F.col("p_size").alias("line"), F.col("p_name").alias("text"), (F.col("p_size") % 25).alias("k"))
    names = R.table(spark, sf, "nation").select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("text"))
    return M.best_reference(lines, names, ["k"], "page").join(lines.select("page", "line"), "page").select("page", "line", "similarity")


@query("SELECT o_orderkey, o_orderstatus AS truth, coalesce(l.flag, '') AS pred FROM orders LEFT JOIN (SELECT l_orderkey, min(l_returnflag) AS flag FROM lineitem WHERE l_quantity > 30 GROUP BY ALL) l ON o_orderkey = l_orderkey")
def truth_with_predictions(spark, sf):
    pred = R.table(spark, sf, "lineitem").where("l_quantity > 30").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_returnflag").alias("text"))
    return M.with_truth(pred, R.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("text")), "o_orderkey")


@query("SELECT conv_id, turn, text FROM conversations WHERE turn % 2 = 0 AND (conv_id, turn) NOT IN (SELECT conv_id, max(turn) FROM conversations GROUP BY conv_id)")
def scoped_turns(spark, sf):
    turns = R.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return H.in_scope(turns, turns.where("turn % 2 = 0"), turns.groupBy("conv_id").agg(F.max("turn").alias("turn")), ("conv_id", "turn"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(least(l_tax * 0.5 - l_discount * sqrt(3) / 2, l_tax * 0.5), 6) AS x0, round(l_tax * sqrt(3) / 2, 6) AS y0 FROM lineitem WHERE l_tax > 0")
def turned_boxes(spark, sf):
    """Boxes from (tax, 0) to (tax, discount), turned by 60 degrees about the origin."""
    rows = R.table(spark, sf, "lineitem").where("l_tax > 0")
    b = G.rotated_box(G.Box(F.col("l_tax"), F.lit(0.0), F.col("l_tax"), F.col("l_discount")), 0.0, 0.0, F.lit(60.0))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round(b.x0, 6).alias("x0"), F.round(b.y0, 6).alias("y0"))


@query()
def merged_borders(spark, sf):
    lines = _boxes(spark, sf).select("image_id", "box_id", F.col("y0").alias("at"), F.col("x0").alias("lo"), F.col("x1").alias("hi"))
    return P.merged_borders(lines, ["image_id"], 3.0)


@query(f"WITH {BOXES}, e AS (SELECT image_id, box_id % 2 = 0 AS v, box_id % 3 = 0 AS line, x0, CASE WHEN box_id % 2 = 0 THEN x0 ELSE x1 - 5 END AS x1, y0 AS top, CASE WHEN box_id % 2 = 0 THEN y1 - 5 ELSE y0 END AS bottom FROM boxes), w AS (SELECT image_id, x0, x1, y0 AS top, y1 AS bottom FROM boxes), g AS (SELECT *, sum(CASE WHEN top - p <= 1 THEN 0 ELSE 1 END) OVER (PARTITION BY image_id ORDER BY top RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM (SELECT *, lag(top) OVER (PARTITION BY image_id ORDER BY top) AS p FROM w)), r AS (SELECT image_id, g, min(top) AS y, max(bottom) AS b, min(x0) AS x0, max(x1) AS x1 FROM g GROUP BY ALL HAVING count(*) >= 2), x AS (SELECT image_id, min(x0) AS x0, max(x1) AS x1, max(b) AS b FROM r GROUP BY ALL) SELECT DISTINCT image_id, 'v' AS orientation, x0, x1, top, bottom FROM e WHERE v AND line UNION SELECT image_id, 'h', x.x0, x.x1, y, y FROM r JOIN x USING (image_id) UNION SELECT image_id, 'h', x0, x1, b, b FROM x UNION SELECT image_id, 'h', 0, 100, 0, 0 FROM boxes")
def table_edge_strategies(spark, sf):
    b = _boxes(spark, sf)
    border = b.select("image_id").distinct().select("image_id", F.lit("h").alias("orientation"), F.lit(0).alias("x0"), F.lit(100).alias("x1"), F.lit(0).alias("top"), F.lit(0).alias("bottom"))
    words = b.select("image_id", "x0", "x1", F.col("y0").alias("top"), F.col("y1").alias("bottom"))
    return P.table_edges(_edges(spark, sf), words, ["image_id"], "lines_strict", "text", border, (3, 2))


@query(f"WITH {BOXES}, m AS (SELECT a.image_id, a.box_id, -max(({HELD}, -b.box_id))[2] AS c FROM boxes a JOIN boxes b ON a.image_id = b.image_id WHERE a.side = 'O' AND b.side = 'F' AND {HELD} > 0.1 GROUP BY ALL) SELECT b.image_id, b.box_id, c AS column_id FROM boxes b LEFT JOIN m USING (image_id, box_id) WHERE b.side = 'O'")
def assigned_columns(spark, sf):
    b = _boxes(spark, sf)
    return P.assigned_columns(b.where("side = 'O'"), b.where("side = 'F'"), ["image_id"]).select("image_id", "box_id", "column_id")


@query("WITH s AS (SELECT l_suppkey, l_orderkey AS line, l_linenumber AS place, l_partkey AS p, CASE WHEN l_linenumber % 3 = 0 THEN l_partkey::VARCHAR ELSE l_returnflag END AS text, l_linenumber % 2 = 1 AS raised FROM lineitem), k AS (SELECT * FROM s WHERE NOT (raised AND regexp_matches(text, '^[0-9]+$'))), l AS (SELECT l_suppkey, line, trim(string_agg(text, ' ' ORDER BY place, text)) AS text FROM k GROUP BY ALL) SELECT l_suppkey, trim(string_agg(text, ' ' ORDER BY line)) AS text FROM l GROUP BY ALL")
def span_texts(spark, sf):
    text = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_partkey").cast("string")).otherwise(F.col("l_returnflag"))
    spans = R.table(spark, sf, "lineitem").select("l_suppkey", F.lit(0).alias("block"), F.col("l_orderkey").alias("line"), F.col("l_linenumber").alias("place"), text.alias("text"), (F.col("l_linenumber") % 2 == 1).alias("raised"))
    return P.span_texts(spans, ["l_suppkey"])


@query()
def word_implied_columns(spark, sf):
    return P.implied_columns(R.word_layout(_docs(spark, sf)), ["doc_id", "page_no"], 4)


@query()
def nms_by_own_share(spark, sf):
    return B.nms(_boxes(spark, sf), ["image_id"], 0.05, label=None, measure="own", keep_higher=False).select("image_id", "box_id", "score")
