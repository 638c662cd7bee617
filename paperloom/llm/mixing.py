"""Mixing overlapping sources to target weights by min-cost flow.

Documents are counted by membership pattern (the sorted set of sources they belong to). The flow
network runs start -> pattern -> source -> end. A pattern passes its words once at cost 0, a second
time at cost 1, a third time at cost 3 and so on (convex, so no repeat is made before all fresh
words are used), up to max_repeats; a source takes its target at most. Only the pattern counts,
whose number is checked, reach the driver. The flow through a pattern is then met by its documents:
every document the whole number of times, and once more those that come first in seeded hash order
until the rest is used up; the document at the border gives its leading words only.

Null and empty texts have size 0, take nothing and never influence others. Documents without a
source belong to the null source, which sorts last. Rows that repeat an id are documents of their
own with the same place in the hash order, ordered by size. Other columns are ignored, whatever their
names. An empty table gives an empty result. More than MAX_PATTERNS membership patterns are an error.
Reruns give the same rows: the order comes from hashes of id and seed.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checked_rows, cut

#: Sources take these weights in turn, in order of their names.
WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_REPEATS = 2
SEED = 17
#: More patterns than this are an error: they would not fit the driver.
MAX_PATTERNS = 100_000
#: Rows that a hash range of a pattern should hold at most; the sums of ranges are added up before the exact order within one.
RANGE_ROWS = 50_000

WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text) -> F.Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of total by weight, none above most times its size; what that frees is shared again."""
    out, open_, left = [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n > 0], float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def _flow(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], max_repeats: int) -> list[dict[int, int]]:
    """min_cost_flow of one connected network, by the primal-dual method: for each distance from
    start to end, of which convex costs make few, a maximum flow over the arcs of reduced cost 0.
    """
    n, m = len(patterns), len(quotas)
    end = n + m + 1
    to, room, cost, out = [], [], [], [[] for _ in range(end + 1)]

    def arc(a: int, b: int, most: int, price: int) -> int:
        out[a].append(len(to)), out[b].append(len(to) + 1)  # an arc and its reverse differ in the last bit
        to.extend((b, a)), room.extend((most, 0)), cost.extend((price, -price))
        return len(to) - 2

    routes = []
    for p, (members, size) in enumerate(patterns):
        for k in range(max_repeats):
            arc(0, 1 + p, size, k * (k + 1) // 2)
        routes.append({s: arc(1 + p, 1 + n + s, size * max_repeats, 0) for s in members})
    for s, quota in enumerate(quotas):
        arc(1 + n + s, end, quota, 0)
    potential = [0] * (end + 1)
    while True:
        far, heap, done = {0: 0}, [(0, 0)], set()
        while heap:
            d, a = heapq.heappop(heap)
            if a in done:
                continue
            done.add(a)
            for i in out[a]:
                if room[i] > 0 and (at := d + cost[i] + potential[a] - potential[to[i]]) < far.get(to[i], 1 << 62):
                    far[to[i]] = at
                    heapq.heappush(heap, (at, to[i]))
        if end not in far:
            break
        for a in range(end + 1):
            potential[a] += min(far.get(a, far[end]), far[end])
        free = lambda a, i: room[i] > 0 and cost[i] + potential[a] == potential[to[i]]
        while True:
            level, queue = {0: 0}, [0]
            for a in queue:
                for i in out[a]:
                    if to[i] not in level and free(a, i):
                        level[to[i]] = level[a] + 1
                        queue.append(to[i])
            if end not in level:
                break
            next_ = [0] * (end + 1)
            path: list[int] = []
            a = 0
            while True:
                if a == end:
                    amount = min(room[i] for i in path)
                    for i in path:
                        room[i] -= amount
                        room[i ^ 1] += amount
                    cut_at = next(k for k, i in enumerate(path) if room[i] == 0)
                    a = to[path[cut_at] ^ 1]
                    del path[cut_at:]
                    continue
                while next_[a] < len(out[a]):
                    i = out[a][next_[a]]
                    if level.get(to[i]) == level[a] + 1 and free(a, i):
                        break
                    next_[a] += 1
                if next_[a] < len(out[a]):
                    path.append(out[a][next_[a]])
                    a = to[path[-1]]
                elif a == 0:
                    break
                else:
                    a = to[path.pop() ^ 1]
                    next_[a] += 1
    return [{s: room[i ^ 1] for s, i in r.items()} for r in routes]


def min_cost_flow(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], max_repeats: int) -> list[dict[int, int]]:
    """Words that each pattern (its sources, its size) sends to each source: a maximum flow of minimum cost.

    Patterns that share no sources, directly or by others, are networks of their own; one pattern
    with one source, as disjoint sources give, needs no search.
    """
    root = list(range(len(quotas)))

    def find(s: int) -> int:
        while root[s] != s:
            root[s] = root[root[s]]
            s = root[s]
        return s

    for members, _ in patterns:
        for s in members[1:]:
            root[find(s)] = find(members[0])
    of: dict[int, list[int]] = {}
    for p, (members, _) in enumerate(patterns):
        of.setdefault(find(members[0]) if members else -1, []).append(p)
    out: list[dict[int, int]] = [{} for _ in patterns]
    for network in of.values():
        members, size = patterns[network[0]]
        if len(network) == 1 and len(members) <= 1:
            out[network[0]] = {s: min(quotas[s], size * max_repeats) for s in members}
            continue
        names = sorted({s for p in network for s in patterns[p][0]})
        place = {s: i for i, s in enumerate(names)}
        flows = _flow([(tuple(place[s] for s in patterns[p][0]), patterns[p][1]) for p in network], [quotas[s] for s in names], max_repeats)
        for p, flow in zip(network, flows):
            out[p] = {names[i]: x for i, x in flow.items()}
    return out


def mix_sources(docs: DataFrame, id_col: str = "doc_id", size: F.Column | None = None, members: F.Column | None = None, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """docs' ids with size, members, source_size and target (of the first source) and taken."""
    spark: SparkSession = docs.sparkSession
    size = n_words(F.col("text")) if size is None else size
    members = F.array(F.col("source")) if members is None else members
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 1)
    slim = docs.select(F.col(id_col).alias("id"), size.cast("long").alias("size"), F.array_sort(F.array_distinct(members)).alias("members"), order.alias("rank"))
    slim = cut(slim, "mix-sizes")
    sums = checked_rows(slim.groupBy("members").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), MAX_PATTERNS, "membership patterns")
    bits = max([10, *(math.ceil(math.log2(r["n"] / RANGE_ROWS)) for r in sums)])
    slim = slim.withColumn("slot", F.shiftright("rank", 63 - bits).cast("long"))
    names = sorted({s for r in sums for s in r["members"]}, key=lambda s: (s is None, s or ""))
    place = {s: i for i, s in enumerate(names)}
    of_source = [0] * len(names)
    patterns = []
    for r in sums:
        patterns.append((tuple(place[s] for s in r["members"]), int(r["size"])))
        for s in r["members"]:
            of_source[place[s]] += int(r["size"])
    total = sum(n for _, n in patterns)
    goals = targets(of_source, [weights[i % len(weights)] for i in range(len(names))], budget * total, max_repeats)
    flows = min_cost_flow(patterns, [round(g) for g in goals], max_repeats)
    plan = []
    for r, (idx, n), flow in zip(sums, patterns, flows):
        through = sum(flow.values())
        whole = through // n if n else 0
        first = idx[0] if idx else None
        plan.append((r["members"], 0 if first is None else of_source[first], 0.0 if first is None else goals[first], whole, through - whole * n))
    plan_df = spark.createDataFrame(plan, "members array<string>, source_size long, target double, whole long, rest long")
    key = F.to_json("members")
    planned = slim.withColumn("pattern", key).join(F.broadcast(plan_df.withColumn("pattern", key).drop("members")), "pattern")
    slots = planned.groupBy("pattern", "slot").agg(F.sum("size").alias("n"))
    before = slots.withColumn("before", F.sum("n").over(Window.partitionBy("pattern").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)))
    planned = planned.join(before.select("pattern", "slot", F.coalesce("before", F.lit(0)).alias("before")), ["pattern", "slot"])
    inside = Window.partitionBy("pattern", "slot").orderBy("rank", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    passed = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    taken = F.col("whole") * F.col("size") + F.least(F.greatest(F.col("rest") - passed, F.lit(0)), F.col("size"))
    return planned.select(F.col("id").alias(id_col), "size", "members", "source_size", "target", taken.cast("long").alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself, with docs' columns: a row for each whole time a document is taken, and its leading words, joined by one space, where the rest ends.

    Rows that repeat an id are taken alike, by the largest of their sizes.
    """
    sizes = docs.select("doc_id", n_words(F.col("text")).alias("size"), "source").groupBy("doc_id").agg(F.max("size").alias("size"), F.min("source").alias("source"))
    share = mix_sources(sizes, size=F.col("size")).where("taken > 0").select(F.col("doc_id").alias("_mix_id"), F.col("size").alias("_size"), F.col("taken").alias("_taken"))
    joined = docs.join(share, docs["doc_id"].eqNullSafe(share["_mix_id"]))
    left = (F.col("_taken") % F.col("_size")).cast("int")
    copies = F.ceil(F.col("_taken") / F.col("_size")).cast("int")
    joined = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lead = F.when((F.col("_copy") == copies) & (left > 0), F.array_join(F.slice(words, F.lit(1), left), " ")).otherwise(F.col("text"))
    return joined.withColumn("text", lead).select(*docs.columns)


def op1_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")
