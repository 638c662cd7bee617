"""Connected components of an edge table by alternating large-star and small-star steps.

Edges are kept as (a, b) with a > b. A step looks up the smallest neighbour of one end of each edge:
the table of smallest neighbours is an aggregate (partial within tasks first), is written, and is
joined by a broadcast if it has at most BROADCAST rows, otherwise by a shuffle join of two tables,
whose skewed parts adaptive execution splits. An edge whose lower end has no smaller neighbour stays as it
is, so hubs that are the least of their component move nothing. No neighbourhood, component or edge
list reaches one task or the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Rows of 16 bytes that a broadcast may hold.
BROADCAST = 200_000


def _least(e: DataFrame, name: str) -> tuple[DataFrame, int]:
    """(v, m): the smallest lower neighbour of each upper end, to be joined, and the number of rows."""
    table = cut(e.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")), name)
    n = table.count()
    return (F.broadcast(table) if n <= BROADCAST else table.hint("merge")), n


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component): the smallest id reachable from each id that has an edge to another.

    edges has long columns a and b in either order; repeated edges and loops are allowed, nulls
    are ignored. Ids without an edge are not returned. An empty table gives an empty table.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while True:
        least, n = _least(e, f"{name}-least")
        if e.count() == n and e.join(least, F.col("b") == F.col("v"), "left_semi").isEmpty():
            break  # each upper end has one edge, to an end that has none: all stars
        moved = e.join(least, F.col("b") == F.col("v"), "left").select("a", F.coalesce("m", "b").alias("b"))
        e = cut(moved.distinct(), name)
        least, _ = _least(e, f"{name}-least")
        moved = e.join(least, F.col("a") == F.col("v")).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = cut(moved.distinct(), name)
    stars = e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())
