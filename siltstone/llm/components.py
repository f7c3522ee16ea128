"""Connected components of a graph whose nodes are of any type that has an order, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop, materialize, release

#: At most so many nodes count as hubs, whatever the graph: the rest have at most edges / HUBS neighbours each.
HUBS = 50_000


def with_least(edges: DataFrame, rows: int, own: bool) -> DataFrame:
    """edges (u, v), of which there are at most `rows`, with m: the least v of each u (own: or u itself). Edges of hubs meet it by broadcast
    (at most HUBS rows), those of other nodes by shuffle, so no task has all of a hub."""
    low = F.min("v")
    least = edges.groupBy("u").agg((F.least(low, F.col("u")) if own else low).alias("m"), F.count("*").alias("n"))
    hub = F.col("n") > max(1000, -(-rows // HUBS))
    marked = edges.join(F.broadcast(least.filter(hub).select("u", F.col("m").alias("h"))), "u", "left")
    others = marked.filter("h is null").select("u", "v").join(least.filter(~hub).select("u", "m").hint("merge"), "u")
    return marked.filter("h is not null").select("u", "v", F.col("h").alias("m")).unionAll(others.select("u", "v", "m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, for edges (a, b). Nodes without an edge are absent; loops and repeated
    edges count for nothing; no edges give no rows.

    Each round hangs every node's larger neighbours on its smallest neighbour (large star), then its smaller ones (small star);
    the number of edges never grows, and after some log(n) rounds every component is one star. Each round is a written table.
    """
    spark = edges.sparkSession
    tidy = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, path = materialize(tidy, "edges")
    while not is_stars(now):
        rows = 2 * now.count()
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, rows, True).filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, large_at = materialize(large, "edges")
        small = with_least(large, rows, False)
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        after, there = materialize(small, "edges")
        drop(spark, path, large_at)
        release(spark)
        now, path = after, there
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def is_stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one other, and nothing hangs on it then."""
    up = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    roles = up.unionAll(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return roles.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1").isEmpty()
