"""Connected components of a link table, by alternating large and small stars.

Each round is joins and aggregations over links; nothing is gathered in one
place, and the links of a round are a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .cluster import forget, written

#: Rounds after which the loop gives up; stars need about log2 of the longest path.
MOST_ROUNDS = 60


def _sum(links: DataFrame) -> tuple[int, int]:
    r = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], int(r["s"] or 0)


def _large(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that each node with a link can reach.

    links: two columns of nodes, in any order and direction; nulls and loops
    are ignored."""
    u, v = links.columns[:2]
    state = written(links.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).filter("u <> v").distinct(), "links")
    before = _sum(state)
    for _ in range(MOST_ROUNDS):
        after = written(_small(_large(state).distinct()).distinct(), "links")
        forget(state)
        state, now = after, _sum(after)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components didn't settle")
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
