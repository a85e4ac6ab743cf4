"""Connected components of links between rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch


def connected_components(scratch: Scratch, edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (a, b): component is the smallest node that can be reached.

    Alternating large-star and small-star steps: every node hands its larger neighbours, then its smaller ones, to its
    least neighbour. Each step is a sum by key and a join of written tables, which Spark may split where a hub is hot.
    """
    cur = scratch.table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        low = scratch.table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        j = both.join(low, "u")
        if large:
            out = j.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        out = scratch.table(out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star")
        scratch.drop(low)
        return out

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        return r[0], str(r[1])

    seen = mark(cur)
    for _ in range(most):
        if not seen[0]:
            break
        a = star(cur, True)
        b = star(a, False)
        scratch.drop(cur, a)
        cur, now = b, mark(b)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
