"""Connected components of an edge table by alternating large and small stars (Kiveris et al. 2014).
Nothing is collected; each round's edges are written to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.base import Scratch

ROUNDS = 60


def connected_components(edges: DataFrame, work: Scratch) -> DataFrame:
    """node, component (smallest node reachable) for every node of an edge (u, v); long ids."""
    spark, run = edges.sparkSession, uuid.uuid4().hex[:6]
    now = work.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{run}cc0", edges.count())
    last = None
    for k in range(1, ROUNDS):
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == last or not state["n"]:
            break
        last, n = state, state["n"]
        # large star: neighbours above a node go to the smallest of its neighbourhood
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = work.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{run}cc{k}a", 2 * n)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = work.save(large, f"{run}cc{k}b", 2 * n)
        # small star: a node and its neighbours below it go to the smallest of these
        least = work.save(large.groupBy("u").agg(F.min("v").alias("m")), f"{run}cc{k}c", 2 * n)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        before, now = f"{run}cc{k - 1}", work.save(small.where("u <> v").distinct(), f"{run}cc{k}", 2 * n)
        work.drop(before, f"{run}cc{k}a", f"{run}cc{k}b", f"{run}cc{k}c")
    else:
        raise RuntimeError("components didn't settle")
    if not last or not last["n"]:
        return spark.createDataFrame([], "node long, component long")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
