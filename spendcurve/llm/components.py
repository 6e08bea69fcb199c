"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendcurve.llm.common import Stash, hot_keys, salted, spread


def _least(edges: DataFrame, which: str) -> DataFrame:
    """Those of the edges (u, v) with m, the least of u and its neighbours; the edges of a hot u are dealt over tasks."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hot = hot_keys(low.select("u", "n"), "u")
    return salted(edges.filter(which), hot, "u", "v").join(spread(low.select("u", F.least("u", "m").alias("m")), hot, "u"), ["u", "__salt"]).drop("__salt")


def connected_components(edges: DataFrame, stash: Stash, name: str = "cc") -> DataFrame:
    """(id, component) for every id of the edges (a, b): the smallest id that it can reach.

    Every round halves the paths at least and writes its edges; only their count and a checksum reach the
    driver. Loops and repeated edges count once; no edges give no rows.
    """
    state = stash.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    seen, step = None, 0
    while True:
        now = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == seen:
            break
        seen, step = now, step + 1
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, "v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        oriented = stash.keep(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), f"{name}-large-{step}")
        moved = _least(oriented, "true").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = oriented.groupBy("u").agg(F.min("v").alias("m"))
        state = stash.keep(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{step}")
        stash.drop(f"{name}-{step - 1}", f"{name}-large-{step}")
    roots = state.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return state.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
