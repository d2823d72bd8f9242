"""Connected components of a link table by alternating large-star and small-star steps, in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from supportkb.llm.common import forget, written


def _observed(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """The edges written, and their number and hash sum, which come with the write."""
    seen = Observation()
    out = written(edges.observe(seen, F.count(F.lit(1)).alias("n"),
                                F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), name)
    return out, (seen.get["n"], seen.get["h"])


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); component is the least node that can be reached.

    Each round writes its edges once, so lineage stays short; the minimum per node combines before the shuffle, so a
    node with very many links is no single task."""
    edges, before = _observed(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # every larger neighbour goes to the least one
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # then every smaller one
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.inline(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b"))))).filter("a <> b")
        rounds, now = _observed(small.distinct(), "stars")
        forget(edges)
        edges = rounds
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component")))
