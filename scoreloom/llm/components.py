"""Connected components of a link table, by alternating star contractions on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.storage import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
    least = materialise(least, "least")  # written, as below, so that the join can split the links of a hub
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
    least = materialise(down.groupBy("v").agg(F.min("u").alias("m")), "least")
    moved = down.join(least, "v").where("u <> m").select(F.col("m").alias("a"), F.col("u").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), F.col("v").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(links: DataFrame) -> DataFrame:
    """``(id, component)`` for every id that has a link in ``links(a, b)``; component is the smallest id
    reachable. Self links and repeated links are ignored; null ends are dropped. Ends when a round changes
    nothing; each round is a written table, so nothing is recomputed after a loss."""
    edges = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = materialise(edges, "links")
    before = _state(edges)
    while before[0]:
        edges = materialise(_small_star(materialise(_large_star(edges), "stars")), "stars")
        now = _state(edges)
        if now == before:
            break
        before = now
    found = edges.select(F.col("b").alias("id"), F.col("a").alias("component"))
    return found.unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
