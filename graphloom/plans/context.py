"""Graph context around seeds and hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import graph

# Names of directions.
ALIASES = {"dependencies": "out", "dependents": "in", "outgoing": "out", "incoming": "in", "both": "both"}
MAX_DEPTH = 3


def clamped(depth: int) -> int:
    return max(1, min(MAX_DEPTH, depth))


def around(edges: DataFrame, hits: DataFrame, depth: int) -> DataFrame:
    """(id, depth): what the hits lead to, each node once at its least depth, without the hits."""
    reached = graph.traverse(edges, hits, depth, "out").filter("depth > 0")
    return reached.join(hits.select("id").distinct(), "id", "left_anti").groupBy("id").agg(F.min("depth").alias("depth"))


def related(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "both", relationship: str | None = None) -> DataFrame:
    """Traversals from each seed, outgoing and then incoming; the seed is there for each direction."""
    ways = {"both": ("out", "in")}.get(ALIASES.get(direction, direction), (ALIASES.get(direction, direction),))
    out = None
    for way in ways:
        rows = graph.traverse(edges, seeds, clamped(depth), way, relationship).withColumn("direction", F.lit(way))
        out = rows if out is None else out.unionByName(rows)
    return out


def graph_context(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(id, depth, found_by): nodes around ranked seeds (id, place), each by the first seed, outgoing first, that has it."""
    rows = related(edges, seeds, hops).join(F.broadcast(seeds.select(F.col("id").alias("seed"), "place")), "seed")  # a search's seeds
    first = F.struct("place", F.when(F.col("direction") == "out", 0).otherwise(1).alias("way"), "depth", "seed")
    return rows.groupBy("id").agg(F.min(first).alias("f")).select("id", F.col("f.depth").alias("depth"), F.col("f.seed").alias("found_by"))
