"""Edges, neighbourhoods, traversal, inspection, impact and references."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.lookup import SYMBOL_TYPES, at_positions

# Relationships that make a dependent, and path markers of tests.
DEPENDENCY = ("calls", "imports", "inherits", "implements", "references")
TEST_MARKERS = ("tests/", "test/", "test_", "_test.", ".test.", "Tests.swift")
LAST_LINE = 2**63 - 1


def _shared(spark: SparkSession) -> str:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or ""


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again; with none set, as it is."""
    folder = _shared(df.sparkSession)
    if not folder:
        return df
    path = f"{folder}/graphloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def related(edges: DataFrame, ids: DataFrame, direction: str = "out", relationship: str | None = None) -> DataFrame:
    """Edges of the ids (column id) with the id they belong to and their other end; one between two ids is there for both."""
    if relationship is not None:
        edges = edges.filter(F.col("relationship") == relationship)
    out = edges.join(ids.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_semi").select(F.col("source_id").alias("id"), F.col("target_id").alias("other_id"), "source_id", "target_id", "relationship", "weight")
    into = edges.join(ids.select(F.col("id").alias("target_id")).distinct(), "target_id", "left_semi").select(F.col("target_id").alias("id"), F.col("source_id").alias("other_id"), "source_id", "target_id", "relationship", "weight")
    return {"out": out, "in": into, "both": out.unionByName(into)}[direction]


def neighbors(edges: DataFrame, ids: DataFrame, direction: str = "out", relationship: str | None = None, limit: int = 50) -> DataFrame:
    """The other ends of each id's first `limit` edges."""
    order = Window.partitionBy("id").orderBy("source_id", "target_id", "relationship")
    return related(edges, ids, direction, relationship).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= limit).select("id", "other_id", "relationship")


def traverse(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "out", relationship: str | None = None) -> DataFrame:
    """(seed, id, depth, path): nodes within `depth` steps of each seed at least depth, by their least shortest path.

    Level by level: a join of the frontier with the edges, less what has been seen. The steps are written once where
    several levels read them; only what is reached is made distinct. Lineage is cut at each level.
    """
    if depth < 0:
        raise ValueError("depth must not be negative")
    if relationship is not None:
        edges = edges.filter(F.col("relationship") == relationship)
    step = {"out": edges.select(F.col("source_id").alias("at"), F.col("target_id").alias("next")), "in": edges.select(F.col("target_id").alias("at"), F.col("source_id").alias("next"))}
    step["both"] = step["out"].unionByName(step["in"])
    step = cut(step[direction], "steps") if depth > 1 else step[direction]
    frontier = seeds.select(F.col("id").alias("seed"), "id").distinct().select("seed", "id", F.lit(0).alias("depth"), F.array("id").alias("path"))
    seen = frontier
    for k in range(1, depth + 1):
        reached = frontier.join(step, F.col("id") == F.col("at")).select("seed", F.col("next").alias("id"), F.lit(k).alias("depth"), F.concat("path", F.array("next")).alias("path"))
        reached = reached.join(seen.select("seed", "id"), ["seed", "id"], "left_anti")
        frontier = cut(reached.groupBy("seed", "id", "depth").agg(F.min("path").alias("path")), f"level-{k}")
        seen = seen.unionByName(frontier)
    return seen


def accepted(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both nodes, the last written of each (source, target, relationship) by `position`."""
    known = nodes.select("id").distinct()
    edges = edges.join(known.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(known.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return edges.groupBy("source_id", "target_id", "relationship").agg(F.max_by("weight", "position").alias("weight"))


def deleted(nodes: DataFrame, edges: DataFrame, embeddings: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and vectors that stay when ids (column id) go: edges go with either end."""
    gone = ids.select("id").distinct()
    left = edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return nodes.join(gone, "id", "left_anti"), left, embeddings.join(gone.withColumnRenamed("id", "node_id"), "node_id", "left_anti")


def inspection_order() -> list[Column]:
    """Symbols first, then other nodes, then files and modules by the second place; by line, name and id."""
    place = F.when(F.col("type").isin(*SYMBOL_TYPES), 0).when(F.col("type").isin("file", "module"), 1).otherwise(2)
    return [place.asc(), F.coalesce("start_line", F.lit(LAST_LINE)).asc(), F.lower("name").asc(), F.col("id").asc()]


def inspect_file(nodes: DataFrame, edges: DataFrame, path: str, node_limit: int = 50, edge_limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """The first nodes of a file and the first of these nodes' edges, each with whether more were there."""
    if not 0 < node_limit <= 200 or not 0 < edge_limit <= 500:
        raise ValueError("limits are 1 to 200 nodes and 1 to 500 edges")
    own = nodes.filter(F.col("file_path") == path)
    total = own.agg(F.count(F.lit(1)).alias("total"))
    chosen = own.orderBy(*inspection_order()).limit(node_limit)
    order = [F.col(c).asc() for c in ("id", "source_id", "target_id", "relationship")]
    found = related(edges, chosen, "both")
    most = found.orderBy(*order).limit(edge_limit + 1).withColumn("nth", F.row_number().over(Window.orderBy(*order)))  # edge_limit + 1 rows
    flagged = most.withColumn("truncated", F.max((F.col("nth") > edge_limit).cast("int")).over(Window.partitionBy()) == 1).filter(F.col("nth") <= edge_limit).drop("nth")
    return chosen.join(F.broadcast(total), F.lit(True)).withColumn("truncated", F.col("total") > node_limit).drop("total"), flagged


def is_test(path: Column) -> Column:
    out = F.lit(False)
    for marker in TEST_MARKERS:
        out = out | F.contains(F.coalesce(path, F.lit("")), F.lit(marker))
    return out


def dependents(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> DataFrame:
    """(id, relationships, total): sources of dependency edges into nodes of the changed files (file_path), not of these."""
    changed = nodes.join(paths.select("file_path").distinct(), "file_path", "left_semi").select(F.col("id").alias("target_id"))
    hit = edges.filter(F.col("relationship").isin(*DEPENDENCY)).join(changed, "target_id", "left_semi")
    hit = hit.join(changed.withColumnRenamed("target_id", "source_id"), "source_id", "left_anti")
    return hit.groupBy(F.col("source_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("relationship")), ",").alias("relationships"), F.count(F.lit(1)).alias("links"))


def regression_risk(nodes: DataFrame, edges: DataFrame, paths: DataFrame, cap: int = 1000) -> DataFrame:
    """The first `cap` dependents of changed files with evidence, whether they are tests, and how many there are in all."""
    found = cut(dependents(nodes, edges, paths), "dependents")
    total = found.agg(F.count(F.lit(1)).alias("total_dependents"))
    first = found.orderBy("id").limit(cap)
    named = nodes.select("id", "type", "name", "file_path").join(F.broadcast(first), "id")  # `cap` rows
    return named.withColumn("is_test", is_test(F.col("file_path"))).join(F.broadcast(total), F.lit(True))


def references(nodes: DataFrame, edges: DataFrame, positions: DataFrame) -> DataFrame:
    """Sources of edges into the node at each position; one for each edge."""
    target = at_positions(nodes, positions).select("file_path", "line", F.col("id").alias("target_id"))
    return edges.join(target, "target_id").join(nodes.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id").select("file_path", "line", "target_id", "source_id", "source_name", "relationship")
