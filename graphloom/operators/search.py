"""Name search, vector search and the fusion of ranked lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import COMPACT

# Limits and the constant of reciprocal-rank fusion.
MAX_LIMIT, MIN_CANDIDATES, FACTOR, RRF = 200, 20, 4, 60
MAX_QUERIES = 5
# Distances that are equal so far are ties.
DIGITS = 9
#: Vectors that are compared with as many others at once.
BLOCK = 512


def candidates(limit: int) -> int:
    """How many rows each list gives for a result of `limit`."""
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError("limit must be from 1 to 200")
    return min(MAX_LIMIT, max(MIN_CANDIDATES, FACTOR * limit))


def effective_queries(queries: list[str]) -> list[str]:
    """The different queries in order; five at most, none blank."""
    out = list(dict.fromkeys(q.strip() for q in queries))
    if not out or len(out) > MAX_QUERIES or not all(out):
        raise ValueError("one to five queries are needed, none of them blank")
    return out


def name_order(text: str) -> list[Column]:
    """Exact matches first, then by name and id."""
    return [(F.lower("name") != text.lower()).cast("int").asc(), F.col("name").asc(), F.col("id").asc()]


def by_name(nodes: DataFrame, text: str, limit: int) -> DataFrame:
    """Nodes whose name holds the text literally, whatever its case."""
    return nodes.filter(F.contains(F.lower("name"), F.lit(text.lower()))).orderBy(*name_order(text)).limit(limit)


def symbol_matches(nodes: DataFrame, text: str, types: tuple[str, ...], cap: int = 20) -> DataFrame:
    """Up to `cap` matches of each type, and `cap` of all; exact ones hide the others."""
    by = Window.partitionBy("type").orderBy(*name_order(text))
    found = nodes.filter(F.col("type").isin(*types) & F.contains(F.lower("name"), F.lit(text.lower())))
    found = found.withColumn("nth", F.row_number().over(by)).filter(F.col("nth") <= cap).drop("nth").withColumn("exact", F.lower("name") == text.lower())
    found = found.dropDuplicates(["id"]).withColumn("any_exact", F.max("exact").over(Window.partitionBy()))  # `cap` rows a type
    return found.filter("exact or not any_exact").orderBy(*name_order(text)).limit(cap).drop("exact", "any_exact")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a, b) -> Column:
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def euclidean_distance(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def by_vector(embeddings: DataFrame, query: list[float], limit: int, metric: str = "cosine") -> DataFrame:
    """The `limit` nearest vectors: each task keeps its own nearest, so one row set of that size goes on."""
    distance = {"cosine": cosine_distance, "l2": euclidean_distance}[metric](F.col("vector"), F.array(*[F.lit(float(x)) for x in query]))
    return embeddings.withColumn("distance", distance).orderBy("distance", "node_id").limit(limit)


def packed(rows: DataFrame, key: str, vector: str, size: int = BLOCK) -> DataFrame:
    """Rows (key, vector) as blocks of up to `size`: keys, and the vectors scaled to length 1 as one run of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                m = np.stack(part.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
                m /= np.sqrt((m * m).sum(axis=1, keepdims=True))
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(part.column(0).type)), pa.array([m.tobytes()], pa.binary())], names=[f"{key}s", vector])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, vector).mapInArrow(run, f"{key}s array<{kind}>, {vector} binary")


def by_vectors(embeddings: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """For each query (query_index, query) its `limit` nearest: rank, distance. Ties (to 9 digits) go by id.

    Blocks of queries meet blocks of rows, neither side need be small; of each two blocks `limit` rows a query go on.
    """

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, rows, asked, wanted in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                v, q = (np.frombuffer(x, np.float64).reshape(n, -1) for x, n in ((rows, len(ids)), (wanted, len(asked))))
                distance = 1 - q @ v.T
                name = np.array(ids, dtype=object)
                place = np.argsort(np.argsort(name, kind="stable"), kind="stable")
                near = np.round(distance, DIGITS)
                order = np.lexsort((np.broadcast_to(place, near.shape), near), axis=1)[:, :limit]
                n = order.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(asked, dtype=object), n), batch.column(2).type.value_type), pa.array(np.take_along_axis(distance, order, 1).ravel()), pa.array(name[order.ravel()].tolist(), pa.string())], names=["query_index", "distance", "node_id"])

    kind = dict(queries.dtypes)["query_index"]
    blocks = packed(embeddings, "node_id", "vector").crossJoin(packed(queries, "query_index", "query"))  # of blocks, not of rows
    near = blocks.mapInArrow(nearest, f"query_index {kind}, distance double, node_id string")
    by = Window.partitionBy("query_index").orderBy(F.round("distance", DIGITS), "node_id")
    return near.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= limit)


def ranked(df: DataFrame, *order: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """df with each row's place in its list, from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def fused(lists: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal-rank fusion of lists (source, rank, id, distance): score, sources and the semantic distance of each id."""
    return lists.groupBy(*by, "id").agg(
        F.sum(1.0 / (RRF + F.col("rank"))).alias("score"),
        F.min(F.when(F.col("source") == "semantic", F.col("distance"))).alias("distance"),
        F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"),
    )


def merged(fused_lists: DataFrame) -> DataFrame:
    """Several queries' fused lists (query_index, id, score, distance) as one: sum of scores, least distance, queries that match."""
    return fused_lists.groupBy("id").agg(F.sum("score").alias("score"), F.min("distance").alias("distance"), F.array_sort(F.collect_set("query_index")).alias("query_indexes"))


def mode(sources: Column, reranked: Column | bool = False) -> Column:
    """The label of a retrieval from the sources its results came from."""
    label = F.when(sources.contains("semantic") & sources.contains("lexical"), "hybrid").when(sources.contains("semantic"), "semantic").when(sources.contains("lexical"), "lexical").otherwise("none")
    return F.when(F.lit(reranked) & (label != "none"), F.concat(label, F.lit("_reranked"))).otherwise(label)


def reranked(fused_rows: DataFrame, scores: DataFrame, limit: int) -> DataFrame:
    """The `limit` best by an external score (id, rerank_score); rows must have one."""
    return fused_rows.join(scores, "id").orderBy(F.desc("rerank_score"), "id").limit(limit)


def rerank_errors(answers: DataFrame, documents: int, asked: int) -> DataFrame:
    """What is wrong with each answer (case_id, position, index, score) about so many documents of which so many were
    asked for: nothing, if empty. A wrong number of results has no position."""
    before = F.lag("score").over(Window.partitionBy("case_id").orderBy("position"))
    twice = F.count(F.lit(1)).over(Window.partitionBy("case_id", "index"))
    rows = answers.withColumn("before", before).withColumn("times", twice)
    problem = (
        F.when((F.col("index") < 0) | (F.col("index") >= documents), "index out of range")
        .when(F.col("times") > 1, "index repeats")
        .when(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf")), "score not finite")
        .when(F.col("score") > F.col("before"), "scores increase")
    )
    wrong = rows.select("case_id", "position", problem.alias("problem")).filter("problem is not null")
    counts = answers.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != min(asked, documents))
    return wrong.unionByName(counts.select("case_id", F.lit(None).cast("int").alias("position"), F.lit("wrong number of results").alias("problem")))


def neighbors_of_results(results: DataFrame, edges: DataFrame, cap: int = 20) -> DataFrame:
    """Up to `cap` outgoing targets of each result (rank, id) that aren't results themselves, each once."""
    out = results.select("rank", F.col("id").alias("source_id")).join(edges, "source_id")
    out = out.withColumn("nth", F.row_number().over(Window.partitionBy("source_id").orderBy("target_id", "relationship"))).filter(F.col("nth") <= cap)
    out = out.join(results.select(F.col("id").alias("target_id")), "target_id", "left_anti")
    return out.groupBy(F.col("target_id").alias("id")).agg(F.min("rank").alias("found_by"))


def compact(nodes: DataFrame) -> DataFrame:
    """What a result shows of a node: ten columns, its content cut; those the nodes lack are null."""
    has = set(nodes.columns)
    kinds = {"start_line": "long", "end_line": "long", "distance": "double"}
    shown = ("id", "type", "name", "qualified_name", "file_path", "start_line", "end_line", "signature", "content", "distance")
    own = lambda c: F.substring(c, 1, COMPACT) if c == "content" else F.col(c)
    return nodes.select(*[(own(c) if c in has else F.lit(None).cast(kinds.get(c, "string"))).alias(c) for c in shown])


def diagnostics(results: DataFrame, lists: DataFrame, stage: str | None = None, reason: str | None = None, timed_out: bool = False) -> DataFrame:
    """One row about a search: which queries match each result (id, query_indexes), how many candidates each kind of list
    gave, and what is degraded."""
    matches = results.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", F.array_sort("query_indexes"))))).alias("query_matches"))  # a page of results
    kinds = lists.agg(F.count(F.when(F.col("source") == "lexical", 1)).alias("lexical"), F.count(F.when(F.col("source") == "semantic", 1)).alias("semantic"))
    text = lambda x: F.lit(x).cast("string")
    return matches.join(F.broadcast(kinds), F.lit(True)).withColumns({"degraded_stage": text(stage), "degraded_reason": text(reason), "timed_out": F.lit(timed_out)})
