"""Hybrid search: ranked lists from names and vectors, fused, cut and described."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import search


def lists(nodes: DataFrame, vectors: DataFrame, text: str, exact: str, vector: list[float], limit: int) -> DataFrame:
    """Candidates (source, rank, id, distance) by name and by vector, each as many as the limit's budget."""
    n = search.candidates(limit)
    named = nodes.filter(F.contains(F.lower("name"), F.lit(text.lower()))).orderBy(*search.name_order(exact)).limit(n)
    lexical = search.ranked(named, *search.name_order(exact)).select(F.lit("lexical").alias("source"), "rank", "id", F.lit(None).cast("double").alias("distance"))
    near = search.by_vector(vectors, vector, n)
    semantic = search.ranked(near, F.col("distance"), F.col("node_id")).select(F.lit("semantic").alias("source"), "rank", "id", "distance")
    return lexical.unionByName(semantic)


def top(fused: DataFrame, limit: int) -> DataFrame:
    """The best by score; scores that differ by rounding only are ties, in id order."""
    return fused.orderBy(F.desc(F.round("score", 12)), "id").limit(limit)


def unindexed(files: DataFrame) -> DataFrame:
    """The answer for a repository without files: nothing, and why."""
    return files.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.lit("repository is not indexed").alias("degraded_reason"), "n")


# Seconds that a reranker has in each mode; fast doesn't rerank.
RERANK_SECONDS = {"fast": None, "balanced": 5.0, "thorough": 30.0}


@dataclass
class Found:
    """A search's results, best first (id, rank, and rerank_score if reranked), and what happened on the way."""

    results: DataFrame
    mode: str
    reranked: bool = False
    degraded_stage: str | None = None
    degraded_reason: str | None = None
    timed_out: bool = False


def labelled(fused: DataFrame, reranked: bool) -> str:
    sources = fused.agg(F.array_join(F.array_sort(F.collect_set("sources")), " ").alias("s"))
    return sources.select(search.mode(F.col("s"), reranked).alias("m")).first()["m"]


def finished(fused: DataFrame, limit: int, mode: str = "balanced", rerank: Callable[[DataFrame, float], DataFrame] | None = None) -> Found:
    """The fused candidates (id, score, sources, ...; MAX_LIMIT a query at most) cut to a result.

    rerank(candidates, seconds) gives scores (id, rerank_score) of all of them. If it fails, or takes longer than its mode
    allows, the result is the head of the fused list, and the search is degraded.
    """
    search.candidates(limit)
    seconds = RERANK_SECONDS[mode]
    head = search.ranked(top(fused, limit), F.desc(F.round("score", 12)), F.col("id"))
    plain = Found(head, labelled(fused, False))
    if rerank is None or seconds is None or plain.mode == "none":
        return plain
    pool = ThreadPoolExecutor(1)
    try:
        schema = rerank(fused, seconds)
        rows = pool.submit(schema.collect).result(seconds)  # a row for each candidate
        scores = fused.sparkSession.createDataFrame(rows, schema.schema)
        best = search.reranked(fused, scores, limit)
        return Found(search.ranked(best, F.desc("rerank_score"), F.col("id")), labelled(fused, True), True)
    except TimeoutError:
        return Found(head, plain.mode, degraded_stage="rerank", degraded_reason="reranking timed out", timed_out=True)
    except (OSError, RuntimeError, ValueError, PySparkException) as e:
        return Found(head, plain.mode, degraded_stage="rerank", degraded_reason=str(e).splitlines()[0] if str(e) else type(e).__name__)
    finally:
        pool.shutdown(wait=False, cancel_futures=True)
