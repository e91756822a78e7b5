"""Counts, readiness, hourly metrics, operation summaries, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds of slow and critical operations, and allowed metric dimensions.
SLOW_MS, CRITICAL_MS = 100.0, 500.0
METHODS = ("click", "error", "purchase", "signup", "view")
RETENTION_DAYS = 30
#: Operations that are retained.
CAPACITY = 2000


def count_by_type(nodes: DataFrame, repo: int | None = None) -> DataFrame:
    nodes = nodes if repo is None else nodes.filter(F.col("repo_id") == repo)
    return nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def ingestion_stats(repos: DataFrame, files: DataFrame) -> DataFrame:
    """Each repository's number of files and last indexing; 0 and '' for one without."""
    by = files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("files"), F.max("indexed_at").alias("last_indexed"))
    return repos.join(by, F.col("id") == F.col("repo_id"), "left").select("id", "path", F.coalesce("files", F.lit(0).cast("long")).alias("files"), F.coalesce("last_indexed", F.lit("")).alias("last_indexed"))


def readiness(nodes: DataFrame, embeddings: DataFrame) -> DataFrame:
    """By repository: nodes, embedded ones, and whether structure and vectors are ready, with the reason if not."""
    has = embeddings.select(F.col("node_id").alias("id"), F.lit(1).alias("has")).distinct()
    by = nodes.select("repo_id", "id").join(has, "id", "left").groupBy("repo_id").agg(F.count(F.lit(1)).alias("total"), F.count("has").alias("embedded"))
    reason = F.when(F.col("total") == 0, "empty").when(F.col("embedded") == 0, "no_vectors").when(F.col("embedded") < F.col("total"), "vectors_missing").otherwise("ready")
    return by.select("repo_id", "total", "embedded", (F.col("total") > 0).alias("structural_ready"), ((F.col("total") > 0) & (F.col("embedded") == F.col("total"))).alias("semantic_ready"), reason.alias("reason"))


def dropped_counts(files: DataFrame, nodes: DataFrame, embeddings: DataFrame) -> DataFrame:
    """What deleting each repository removes: files, nodes, vectors."""
    n = nodes.join(embeddings.select(F.col("node_id").alias("id"), F.lit(1).alias("has")).distinct(), "id", "left").groupBy("repo_id").agg(F.count(F.lit(1)).alias("nodes"), F.count("has").alias("vectors"))
    f = files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("files"))
    return n.join(f, "repo_id", "full").select("repo_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("files", "nodes", "vectors")])


def allowed(value: Column, known: tuple[str, ...]) -> Column:
    return F.when(value.isin(*known), value).otherwise("")


def hourly(events: DataFrame, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """Events (ts, method, repo, mode, status, duration_ms) by hour and dimensions: calls, duration, errors, longest."""
    duration = F.greatest(F.coalesce("duration_ms", F.lit(0.0)), F.lit(0.0))
    return events.groupBy(F.date_trunc("hour", "ts").alias("hour"), allowed(F.col("method"), methods).alias("method"), "repo", "mode", "status").agg(
        F.count(F.lit(1)).alias("calls"), F.sum(duration).alias("duration_ms"), F.sum((F.col("status") == "error").cast("long")).alias("errors"), F.max(duration).alias("max_ms")
    )


def retained(hours: DataFrame, now: Column, days: int = RETENTION_DAYS, rows: int = 10_000) -> DataFrame:
    """The newest `rows` hourly rows (by hour, then id) of the last `days`."""
    return hours.filter(F.col("hour") >= now - F.expr(f"interval {days} days")).orderBy(F.desc("hour"), F.desc("id")).limit(rows)


def report(hours: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Hourly rows of the last `days` (from 1 to the retention) with a total of all (null hour and method) in one pass."""
    days = max(1, min(days, RETENTION_DAYS))
    return hours.filter(F.col("hour") >= now - F.expr(f"interval {days} days")).rollup("hour", "method").agg(F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), F.max("max_ms").alias("max_ms"), F.grouping_id().alias("level")).filter("level <> 1")


def operation_summaries(ops: DataFrame) -> DataFrame:
    """By backend and operation: how often, errors, slow and critical ones, mean, nearest-rank 95th percentile, longest."""
    return ops.groupBy("backend", "operation").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count("error").alias("errors"),
        F.sum((F.col("duration_ms") >= SLOW_MS).cast("long")).alias("slow"),
        F.sum((F.col("duration_ms") >= CRITICAL_MS).cast("long")).alias("critical"),
        F.avg("duration_ms").alias("mean_ms"),
        F.expr("percentile_disc(0.95) within group (order by duration_ms)").alias("p95_ms"),
        F.max("duration_ms").alias("max_ms"),
    )


def _matching(ops: DataFrame, backend: str | None, failed: bool | None, min_ms: float) -> DataFrame:
    rows = ops.filter(F.col("duration_ms") >= min_ms)
    if backend is not None:
        rows = rows.filter(F.col("backend") == backend)
    if failed is not None:
        rows = rows.filter(F.col("error").isNotNull() if failed else F.col("error").isNull())
    return rows


def ring(ops: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The last operations, as many as are retained."""
    return ops.orderBy(F.desc("id")).limit(capacity)


def snapshot(ops: DataFrame, backend: str | None = None, failed: bool | None = None, min_ms: float = 0.0, limit: int = 200) -> DataFrame:
    """Of the retained operations the last `limit` that match, oldest first."""
    return _matching(ring(ops), backend, failed, min_ms).orderBy(F.desc("id")).limit(min(limit, CAPACITY)).orderBy("id")


def snapshot_counts(ops: DataFrame, backend: str | None = None, failed: bool | None = None, min_ms: float = 0.0) -> DataFrame:
    """One row: operations retained, dropped from the ring, its capacity, and how many of the retained match."""
    kept = ring(ops)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = n(ops, "all").join(F.broadcast(n(kept, "retained")), F.lit(True)).join(F.broadcast(n(_matching(kept, backend, failed, min_ms), "matching")), F.lit(True))
    return out.select("retained", (F.col("all") - F.col("retained")).alias("dropped"), F.lit(CAPACITY).alias("capacity"), "matching")


def status_counts(ops: DataFrame) -> DataFrame:
    return ops.groupBy(F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def largest_of_duplicates(repos: DataFrame) -> DataFrame:
    """Of repositories (canonical, id, files) with one canonical path the one with most files, and how many go."""
    by = repos.groupBy("canonical").agg(F.max_by("id", F.struct("files", -F.col("id"))).alias("id"), F.max("files").alias("files"), (F.count(F.lit(1)) - 1).alias("removed"))
    return by


def direct_children(files: DataFrame, sample: int = 64) -> DataFrame:
    """folders() over each folder's own files only, as the rule for a single file looks at them."""
    from graphloom.operators.discovery import generated_name

    rows = files.filter(F.contains("path", F.lit("/"))).select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), "path", "size")
    total = rows.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("folder").orderBy("path"))).filter(F.col("nth") <= sample)
    share = first.groupBy("folder").agg(F.avg(generated_name(F.col("path")).cast("double")).alias("generated"))
    return total.join(share, "folder")


def folders(files: DataFrame, sample: int = 64) -> DataFrame:
    """By folder of any level: files, bytes and the share of generated names among its first files by path.

    Every file counts in each of its ancestors. The sample is kept by each task before it is merged.
    """
    from graphloom.operators.discovery import generated_name
    from graphloom.operators.lookup import ancestors

    rows = files.select(F.explode(ancestors(F.col("path"))).alias("folder"), "path", "size").filter("folder <> path")
    total = rows.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("folder").orderBy("path"))).filter(F.col("nth") <= sample)
    share = first.groupBy("folder").agg(F.avg(generated_name(F.col("path")).cast("double")).alias("generated"))
    return total.join(share, "folder")
