"""The state of a job queue from its rows and from its log of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ranks of modes, from the weakest.
MODES = ("cleanup", "files", "full", "force_full", "drop_index")
MAX_ATTEMPTS, MAX_RECENT = 3, 200


def rank(mode: Column) -> Column:
    out = F.lit(0)
    for k, name in enumerate(MODES):
        out = F.when(mode == name, k).otherwise(out)
    return out


def accepted(requests: DataFrame) -> DataFrame:
    """Requests (repo, position, mode) that are taken: once a repository's deletion is queued, only deletions are."""
    first = requests.filter("mode = 'drop_index'").groupBy(F.col("repo").alias("of")).agg(F.min("position").alias("dropped"))
    taken = requests.join(first, F.col("repo") == F.col("of"), "left")
    return taken.filter("dropped is null or position <= dropped or mode = 'drop_index'").select(*requests.columns)


def coalesced(requests: DataFrame) -> DataFrame:
    """Queued requests (repo, position, mode, paths, deleted, snapshot) as one job for each repository.

    The strongest mode wins and a drop takes in all; what comes after a drop is rejected. File jobs join their paths.
    Only the last forced request's snapshot stays. Sets merge per task before they are shuffled.
    """
    by = accepted(requests).groupBy("repo").agg(
        F.max(rank(F.col("mode"))).alias("top"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("paths")))).alias("paths"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("deleted")))).alias("deleted"),
        F.max_by("snapshot", F.when(F.col("mode") == "force_full", F.col("position")).otherwise(F.lit(-1).cast("long"))).alias("snapshot"),
        F.count(F.lit(1)).alias("requests"),
    )
    files, none = F.col("top") == 1, F.array().cast("array<string>")
    return by.select("repo", mode_of(F.col("top")).alias("mode"), F.when(files, F.col("paths")).otherwise(none).alias("paths"), F.when(files, F.col("deleted")).otherwise(none).alias("deleted"), F.when(F.col("top") == 3, F.col("snapshot")).alias("snapshot"), "requests")


def mode_of(place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MODES]), place + 1)


def waiting(jobs: DataFrame) -> DataFrame:
    """Each repository's oldest queued job (repo, next_id, next_mode): what a job that comes back is merged into."""
    first = jobs.filter("status = 'queued'").groupBy("repo").agg(F.min_by(F.struct("id", "mode"), F.struct("created_at", "id")).alias("next"))
    return first.select("repo", F.col("next.id").alias("next_id"), F.col("next.mode").alias("next_mode"))


def _back(jobs: DataFrame, queue: DataFrame, attempts: Column, merged: Column) -> DataFrame:
    """Jobs that come back, with next_attempts, next_status, and next_id and next_mode of the queued job that takes one
    in: that one gets the stronger mode and this one is cancelled. merged: whether it is merged where one waits."""
    rows = jobs.join(waiting(queue), "repo", "left").withColumn("next_attempts", attempts)
    into = F.col("next_id").isNotNull() & merged
    status = F.when(into, "cancelled").when(F.col("next_attempts") >= MAX_ATTEMPTS, "failed").otherwise("queued")
    stronger = mode_of(F.greatest(rank(F.col("mode")), rank(F.col("next_mode"))))
    return rows.withColumn("next_status", status).withColumn("next_mode", F.when(into, stronger)).withColumn("next_id", F.when(into, F.col("next_id")))


def claimable(jobs: DataFrame) -> DataFrame:
    """Queued jobs whose store (or repository) runs no job; cleanups last, then the oldest."""
    store = F.coalesce("store_id", "repo")
    busy = jobs.filter("status = 'running'").select(store.alias("store")).distinct()
    free = jobs.filter("status = 'queued'").withColumn("store", store).join(busy, "store", "left_anti")
    order = [(F.col("mode") == "cleanup").cast("int"), F.col("created_at"), F.col("id")]
    first = free.withColumn("nth", F.row_number().over(Window.partitionBy("store").orderBy(*order))).filter("nth = 1")
    return first.drop("nth").orderBy(*order)


def expired(jobs: DataFrame, now: Column, owner: str | None = None) -> DataFrame:
    """Running or cancelling jobs whose lease is over, or with an owner given is another's, as they come back.

    A queued job of the repository takes them in. Otherwise an expired lease counts as an attempt; a lease that is only
    another worker's doesn't.
    """
    other = F.lit(False) if owner is None else ~F.col("lease_owner").eqNullSafe(F.lit(owner))
    late = jobs.filter(F.col("status").isin("running", "cancelling") & F.col("lease_expires_at").isNotNull() & ((F.col("lease_expires_at") < now) | other))
    return _back(late, jobs, F.col("attempts") + F.when(other, 0).otherwise(1), F.lit(True))


def after_failure(failing: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs that failed once more: failed for good when the attempts are used up, else merged into a queued job of the
    repository, else queued again."""
    return _back(failing, jobs, F.col("attempts") + 1, F.col("attempts") + 1 < MAX_ATTEMPTS)


def completed(jobs: DataFrame) -> DataFrame:
    """Jobs whose work ended well: one that was to be cancelled is."""
    return jobs.withColumn("status", F.when(F.col("status") == "cancelling", "cancelled").otherwise("completed"))


def summaries(jobs: DataFrame) -> DataFrame:
    """What may be shown of a job: twelve columns, those the job lacks null."""
    has = dict(jobs.dtypes)
    shown = ("id", "mode", "status", "phase", "current", "total", "message", "attempts", "error", "created_at", "updated_at", "finished_at")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'") if has[c].startswith("timestamp") else F.col(c)
    return jobs.select(*[(stamp(c) if c in has else F.lit(None).cast("string")).alias(c) for c in shown])


def cancelled(jobs: DataFrame, repo: str | None = None) -> DataFrame:
    """Jobs after a request to cancel one repository's or all, deletions excepted."""
    hit = F.col("mode") != "drop_index"
    if repo is not None:
        hit &= F.col("repo") == repo
    status = F.when(hit & (F.col("status") == "queued"), "cancelled").when(hit & (F.col("status") == "running"), "cancelling").otherwise(F.col("status"))
    return jobs.withColumn("status", status)


def latest(jobs: DataFrame) -> DataFrame:
    """The last changed job of each repository."""
    return jobs.groupBy("repo").agg(F.max_by(F.struct("id", "status", "mode"), F.struct("updated_at", "created_at", "id")).alias("job")).select("repo", "job.*")


def recent(jobs: DataFrame, limit: int) -> DataFrame:
    return jobs.orderBy(F.desc("updated_at"), F.desc("created_at"), F.desc("id")).limit(max(1, min(MAX_RECENT, limit)))


def repository_status(repos: DataFrame, jobs: DataFrame, stats: DataFrame) -> DataFrame:
    """What each repository (repo) is doing: a running or queued job, the last failure, or what is indexed."""
    active = jobs.filter(F.col("status").isin("running", "queued")).groupBy("repo").agg(F.count(F.lit(1)).alias("active"))
    last = latest(jobs).select("repo", F.col("status").alias("last"))
    rows = repos.join(active, "repo", "left").join(last, "repo", "left").join(stats, "repo", "left")
    state = F.when(F.col("active") > 0, "indexing").when(F.col("last") == "failed", "failed").when(F.coalesce("files", F.lit(0)) > 0, "ready").otherwise("empty")
    return rows.select("repo", state.alias("state"), F.coalesce("active", F.lit(0).cast("long")).alias("active"), F.coalesce("files", F.lit(0).cast("long")).alias("files"))


def unacknowledged(snapshot: DataFrame, acks: DataFrame) -> DataFrame:
    """Files of a frozen snapshot (job, path, hash) still to do; an acknowledgement with another hash is drift."""
    rows = snapshot.join(acks.select("job", "path", F.col("hash").alias("done")), ["job", "path"], "left")
    state = F.when(F.col("done").isNull(), "open").when(F.col("done") != F.col("hash"), "drift")
    return rows.withColumn("state", state).filter("state is not null").select("job", "path", "state")
