"""Change detection, debouncing, back-off and event sequences: as batch windows over a log, and as streams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Seconds between looks at a repository, and of quiet before a change counts, and the longest wait for a job.
FIRST_S, LAST_S, DEBOUNCE, LONGEST_WAIT_S = 2.0, 30.0, "500 milliseconds", 10.0


def changes(looks: DataFrame) -> DataFrame:
    """Looks (repo, ts, id, fingerprint, null: it failed) that found another fingerprint than the last good look; the first is a baseline."""
    good = looks.filter("fingerprint is not null")
    before = F.lag("fingerprint").over(Window.partitionBy("repo").orderBy("ts", "id"))
    return good.withColumn("before", before).filter("before is not null and before <> fingerprint").select("repo", "ts", "id", "before", "fingerprint")


def bursts(events: DataFrame, gap: str = DEBOUNCE) -> DataFrame:
    """Debounced changes (repo, ts): each burst ends when nothing follows for the gap."""
    return events.groupBy("repo", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("changes")).select("repo", F.col("w.start").alias("started"), F.col("w.end").alias("flushed"), "changes")


def waits(looks: DataFrame) -> DataFrame:
    """Looks (repo, ts, id, changed) with the seconds until the next: doubled after each quiet look up to a cap, reset by a change."""
    order = Window.partitionBy("repo").orderBy("ts", "id")
    since = F.sum(F.col("changed").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = looks.withColumn("streak", since)
    quiet = F.sum((~F.col("changed")).cast("int")).over(Window.partitionBy("repo", "streak").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("wait_s", F.least(F.lit(LAST_S), F.lit(FIRST_S) * F.pow(F.lit(2.0), F.least(quiet, F.lit(10))))).drop("streak")


def sequenced(events: DataFrame) -> DataFrame:
    """Events (topic, ts, id) with their number in their topic, from 1."""
    return events.withColumn("sequence", F.row_number().over(Window.partitionBy("topic").orderBy("ts", "id")))


def until_terminal(events: DataFrame) -> DataFrame:
    """Numbered events (topic, sequence, terminal) that a subscriber of its topic gets: up to the first terminal one."""
    ends = events.filter("terminal").groupBy(F.col("topic").alias("of")).agg(F.min("sequence").alias("last"))
    kept = events.join(ends, F.col("topic") == F.col("of"), "left").filter("last is null or sequence <= last")
    return kept.select(*events.columns)


def subscribed(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """Events that producers write as files, as a stream that takes in `files` a batch at most: a slow reader holds up its
    own batches only, and nothing is lost, as the files stay."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def waited(query: StreamingQuery, seconds: float) -> str:
    """Waits for a stream to end, at most LONGEST_WAIT_S: `terminal`, or `timeout` if it still runs."""
    if seconds < 0:
        raise ValueError("seconds must not be negative")
    return "terminal" if query.awaitTermination(min(seconds, LONGEST_WAIT_S)) else "timeout"


def outcomes(jobs: DataFrame, asked: DataFrame) -> DataFrame:
    """Of asked jobs (repo, id): not_found if the job is absent or another repository's, terminal, or timeout if it is
    still active when the wait is over."""
    known = jobs.select(F.col("id").alias("known"), F.col("repo").alias("of"), "status")
    rows = asked.join(known, (F.col("id") == F.col("known")) & (F.col("repo") == F.col("of")), "left")
    active = F.col("status").isin("queued", "retrying", "running", "cancelling")
    return rows.select("repo", "id", F.when(F.col("known").isNull(), "not_found").when(active, "timeout").otherwise("terminal").alias("outcome"))


def stream_changes(looks: DataFrame) -> DataFrame:
    """changes() of a stream: the last good fingerprint of each repository is kept as state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "id"], kind="stable")
        out: list[dict[str, Any]] = []
        for ts, i, fingerprint in zip(rows["ts"], rows["id"], rows["fingerprint"], strict=True):
            if fingerprint is None or pd.isna(fingerprint):
                continue
            if last is not None and last != fingerprint:
                out.append({"repo": key[0], "ts": ts, "id": i, "before": last, "fingerprint": fingerprint})
            last = fingerprint
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["repo", "ts", "id", "before", "fingerprint"])

    kinds = dict(looks.dtypes)
    return looks.groupBy("repo").applyInPandasWithState(step, f"repo {kinds['repo']}, ts {kinds['ts']}, id {kinds['id']}, before string, fingerprint string", "last string", "append", GroupStateTimeout.NoTimeout)


def stream_bursts(events: DataFrame, gap: str = DEBOUNCE, late: str = "1 second") -> DataFrame:
    """bursts() of a stream; a burst is given out once the watermark has passed its end."""
    return bursts(events.withWatermark("ts", late), gap)


def stream_hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Hourly counts of a stream of events (ts, method, duration_ms, status), final once the watermark has passed."""
    window = F.window(F.col("ts"), "1 hour")
    return events.withWatermark("ts", late).groupBy(window.alias("w"), "method").agg(F.count(F.lit(1)).alias("calls"), F.sum("duration_ms").alias("duration_ms"), F.max("duration_ms").alias("max_ms")).select(F.col("w.start").alias("hour"), "method", "calls", "duration_ms", "max_ms")
