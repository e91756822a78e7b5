"""Retrieval quality, routing quality and acceptance gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gain(grade: Column) -> Column:
    return F.pow(F.lit(2.0), grade.cast("double")) - 1


def matched(results: DataFrame, judgments: DataFrame) -> DataFrame:
    """Results (case_id, rank, qualified_name, file_path) with the grade of their judgment (case_id, pos, qualified_name,
    file_path or null, grade).

    A judgment is used once, by the first result that it fits; a result takes its first open judgment. With one judgment
    per name this is the first result of each name; more of a name are taken in order.
    """
    j = judgments.select("case_id", F.col("pos"), F.col("qualified_name").alias("name"), F.col("file_path").alias("path"), "grade")
    met = results.join(j.withColumnRenamed("case_id", "of"), (F.col("case_id") == F.col("of")) & (F.col("qualified_name") == F.col("name")) & (F.col("path").isNull() | (F.col("file_path") == F.col("path"))))
    # The n-th result of a (case, name, scope) takes its n-th judgment.
    group = ("case_id", "name", "path")
    by_rank = F.dense_rank().over(Window.partitionBy(*group).orderBy("rank"))
    by_pos = F.dense_rank().over(Window.partitionBy(*group).orderBy("pos"))
    taken = met.withColumn("a", by_rank).withColumn("b", by_pos).filter("a = b")
    return taken.groupBy("case_id", "rank").agg(F.min_by(F.struct("pos", "grade"), "pos").alias("m")).select("case_id", "rank", "m.pos", "m.grade")


def retrieval(results: DataFrame, judgments: DataFrame, k: int) -> DataFrame:
    """By case: recall at k, reciprocal rank of the first relevant result at any rank, nDCG at k."""
    hit = matched(results, judgments.filter("grade >= 1"))
    found = hit.groupBy("case_id").agg(
        F.sum((F.col("rank") <= k).cast("long")).alias("hits"),
        F.min("rank").alias("first"),
        F.sum(F.when(F.col("rank") <= k, gain(F.col("grade")) / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("grade"), "pos"))
    ideal = judgments.filter("grade >= 1").withColumn("place", place)
    ideal = ideal.groupBy("case_id").agg(F.count(F.lit(1)).alias("relevant"), F.sum(F.when(F.col("place") <= k, gain(F.col("grade")) / F.log2(F.col("place") + 1)).otherwise(0.0)).alias("ideal"))
    zero = F.lit(0.0)
    return ideal.join(found, "case_id", "left").select(
        "case_id", F.coalesce(F.col("hits") / F.col("relevant"), zero).alias("recall"), F.coalesce(1.0 / F.col("first"), zero).alias("reciprocal_rank"), F.coalesce(F.col("dcg") / F.col("ideal"), zero).alias("ndcg")
    )


def summary(cases: DataFrame, latencies: DataFrame) -> DataFrame:
    """One row: means over cases and latency's mean and nearest-rank percentiles."""
    q = cases.agg(F.avg("recall").alias("recall"), F.avg("reciprocal_rank").alias("mrr"), F.avg("ndcg").alias("ndcg"))
    t = latencies.agg(F.avg("latency_ms").alias("mean_ms"), nearest_rank("latency_ms", 0.5).alias("p50_ms"), nearest_rank("latency_ms", 0.95).alias("p95_ms"))
    return q.join(F.broadcast(t), F.lit(True))


def nearest_rank(column: str, share: float) -> Column:
    return F.expr(f"percentile_disc({share}) within group (order by {column})")


# Kinds of evidence, in the order in which they rank.
CATEGORIES = ("symbols", "files", "references", "relationships", "test_targets")


def identities(evidence: DataFrame) -> DataFrame:
    """(case_id, identity, rank) of evidence (case_id, category, rank, file_path, metadata: map, qualified_name, id).

    An item is known by its own file path, its metadata's, its qualified name or its id, the first that isn't empty. Items
    rank by category and then by their rank in it; an identity is there once, at its first place.
    """
    full = lambda c: F.nullif(c, F.lit(""))
    known = F.coalesce(full(F.col("file_path")), full(F.col("metadata").getItem("file_path")), full(F.col("qualified_name")), full(F.col("id")))
    place = F.struct(F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category")).alias("category"), "rank")
    first = evidence.select("case_id", known.alias("identity"), place.alias("place")).filter("identity is not null").groupBy("case_id", "identity").agg(F.min("place").alias("place"))
    return first.select("case_id", "identity", F.row_number().over(Window.partitionBy("case_id").orderBy("place", "identity")).alias("rank"))


def unified(identities: DataFrame, judgments: DataFrame, k: int) -> DataFrame:
    """By case, over its first k different identities (rank, identity) against judgments (case_id, identity, grade):
    recall, reciprocal rank within k, nDCG at k, and the share that no judgment has."""
    first = identities.groupBy("case_id", "identity").agg(F.min("rank").alias("rank"))
    first = first.withColumn("place", F.row_number().over(Window.partitionBy("case_id").orderBy("rank", "identity"))).filter(F.col("place") <= k)
    known = judgments.groupBy("case_id", "identity").agg(F.max("grade").alias("grade")).filter("grade > 0")
    hits = first.join(known, ["case_id", "identity"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    hit = F.col("grade") > 0
    by = hits.groupBy("case_id").agg(
        F.sum(hit.cast("long")).alias("hits"),
        F.coalesce(1.0 / F.min(F.when(hit, F.col("place"))), F.lit(0.0)).alias("reciprocal_rank"),
        F.sum(gain(F.col("grade")) / F.log2(F.col("place") + 1)).alias("dcg"),
        F.avg((~hit).cast("double")).alias("unsupported_rate"),
    )
    order = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("grade"), "identity"))
    ideal = known.withColumn("place", order).groupBy("case_id").agg(F.count(F.lit(1)).alias("relevant"), F.sum(F.when(F.col("place") <= k, gain(F.col("grade")) / F.log2(F.col("place") + 1)).otherwise(0.0)).alias("ideal"))
    zero = F.lit(0.0)
    return ideal.join(by, "case_id", "left").select("case_id", F.coalesce(F.col("hits") / F.col("relevant"), zero).alias("recall"), F.coalesce("reciprocal_rank", zero).alias("reciprocal_rank"), F.coalesce(F.col("dcg") / F.col("ideal"), zero).alias("ndcg"), F.coalesce("unsupported_rate", zero).alias("unsupported_rate"))


def routing(observations: DataFrame) -> DataFrame:
    """Accuracy, recall and rates of trouble by expected playbook."""
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return observations.groupBy("expected_playbook").agg(
        F.count(F.lit(1)).alias("cases"), F.avg((F.col("playbook") == F.col("expected_playbook")).cast("double")).alias("accuracy"), F.avg("recall").alias("recall"), rate("fallback").alias("fallback_rate"), rate("timeout").alias("timeout_rate"), rate("truncated").alias("truncation_rate"), rate("degraded").alias("degradation_rate")
    )


def bucket(confidence: Column) -> Column:
    return F.least(F.lit(9), F.floor(confidence * 10)).cast("int")


def calibration(observations: DataFrame) -> DataFrame:
    """One row: expected calibration error over ten buckets of confidence, and the Brier score (confidence, correct)."""
    right = F.col("correct").cast("double")
    by = observations.groupBy(bucket(F.col("confidence")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(right).alias("accuracy"), F.avg("confidence").alias("sure"), F.sum(F.pow(F.col("confidence") - right, F.lit(2.0))).alias("squares"))
    return by.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("sure"))) / F.sum("n")).alias("ece"), (F.sum("squares") / F.sum("n")).alias("brier"))


def gates(now: DataFrame, legacy: DataFrame) -> DataFrame:
    """Whether a summary row passes against the legacy one, gate by gate."""
    both = now.select([F.col(c).alias(f"n_{c}") for c in now.columns]).join(F.broadcast(legacy.select([F.col(c).alias(f"l_{c}") for c in legacy.columns])), F.lit(True))
    # The gates' limits.
    checks = {
        "routing_accuracy": F.col("n_accuracy") >= 0.9,
        "evidence_recall": F.col("n_recall") >= F.col("l_recall") - 0.02,
        "evidence_ndcg": F.col("n_ndcg") >= F.col("l_ndcg") - 0.02,
        "call_reduction": F.col("n_calls") <= 0.5 * F.col("l_calls"),
        "byte_reduction": F.col("n_bytes") <= 0.75 * F.col("l_bytes"),
        "per_playbook_recall": F.col("n_least_playbook_recall") >= 0.8,
        "balanced_latency": F.col("n_p95_ms") < 5000,
        "classifier_latency": F.col("n_classifier_p95_ms") < 500,
    }
    return both.select(F.explode(F.array(*[F.struct(F.lit(k).alias("gate"), v.alias("passed")) for k, v in checks.items()])).alias("g")).select("g.*")
