"""Retrieval and routing quality."""

from pyspark.sql import functions as F

from graphloom.catalog.registry import Registry
from graphloom.operators import evaluation
from graphloom.sources import tables

registry = query = Registry()

# Orders are cases: their lines in line order are results, their lines with a discount are judged relevant.
_CASES = """results AS (SELECT l_orderkey AS case_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rank, 'p' || (l_partkey % 40) AS qualified_name FROM lineitem),
judged AS (SELECT l_orderkey AS case_id, 'p' || (l_partkey % 40) AS qualified_name, min(l_partkey) AS pos, max((l_suppkey % 3 + 1)::INT) AS grade FROM lineitem WHERE l_quantity > 20 GROUP BY 1, 2
  UNION ALL SELECT o_orderkey, 'p' || (o_custkey % 40 + 40), 1000000, 2 FROM orders WHERE o_orderkey % 3 = 0),
hits AS (SELECT r.case_id, min(r.rank) AS rank, j.grade FROM results r JOIN judged j ON j.case_id = r.case_id AND j.qualified_name = r.qualified_name GROUP BY r.case_id, j.qualified_name, j.grade),
ideal AS (SELECT case_id, count(*) AS relevant, sum(CASE WHEN place <= 3 THEN (pow(2, grade) - 1) / log2(place + 1) ELSE 0 END) AS best FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY grade DESC, pos) AS place FROM judged) GROUP BY case_id),
scored AS (SELECT i.case_id, coalesce(h.n / i.relevant, 0) AS recall, coalesce(1.0 / h.first, 0) AS reciprocal_rank, coalesce(h.dcg / i.best, 0) AS ndcg FROM ideal i LEFT JOIN (SELECT case_id, count(*) FILTER (WHERE rank <= 3) AS n, min(rank)::DOUBLE AS first, sum(CASE WHEN rank <= 3 THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) AS dcg FROM hits GROUP BY case_id) h USING (case_id))"""


def cases(spark, sf_dir):
    from graphloom.operators.search import ranked

    line, orders = tables.read(spark, sf_dir, "lineitem"), tables.read(spark, sf_dir, "orders")
    name = F.concat(F.lit("p"), (F.col("l_partkey") % 40).cast("string"))
    results = ranked(line, F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), by=("l_orderkey",)).select(F.col("l_orderkey").alias("case_id"), "rank", name.alias("qualified_name"), F.lit("f").alias("file_path"))
    judged = line.filter("l_quantity > 20").groupBy(F.col("l_orderkey").alias("case_id"), name.alias("qualified_name")).agg(F.min("l_partkey").alias("pos"), F.max((F.col("l_suppkey") % 3 + 1).cast("int")).alias("grade"))
    missing = orders.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("case_id"), F.concat(F.lit("p"), (F.col("o_custkey") % 40 + 40).cast("string")).alias("qualified_name"), F.lit(1000000).cast("long").alias("pos"), F.lit(2).alias("grade"))
    return results, judged.unionByName(missing).withColumn("file_path", F.lit(None).cast("string"))


@query(f"WITH {_CASES} SELECT case_id, round(recall, 6) AS recall, round(reciprocal_rank, 6) AS reciprocal_rank, round(ndcg, 6) AS ndcg FROM scored")
def e01_retrieval_metrics(spark, sf_dir):
    out = evaluation.retrieval(*cases(spark, sf_dir), 3)
    return out.select("case_id", *[F.round(c, 6).alias(c) for c in ("recall", "reciprocal_rank", "ndcg")])


@query(f"WITH {_CASES} SELECT round(avg(recall), 6) AS recall, round(avg(reciprocal_rank), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, (SELECT round(avg(value), 6) FROM events) AS mean_ms, (SELECT quantile_disc(value, 0.5) FROM events) AS p50_ms, (SELECT quantile_disc(value, 0.95) FROM events) AS p95_ms FROM scored")
def a12_quality_summary(spark, sf_dir):
    latencies = tables.read(spark, sf_dir, "events").select(F.col("value").alias("latency_ms"))
    out = evaluation.summary(evaluation.retrieval(*cases(spark, sf_dir), 3), latencies)
    return out.select(*[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg", "mean_ms")], "p50_ms", "p95_ms")


@query(f"""WITH {_CASES}, firsts AS (SELECT case_id, qualified_name, row_number() OVER (PARTITION BY case_id ORDER BY min(rank), qualified_name) AS place FROM results GROUP BY case_id, qualified_name),
graded AS (SELECT case_id, qualified_name, max(grade) AS grade FROM judged GROUP BY ALL),
met AS (SELECT f.case_id, place, coalesce(grade, 0) AS grade FROM firsts f LEFT JOIN graded USING (case_id, qualified_name) WHERE place <= 3),
by_case AS (SELECT case_id, count(*) FILTER (WHERE grade > 0) AS hits, coalesce(1.0::DOUBLE / min(place) FILTER (WHERE grade > 0), 0) AS rr, sum((pow(2, grade) - 1) / log2(place + 1)) AS dcg, avg((grade = 0)::INT) AS unsupported FROM met GROUP BY case_id),
best AS (SELECT case_id, count(*) AS relevant, sum(CASE WHEN k <= 3 THEN (pow(2, grade) - 1) / log2(k + 1) ELSE 0 END) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY grade DESC, qualified_name) AS k FROM graded) GROUP BY case_id)
SELECT case_id, round(coalesce(hits / relevant, 0), 6) AS recall, round(coalesce(rr, 0), 6) AS reciprocal_rank, round(coalesce(dcg / ideal, 0), 6) AS ndcg, round(coalesce(unsupported, 0), 6) AS unsupported_rate FROM best LEFT JOIN by_case USING (case_id)""")
def e02_unified_scores(spark, sf_dir):
    results, judged = cases(spark, sf_dir)
    out = evaluation.unified(results.withColumnRenamed("qualified_name", "identity"), judged.withColumnRenamed("qualified_name", "identity"), 3)
    return out.select("case_id", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


_SEEN = "seen AS (SELECT event_type AS expected_playbook, CASE WHEN event_id % 5 = 0 THEN 'other' ELSE event_type END AS playbook, (event_id % 101) / 100.0::DOUBLE AS confidence, event_id % 5 <> 0 AS correct, (event_id % 7) / 6.0::DOUBLE AS recall, event_id % 10 = 0 AS fallback, event_id % 20 = 0 AS timeout, event_id % 4 = 0 AS truncated, event_id % 9 = 0 AS degraded FROM events)"


def observations(spark, sf_dir):
    i = F.col("event_id")
    return tables.read(spark, sf_dir, "events").select(
        F.col("event_type").alias("expected_playbook"), F.when(i % 5 == 0, "other").otherwise(F.col("event_type")).alias("playbook"), ((i % 101) / F.lit(100.0)).alias("confidence"), (i % 5 != 0).alias("correct"), ((i % 7) / F.lit(6.0)).alias("recall"), *[(i % n == 0).alias(c) for n, c in ((10, "fallback"), (20, "timeout"), (4, "truncated"), (9, "degraded"))]
    )


@query(f"WITH {_SEEN} SELECT expected_playbook, count(*) AS cases, round(avg((playbook = expected_playbook)::INT), 6) AS accuracy, round(avg(recall), 6) AS recall, round(avg(fallback::INT), 6) AS fallback_rate, round(avg(timeout::INT), 6) AS timeout_rate, round(avg(truncated::INT), 6) AS truncation_rate, round(avg(degraded::INT), 6) AS degradation_rate FROM seen GROUP BY 1")
def e03_routing(spark, sf_dir):
    out = evaluation.routing(observations(spark, sf_dir))
    return out.select("expected_playbook", "cases", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


@query(f"WITH {_SEEN} SELECT round(sum(n * abs(accuracy - sure)) / sum(n), 6) AS ece, round(sum(squares) / sum(n), 6) AS brier FROM (SELECT least(9, floor(confidence * 10)) AS b, count(*) AS n, avg(correct::INT) AS accuracy, avg(confidence) AS sure, sum(pow(confidence - correct::INT, 2)) AS squares FROM seen GROUP BY 1)")
def e04_calibration(spark, sf_dir):
    out = evaluation.calibration(observations(spark, sf_dir))
    return out.select(F.round("ece", 6).alias("ece"), F.round("brier", 6).alias("brier"))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def e05_nearest_rank(spark, sf_dir):
    return tables.read(spark, sf_dir, "events").groupBy("event_type").agg(evaluation.nearest_rank("value", 0.5).alias("p50"), evaluation.nearest_rank("value", 0.95).alias("p95"))


@query("SELECT * FROM (VALUES ('routing_accuracy', true), ('evidence_recall', true), ('evidence_ndcg', false), ('call_reduction', true), ('byte_reduction', true), ('per_playbook_recall', true), ('balanced_latency', true), ('classifier_latency', false)) t(gate, passed)")
def e07_gates(spark, sf_dir):
    names = "accuracy double, recall double, ndcg double, calls double, bytes double, least_playbook_recall double, p95_ms double, classifier_p95_ms double"
    now = spark.createDataFrame([(0.95, 0.86, 0.7, 1.0, 5000.0, 0.8, 1885.6, 501.0)], names)
    return evaluation.gates(now, spark.createDataFrame([(1.0, 0.875, 0.774, 2.0, 20265.0, 0.9, 22664.9, 0.0)], names))


@query("""
SELECT case_id, identity, row_number() OVER (PARTITION BY case_id ORDER BY min(place), identity)::INT AS rank FROM (
  SELECT conv_id AS case_id, (CASE WHEN role = 'user' THEN 0 WHEN role = 'assistant' THEN 2 ELSE 4 END, turn) AS place,
    coalesce(CASE WHEN turn % 3 = 0 THEN 'f' || length(text) END, CASE WHEN turn % 3 = 1 THEN 'm' || length(text) END, CASE WHEN role = 'user' THEN 'q' || length(text) END, 'i' || turn) AS identity FROM conversations) GROUP BY case_id, identity""")
def e06_identities(spark, sf_dir):
    c, turn = tables.read(spark, sf_dir, "conversations"), F.col("turn")
    size = F.length("text").cast("string")
    category = F.when(F.col("role") == "user", "symbols").when(F.col("role") == "assistant", "references").otherwise("test_targets")
    metadata = F.when(turn % 3 == 1, F.create_map(F.lit("file_path"), F.concat(F.lit("m"), size)))
    rows = c.select(F.col("conv_id").alias("case_id"), category.alias("category"), turn.alias("rank"), F.when(turn % 3 == 0, F.concat(F.lit("f"), size)).otherwise("").alias("file_path"), metadata.alias("metadata"), F.when(F.col("role") == "user", F.concat(F.lit("q"), size)).alias("qualified_name"), F.concat(F.lit("i"), turn.cast("string")).alias("id"))
    return evaluation.identities(rows)
