"""Metrics, operation logs, job queues, change streams, routing."""

from pyspark.sql import functions as F

from graphloom.catalog.registry import Registry
from graphloom.functions import text
from graphloom.operators import aggregates, jobs, lookup
from graphloom.plans import playbooks
from graphloom.sources import tables
from graphloom.sources.tables import sql
from graphloom.streaming import changes

registry = query = Registry()


@query(sql("SELECT count(*) AS n FROM nodes WHERE type = 'function' AND repo_id = 3"))
def a01_count_nodes(spark, sf_dir):
    return lookup.scoped(tables.nodes(spark, sf_dir), "function", 3).agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT type, count(*) AS n FROM nodes GROUP BY type"))
def a02_count_by_type(spark, sf_dir):
    return aggregates.count_by_type(tables.nodes(spark, sf_dir))


@query("""
SELECT r_regionkey::BIGINT AS id, '/repos/' || lower(r_name) AS path, coalesce(n, 0) AS files, coalesce(t, '') AS last_indexed FROM region
LEFT JOIN (SELECT doc_id % 4 AS repo, count(*) AS n, max('2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0')) AS t FROM documents GROUP BY 1) ON repo = r_regionkey""")
def a03_ingestion_stats(spark, sf_dir):
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"))
    files = tables.read(spark, sf_dir, "documents").select((F.col("doc_id") % 4).alias("repo_id"), day.alias("indexed_at"))
    return aggregates.ingestion_stats(tables.repos(spark, sf_dir), files)


_EMBEDDED = "has AS (SELECT 'P:' || vec_id AS id FROM vectors)"


def embedded(spark, sf_dir):
    return tables.embeddings(spark, sf_dir).select(F.concat(F.lit("P:"), F.col("vec_id").cast("string")).alias("node_id"))


@query(sql("SELECT repo_id, total, embedded, total > 0 AS structural_ready, total > 0 AND embedded = total AS semantic_ready, CASE WHEN total = 0 THEN 'empty' WHEN embedded = 0 THEN 'no_vectors' WHEN embedded < total THEN 'vectors_missing' ELSE 'ready' END AS reason FROM (SELECT repo_id, count(*) AS total, count(h.id) AS embedded FROM files f LEFT JOIN has h ON h.id = f.id GROUP BY repo_id)", _EMBEDDED))
def a04_readiness(spark, sf_dir):
    return aggregates.readiness(tables.files(spark, sf_dir), embedded(spark, sf_dir))


@query(sql("SELECT n.repo_id, (SELECT count(*) FROM files f WHERE f.repo_id = n.repo_id) AS files, count(*) AS nodes, count(h.id) AS vectors FROM nodes n LEFT JOIN has h ON h.id = n.id GROUP BY n.repo_id", _EMBEDDED))
def a05_delete_counts(spark, sf_dir):
    return aggregates.dropped_counts(tables.files(spark, sf_dir), tables.nodes(spark, sf_dir), embedded(spark, sf_dir))


_HOURS = "hours AS (SELECT date_trunc('hour', ts) AS hour, CASE WHEN event_type IN ('click', 'error', 'purchase', 'signup', 'view') THEN event_type ELSE '' END AS method, count(*) AS calls, sum(greatest(coalesce(value, 0), 0)) AS duration_ms, count(*) FILTER (WHERE event_type = 'error') AS errors, max(greatest(coalesce(value, 0), 0)) AS max_ms FROM events GROUP BY 1, 2)"


def hours(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "error").otherwise("ok")
    return aggregates.hourly(e.select("ts", F.col("event_type").alias("method"), F.lit("").alias("repo"), F.lit("").alias("mode"), status.alias("status"), F.col("value").alias("duration_ms")))


@query(f"WITH {_HOURS} SELECT strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, method, calls, round(duration_ms, 4) AS duration_ms, errors::BIGINT AS errors, round(max_ms, 4) AS max_ms FROM hours")
def a06_hourly_metrics(spark, sf_dir):
    return hours(spark, sf_dir).select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "method", "calls", F.round("duration_ms", 4).alias("duration_ms"), "errors", F.round("max_ms", 4).alias("max_ms"))


@query(f"WITH {_HOURS} SELECT strftime(hour, '%Y-%m-%d %H') AS hour, method, calls FROM hours WHERE hour >= (SELECT max(hour) FROM hours) - INTERVAL 5 DAYS ORDER BY hours.hour DESC, method DESC LIMIT 100")
def a07_retention(spark, sf_dir):
    rows = hours(spark, sf_dir).withColumn("id", F.col("method"))
    last = rows.agg(F.max("hour")).first()[0]
    return aggregates.retained(rows, F.lit(last), 5, 100).select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "method", "calls")


@query(f"WITH {_HOURS} SELECT strftime(hour, '%Y-%m-%d %H') AS hour, method, sum(calls)::BIGINT AS calls, sum(errors)::BIGINT AS errors, round(max(max_ms), 4) AS max_ms FROM hours WHERE hour >= (SELECT max(hour) FROM hours) - INTERVAL 7 DAYS GROUP BY GROUPING SETS ((hour, method), ())")
def a08_metrics_report(spark, sf_dir):
    rows = hours(spark, sf_dir)
    return aggregates.report(rows, F.lit(rows.agg(F.max("hour")).first()[0])).select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "method", "calls", "errors", F.round("max_ms", 4).alias("max_ms"))


@query(sql("SELECT backend, operation, count(*) AS calls, count(error) AS errors, count(*) FILTER (WHERE duration_ms >= 100) AS slow, count(*) FILTER (WHERE duration_ms >= 500) AS critical, round(avg(duration_ms), 6) AS mean_ms, quantile_disc(duration_ms, 0.95) AS p95_ms, max(duration_ms) AS max_ms FROM ops GROUP BY backend, operation"))
def a09_operation_summaries(spark, sf_dir):
    return aggregates.operation_summaries(tables.operations(spark, sf_dir)).withColumn("mean_ms", F.round("mean_ms", 6))


@query(sql("SELECT id, backend, operation, duration_ms FROM (SELECT * FROM ops ORDER BY id DESC LIMIT 2000) WHERE duration_ms >= 20 AND backend = 'b1' AND error IS NULL ORDER BY id DESC LIMIT 200"))
def a10_operation_snapshot(spark, sf_dir):
    return aggregates.snapshot(tables.operations(spark, sf_dir), "b1", False, 20.0).select("id", "backend", "operation", "duration_ms")


@query(sql("SELECT (SELECT count(*) FROM kept) AS retained, (SELECT count(*) FROM ops) - (SELECT count(*) FROM kept) AS dropped, 2000 AS capacity, (SELECT count(*) FROM kept WHERE error IS NOT NULL) AS matching", "kept AS (SELECT * FROM ops ORDER BY id DESC LIMIT 2000)"))
def a10_operation_counters(spark, sf_dir):
    return aggregates.snapshot_counts(tables.operations(spark, sf_dir), failed=True)


@query("SELECT CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, count(*) AS n FROM events GROUP BY 1")
def a11_event_status_counts(spark, sf_dir):
    return aggregates.status_counts(tables.operations(spark, sf_dir))


@query("SELECT canonical, arg_max(id, (files, -id)) AS id, max(files) AS files, count(*) - 1 AS removed FROM (SELECT c_nationkey AS canonical, c_custkey AS id, round(c_acctbal)::BIGINT AS files FROM customer) GROUP BY canonical")
def a13_duplicate_repositories(spark, sf_dir):
    c = tables.read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("canonical"), F.col("c_custkey").alias("id"), F.round("c_acctbal").cast("long").alias("files"))
    return aggregates.largest_of_duplicates(c)


_REQUESTS = "requests AS (SELECT user_id AS repo, event_id AS position, CASE event_type WHEN 'view' THEN 'files' WHEN 'click' THEN 'files' WHEN 'error' THEN 'cleanup' WHEN 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 'full' ELSE 'files' END ELSE CASE WHEN event_id % 11 = 0 THEN 'force_full' WHEN event_id % 97 = 1 THEN 'drop_index' ELSE 'files' END END AS mode, 'f' || (event_id % 13) AS path FROM events)"


def requests(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events")
    i, kind = F.col("event_id"), F.col("event_type")
    mode = F.when(kind.isin("view", "click"), "files").when(kind == "error", "cleanup").when(kind == "signup", F.when(i % 3 == 0, "full").otherwise("files")).otherwise(F.when(i % 11 == 0, "force_full").when(i % 97 == 1, "drop_index").otherwise("files"))
    path = F.concat(F.lit("f"), (i % 13).cast("string"))
    return e.select(F.col("user_id").alias("repo"), i.alias("position"), mode.alias("mode"), F.array(path).alias("paths"), F.array().cast("array<string>").alias("deleted"), F.concat(F.lit("s"), i.cast("string")).alias("snapshot"))


@query(f"""WITH {_REQUESTS}, drops AS (SELECT repo, min(position) AS dropped FROM requests WHERE mode = 'drop_index' GROUP BY repo),
ranked AS (SELECT r.*, list_position(['cleanup', 'files', 'full', 'force_full', 'drop_index'], mode) - 1 AS r FROM requests r LEFT JOIN drops d USING (repo) WHERE dropped IS NULL OR position <= dropped OR mode = 'drop_index')
SELECT repo, ['cleanup', 'files', 'full', 'force_full', 'drop_index'][max(r) + 1] AS mode, CASE WHEN max(r) = 1 THEN string_agg(DISTINCT path, ',' ORDER BY path) ELSE '' END AS paths, CASE WHEN max(r) = 3 THEN 's' || max(CASE WHEN r = 3 THEN position END) END AS snapshot, count(*) AS requests FROM ranked GROUP BY repo""")
def t04_queue_coalescing(spark, sf_dir):
    return jobs.coalesced(requests(spark, sf_dir)).select("repo", "mode", F.array_join("paths", ",").alias("paths"), "snapshot", "requests")


_JOBS = "jobs AS (SELECT event_id AS id, user_id AS repo, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id // 2 END AS store_id, CASE WHEN event_id % 50 = 0 THEN 'running' WHEN event_id % 7 = 0 THEN 'failed' WHEN event_id % 3 = 0 THEN 'queued' ELSE 'done' END AS status, CASE WHEN event_id % 5 = 0 THEN 'cleanup' WHEN event_id % 31 = 0 THEN 'drop_index' ELSE 'files' END AS mode, ts AS created_at, ts + INTERVAL 1 HOUR AS updated_at, (event_id % 4)::INT AS attempts, CASE WHEN event_id % 100 = 0 THEN 'w' || (event_id % 3) END AS lease_owner FROM events), waits AS (SELECT repo, min_by(id, (created_at, id)) AS next_id, min_by(mode, (created_at, id)) AS waiting FROM jobs WHERE status = 'queued' GROUP BY repo), modes AS (SELECT ['cleanup', 'files', 'full', 'force_full', 'drop_index'] AS m)"


def queue(spark, sf_dir):
    i, u = F.col("event_id"), F.col("user_id")
    status = F.when(i % 50 == 0, "running").when(i % 7 == 0, "failed").when(i % 3 == 0, "queued").otherwise("done")
    mode = F.when(i % 5 == 0, "cleanup").when(i % 31 == 0, "drop_index").otherwise("files")
    return tables.read(spark, sf_dir, "events").select(i.alias("id"), u.alias("repo"), F.when(u % 3 != 0, F.floor(u / 2)).alias("store_id"), status.alias("status"), mode.alias("mode"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr("interval 1 hour")).alias("updated_at"), (i % 4).cast("int").alias("attempts"), F.col("ts").alias("lease_expires_at"), F.when(i % 100 == 0, F.concat(F.lit("w"), (i % 3).cast("string"))).alias("lease_owner"))


@query(f"WITH {_JOBS} SELECT id, store FROM (SELECT id, coalesce(store_id, repo) AS store, row_number() OVER (PARTITION BY coalesce(store_id, repo) ORDER BY (mode = 'cleanup')::INT, created_at, id) AS k FROM jobs WHERE status = 'queued' AND coalesce(store_id, repo) NOT IN (SELECT coalesce(store_id, repo) FROM jobs WHERE status = 'running')) WHERE k = 1")
def t05_claim_jobs(spark, sf_dir):
    return jobs.claimable(queue(spark, sf_dir)).select("id", "store")


_BACK = "CASE WHEN {merged} AND next_id IS NOT NULL THEN 'cancelled' WHEN {attempts} >= 3 THEN 'failed' ELSE 'queued' END AS next_status, CASE WHEN {merged} THEN next_id END AS next_id, CASE WHEN {merged} AND next_id IS NOT NULL THEN m[greatest(list_position(m, mode), list_position(m, waiting))] END AS next_mode"


@query(f"WITH {_JOBS} SELECT id, next_attempts, {_BACK.format(merged='true', attempts='next_attempts')} FROM (SELECT *, attempts + CASE WHEN lease_owner IS DISTINCT FROM 'w1' THEN 0 ELSE 1 END AS next_attempts FROM jobs WHERE status = 'running' AND (created_at < (SELECT max(ts) FROM events) - INTERVAL 1 DAY OR lease_owner IS DISTINCT FROM 'w1')) LEFT JOIN waits USING (repo), modes")
def t06_expired_leases(spark, sf_dir):
    rows = queue(spark, sf_dir)
    now = rows.agg(F.max("created_at")).first()[0]
    return jobs.expired(rows, F.lit(now) - F.expr("interval 1 day"), "w1").select("id", "next_attempts", "next_status", "next_id", "next_mode")


@query(f"WITH {_JOBS} SELECT id, next_attempts, {_BACK.format(merged='next_attempts < 3', attempts='next_attempts')} FROM (SELECT *, attempts + 1 AS next_attempts FROM jobs WHERE status = 'running') LEFT JOIN waits USING (repo), modes")
def t07_retry(spark, sf_dir):
    rows = queue(spark, sf_dir)
    return jobs.after_failure(rows.filter("status = 'running'"), rows).select("id", "next_attempts", "next_status", "next_id", "next_mode")


@query(f"WITH {_JOBS} SELECT id, CASE WHEN mode <> 'drop_index' THEN 'cancelled' ELSE 'completed' END AS status FROM jobs WHERE status = 'running'")
def t08_completed_after_cancel(spark, sf_dir):
    """Running jobs that a request to cancel all has met, as they end."""
    running = queue(spark, sf_dir).filter("status = 'running'")
    return jobs.completed(jobs.cancelled(running)).select("id", "status")


@query(f"WITH {_JOBS} SELECT s AS status, count(*) AS n FROM (SELECT CASE WHEN mode <> 'drop_index' AND status = 'queued' THEN 'cancelled' WHEN mode <> 'drop_index' AND status = 'running' THEN 'cancelling' ELSE status END AS s FROM jobs) GROUP BY s")
def t08_cancel_all(spark, sf_dir):
    return jobs.cancelled(queue(spark, sf_dir)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id AS job, 'f' || event_id AS path, CASE WHEN event_id % 5 = 0 THEN 'open' ELSE 'drift' END AS state FROM events WHERE event_id % 5 = 0 OR event_id % 17 = 0")
def t09_snapshot_acknowledgements(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events").select(F.col("user_id").alias("job"), "event_id", F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("path"), F.lit("h").alias("hash"))
    acks = e.filter("event_id % 5 <> 0").withColumn("hash", F.when(F.col("event_id") % 17 == 0, "other").otherwise("h"))
    return jobs.unacknowledged(e, acks)


@query(f"WITH {_JOBS} SELECT repo, id, status, mode FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY updated_at DESC, created_at DESC, id DESC) AS k FROM jobs) WHERE k = 1")
def w06_latest_job(spark, sf_dir):
    return jobs.latest(queue(spark, sf_dir))


@query(f"WITH {_JOBS} SELECT id, repo, status FROM jobs ORDER BY updated_at DESC, created_at DESC, id DESC LIMIT 200")
def l01_recent_jobs(spark, sf_dir):
    return jobs.recent(queue(spark, sf_dir), 1000).select("id", "repo", "status")


@query(f"WITH {_JOBS} SELECT id FROM jobs q WHERE status = 'queued' AND NOT EXISTS (SELECT 1 FROM jobs r WHERE r.status = 'running' AND coalesce(r.store_id, r.repo) = coalesce(q.store_id, q.repo))")
def j09_not_exists(spark, sf_dir):
    rows, store = queue(spark, sf_dir), F.coalesce("store_id", "repo")
    busy = rows.filter("status = 'running'").select(store.alias("store")).distinct()
    return rows.filter("status = 'queued'").withColumn("store", store).join(busy, "store", "left_anti").select("id")


@query(f"""WITH {_JOBS}, last AS (SELECT repo, status AS s FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY updated_at DESC, created_at DESC, id DESC) AS k FROM jobs) WHERE k = 1),
act AS (SELECT repo, count(*) AS active FROM jobs WHERE status IN ('running', 'queued') GROUP BY repo), st AS (SELECT doc_id % 300 AS repo, count(*) AS files FROM documents WHERE doc_id % 300 % 2 = 0 GROUP BY 1)
SELECT c_custkey AS repo, CASE WHEN active > 0 THEN 'indexing' WHEN s = 'failed' THEN 'failed' WHEN coalesce(files, 0) > 0 THEN 'ready' ELSE 'empty' END AS state, coalesce(active, 0) AS active, coalesce(files, 0) AS files
FROM customer LEFT JOIN act ON act.repo = c_custkey LEFT JOIN last ON last.repo = c_custkey LEFT JOIN st ON st.repo = c_custkey""")
def j10_repository_status(spark, sf_dir):
    repos = tables.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("repo"))
    stats = tables.read(spark, sf_dir, "documents").select((F.col("doc_id") % 300).alias("repo")).filter("repo % 2 = 0").groupBy("repo").agg(F.count(F.lit(1)).alias("files"))
    return jobs.repository_status(repos, queue(spark, sf_dir), stats)


def looks(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("repo"), "ts", F.col("event_id").alias("id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("fingerprint"))


@query("SELECT repo, id, before, fingerprint FROM (SELECT user_id AS repo, event_id AS id, event_type AS fingerprint, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WHERE event_type <> 'error') WHERE before IS NOT NULL AND before <> fingerprint")
def t01_change_detection(spark, sf_dir):
    return changes.changes(looks(spark, sf_dir)).select("repo", "id", "before", "fingerprint")


@query("SELECT repo, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS started, strftime(max(ts) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S.%f') AS flushed, count(*) AS changes FROM (SELECT *, sum(new) OVER (PARTITION BY repo ORDER BY ts, id) AS burst FROM (SELECT user_id AS repo, ts, event_id AS id, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 DAY THEN 1 ELSE 0 END AS new FROM events)) GROUP BY repo, burst")
def t02_debounce(spark, sf_dir):
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return changes.bursts(looks(spark, sf_dir), "1 day").select("repo", stamp("started"), stamp("flushed"), "changes")


@query("SELECT repo, id, least(30, 2 * pow(2, least(quiet, 10))) AS wait_s FROM (SELECT *, sum(CASE WHEN changed THEN 0 ELSE 1 END) OVER (PARTITION BY repo, streak ORDER BY ts, id) AS quiet FROM (SELECT user_id AS repo, event_id AS id, ts, event_type = 'purchase' AS changed, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS streak FROM events))")
def t03_backoff(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events").select(F.col("user_id").alias("repo"), "ts", F.col("event_id").alias("id"), (F.col("event_type") == "purchase").alias("changed"))
    return changes.waits(e).select("repo", "id", "wait_s")


@query("SELECT event_type AS topic, event_id AS id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id)::INT AS sequence FROM events")
def w05_topic_sequence(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events").select(F.col("event_type").alias("topic"), "ts", F.col("event_id").alias("id"))
    return changes.sequenced(e).select("topic", "id", "sequence")


@query("SELECT event_id AS id, 'repo_path=<redacted> query=<redacted> limit=' || (event_id % 50) || ' plain' AS detail FROM events")
def a16_redaction(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events")
    detail = F.concat(F.lit("repo_path=/Users/u"), F.col("user_id").cast("string"), F.lit(" query=secret limit="), (F.col("event_id") % 50).cast("string"), F.lit("  /etc/x plain"))
    return e.select(F.col("event_id").alias("id"), text.redacted(detail).alias("detail"))


@query("SELECT c_custkey AS id, (c_custkey % 3)::INT AS files, c_custkey % 2 = 0 AS anchored, CASE c_custkey % 4 WHEN 0 THEN 'file' WHEN 1 THEN 'class' END AS node_type, 'DISCOVER,UNDERSTAND,RELATIONSHIPS' || CASE WHEN c_custkey % 2 = 0 THEN ',REFERENCES' ELSE '' END || ',INSPECT_FILES' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ',IMPACT' END || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE ',INVENTORY' END AS eligible FROM customer")
def o01_eligible_playbooks(spark, sf_dir):
    k = F.col("c_custkey")
    rows = tables.read(spark, sf_dir, "customer").select(k.alias("id"), (k % 3).cast("int").alias("files"), (k % 2 == 0).alias("anchored"), F.when(k % 4 == 0, "file").when(k % 4 == 1, "class").alias("node_type"))
    return playbooks.eligible_columns(rows)


@query(sql("SELECT 'symbol' AS kind, id, name FROM nodes WHERE contains(lower(name), 'small ring') ORDER BY (lower(name) <> 'small ring')::INT, name, id LIMIT 10"))
def o05_playbook_discover(spark, sf_dir):
    rows, _, _ = playbooks.run(spark, tables.nodes(spark, sf_dir), tables.edges(spark, sf_dir), playbooks.Request("small ring"))
    return rows.select("kind", "id", "name")


class Chosen:
    """A provider that always decides for one playbook."""

    def __init__(self, playbook):
        self.playbook = playbook

    def classify(self, request):
        return playbooks.Decision(self.playbook, 0.9, {p: float(p == self.playbook) for p in playbooks.PLAYBOOKS})


@query(sql("SELECT 'reference' AS kind, id, name FROM nodes WHERE id <> 'P:40' AND id IN (SELECT source_id FROM edges WHERE target_id = 'P:40' AND relationship IN ('calls', 'imports', 'inherits', 'implements', 'references'))"))
def o06_playbook_references(spark, sf_dir):
    request = playbooks.Request("who uses it", node_ids=("P:40",))
    rows, _, _ = playbooks.run(spark, tables.nodes(spark, sf_dir), tables.edges(spark, sf_dir), request, Chosen("REFERENCES"))
    return rows.select("kind", "id", "name")


@query("WITH e AS (SELECT event_type AS topic, event_id AS id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id)::INT AS sequence, event_id % 40 = 39 AS terminal FROM events) SELECT topic, id, sequence FROM e JOIN (SELECT topic, min(CASE WHEN terminal THEN sequence END) AS last FROM e GROUP BY topic) USING (topic) WHERE last IS NULL OR sequence <= last")
def t10_events_until_terminal(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events").select(F.col("event_type").alias("topic"), "ts", F.col("event_id").alias("id"), (F.col("event_id") % 40 == 39).alias("terminal"))
    return changes.until_terminal(changes.sequenced(e)).select("topic", "id", "sequence")


@query(f"WITH {_JOBS} SELECT q.repo, q.id, CASE WHEN j.id IS NULL THEN 'not_found' WHEN j.status IN ('queued', 'running') THEN 'timeout' ELSE 'terminal' END AS outcome FROM (SELECT user_id AS repo, event_id + CASE WHEN event_id % 6 = 0 THEN 1 ELSE 0 END AS id FROM events) q LEFT JOIN jobs j ON j.id = q.id AND j.repo = q.repo")
def t12_wait_outcomes(spark, sf_dir):
    """Every sixth question is about another job than the repository's own."""
    i = F.col("event_id")
    asked = tables.read(spark, sf_dir, "events").select(F.col("user_id").alias("repo"), (i + F.when(i % 6 == 0, 1).otherwise(0)).alias("id"))
    return changes.outcomes(queue(spark, sf_dir), asked)


_ENDS = """own AS (SELECT * FROM nodes WHERE file_path = (SELECT file_path FROM files WHERE id = 'P:40')),
chosen AS (SELECT * FROM own ORDER BY CASE WHEN type IN ('class', 'function', 'method', 'variable', 'constant', 'type_alias') THEN 0 WHEN type IN ('file', 'module') THEN 1 ELSE 2 END, start_line, lower(name), id LIMIT 50),
around AS (SELECT c.id, e.* FROM chosen c JOIN edges e ON e.source_id = c.id UNION ALL SELECT c.id, e.* FROM chosen c JOIN edges e ON e.target_id = c.id),
first AS (SELECT * FROM around ORDER BY id, source_id, target_id, relationship LIMIT 100),
ends AS (SELECT DISTINCT unnest([source_id, target_id]) AS id FROM first)"""


@query(sql("SELECT 'symbol' AS kind, id, name FROM chosen UNION ALL SELECT * FROM (SELECT 'relationship', n.id, n.name FROM ends JOIN nodes n ON n.id = ends.id WHERE n.id NOT IN (SELECT id FROM chosen) ORDER BY n.id LIMIT 200)", _ENDS))
def o06_playbook_inspect(spark, sf_dir):
    path = tables.files(spark, sf_dir).filter("id = 'P:40'").first()["file_path"]
    request = playbooks.Request("what is in it", file_paths=(path,))
    return playbooks.run(spark, tables.nodes(spark, sf_dir), tables.edges(spark, sf_dir), request, Chosen("INSPECT_FILES"))[0].select("kind", "id", "name")


@query(sql("SELECT 'dependent' AS kind, n.id, n.name FROM nodes n JOIN (SELECT DISTINCT e.source_id AS id FROM edges e JOIN hit t ON t.id = e.target_id LEFT JOIN hit s ON s.id = e.source_id WHERE e.relationship IN ('calls', 'imports', 'inherits') AND s.id IS NULL) d ON d.id = n.id", "hit AS (SELECT DISTINCT id FROM nodes WHERE file_path = (SELECT file_path FROM files WHERE id = 'P:40'))"))
def o06_playbook_impact(spark, sf_dir):
    path = tables.files(spark, sf_dir).filter("id = 'P:40'").first()["file_path"]
    request = playbooks.Request("what breaks", file_paths=(path,))
    return playbooks.run(spark, tables.nodes(spark, sf_dir), tables.edges(spark, sf_dir), request, Chosen("IMPACT"))[0].select("kind", "id", "name")


@query(sql("SELECT 'symbol' AS kind, id, name FROM (SELECT * FROM nodes WHERE type = 'class' ORDER BY id LIMIT 10)"))
def o06_playbook_inventory(spark, sf_dir):
    request = playbooks.Request("list classes", node_type="class")
    return playbooks.run(spark, tables.nodes(spark, sf_dir), tables.edges(spark, sf_dir), request, Chosen("INVENTORY"))[0].select("kind", "id", "name")


_AROUND = """up AS (SELECT source_id AS a, target_id AS b FROM edges WHERE relationship IS NOT NULL), one AS (SELECT DISTINCT b AS id FROM up WHERE a = 'S:2' UNION SELECT DISTINCT a FROM up WHERE b = 'S:2'),
two AS (SELECT DISTINCT b AS id FROM up JOIN (SELECT DISTINCT b AS m FROM up WHERE a = 'S:2') ON a = m UNION SELECT DISTINCT a FROM up JOIN (SELECT DISTINCT a AS m FROM up WHERE b = 'S:2') ON b = m),
near AS (SELECT 'S:2' AS id UNION SELECT id FROM one UNION SELECT id FROM two)"""


@query(sql("SELECT 'node' AS kind, id, name FROM (SELECT n.id, n.name FROM nodes n JOIN near USING (id) ORDER BY id LIMIT 200)", _AROUND))
def o06_playbook_relationships(spark, sf_dir):
    request = playbooks.Request("what is around it", node_ids=("S:2",))
    return playbooks.run(spark, tables.nodes(spark, sf_dir), tables.edges(spark, sf_dir), request, Chosen("RELATIONSHIPS"))[0].select("kind", "id", "name")


@query(sql("SELECT 'symbol' AS kind, id, name FROM (SELECT id, name FROM nodes WHERE contains(lower(name), 'supplier#000000002') ORDER BY (lower(name) <> 'supplier#000000002')::INT, name, id LIMIT 10) UNION ALL SELECT 'node', id, name FROM (SELECT n.id, n.name FROM nodes n JOIN near USING (id) ORDER BY id LIMIT 200)", _AROUND))
def o06_playbook_understand(spark, sf_dir):
    request = playbooks.Request("Supplier#000000002", node_ids=("S:2",))
    return playbooks.run(spark, tables.nodes(spark, sf_dir), tables.edges(spark, sf_dir), request, Chosen("UNDERSTAND"))[0].select("kind", "id", "name")


_CONV = "items AS (SELECT conv_id, role, turn, text FROM conversations)"


@query(f"WITH {_CONV} SELECT conv_id, role, min(turn) AS position, max_by(text, turn) AS text FROM items GROUP BY conv_id, role")
def w04_first_position_last_value(spark, sf_dir):
    c = tables.read(spark, sf_dir, "conversations").select("conv_id", "role", F.col("turn").alias("position"), "text")
    return playbooks.deduplicated(c, ("conv_id", "role"))


@query("SELECT role, min(conv_id * 100 + turn) AS first_seen FROM conversations GROUP BY role")
def w03_first_seen(spark, sf_dir):
    c = tables.read(spark, sf_dir, "conversations").select("role", (F.col("conv_id") * 100 + F.col("turn")).alias("first_seen"))
    return lookup.last_per(c, ["role"], F.col("first_seen").asc())


@query(f"WITH {_JOBS} SELECT id, mode, status, NULL::VARCHAR AS phase, NULL::VARCHAR AS current, NULL::VARCHAR AS total, NULL::VARCHAR AS message, attempts, NULL::VARCHAR AS error, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at, strftime(updated_at, '%Y-%m-%dT%H:%M:%SZ') AS updated_at, NULL::VARCHAR AS finished_at FROM jobs")
def p22_job_summary(spark, sf_dir):
    return jobs.summaries(queue(spark, sf_dir))


@query("SELECT event_id AS id, NOT (event_id % 4 = 0 OR event_id % 9 = 0 OR event_id % 10 = 0) AS complete FROM events")
def o07_completeness(spark, sf_dir):
    i = F.col("event_id")
    return tables.read(spark, sf_dir, "events").select(i.alias("id"), playbooks.complete(i % 4 == 0, i % 9 == 0, i % 10 == 0).alias("complete"))
