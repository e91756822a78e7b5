"""Name search, vector search, fusion."""

from pyspark.sql import functions as F

from graphloom.catalog.registry import Registry
from graphloom.functions import text
from graphloom.operators import search
from graphloom.plans import hybrid
from graphloom.sources import tables
from graphloom.sources.tables import sql

registry = query = Registry()

_VECTOR = "list_transform(range(1, 65), lambda i: (i % 7 - 3)::DOUBLE)"
QUERY_VECTOR = [float(i % 7 - 3) for i in range(1, 65)]
_DOT = "list_dot_product({0}, {1})"
_COS = "1 - list_dot_product(vector, q) / (sqrt(list_dot_product(vector, vector)) * sqrt(list_dot_product(q, q)))"
_LEXICAL = "SELECT id, name, row_number() OVER (ORDER BY (lower(name) <> 'small ring')::INT, name, id) AS rank FROM files WHERE contains(lower(name), 'ring') QUALIFY rank <= 40"
_SEMANTIC = f"SELECT 'P:' || vec_id AS id, {_COS} AS distance, row_number() OVER (ORDER BY {_COS}, node_id) AS rank FROM vectors, (SELECT {_VECTOR} AS q) QUALIFY rank <= 40"
_LISTS = f"lexical AS ({_LEXICAL}), semantic AS ({_SEMANTIC}), lists AS (SELECT 'lexical' AS source, rank, id, NULL::DOUBLE AS distance FROM lexical UNION ALL SELECT 'semantic', rank, id, distance FROM semantic), fused AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(CASE WHEN source = 'semantic' THEN distance END) AS distance, string_agg(source, '+' ORDER BY source) AS sources FROM lists GROUP BY id)"


def lists(spark, sf_dir):
    vectors = tables.embeddings(spark, sf_dir).withColumn("id", F.concat(F.lit("P:"), F.col("vec_id").cast("string")))
    return hybrid.lists(tables.files(spark, sf_dir), vectors, "ring", "small ring", QUERY_VECTOR, 10)


@query(sql("SELECT id, name, type FROM nodes WHERE contains(lower(name), 'ring') ORDER BY (lower(name) <> 'ring')::INT, name, id LIMIT 50"))
def v01_search_by_name(spark, sf_dir):
    return search.by_name(tables.nodes(spark, sf_dir), "Ring", 50).select("id", "name", "type")


@query(sql(f"SELECT node_id, round({_COS}, 6) AS distance FROM vectors, (SELECT {_VECTOR} AS q) ORDER BY {_COS}, node_id LIMIT 25"))
def v02_search_by_vector(spark, sf_dir):
    return search.by_vector(tables.embeddings(spark, sf_dir), QUERY_VECTOR, 25).select("node_id", F.round("distance", 6).alias("distance"))


@query(sql(f"SELECT node_id, round(d, 6) AS distance FROM (SELECT node_id, sqrt(list_sum(list_transform(list_zip(vector, q), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS d FROM vectors, (SELECT {_VECTOR} AS q) WHERE label = 3) ORDER BY d, node_id LIMIT 10"))
def v02_search_by_vector_l2(spark, sf_dir):
    return search.by_vector(tables.embeddings(spark, sf_dir).filter("label = 3"), QUERY_VECTOR, 10, "l2").select("node_id", F.round("distance", 6).alias("distance"))


@query(sql("""
SELECT query_index, rank::INT AS rank, node_id, round(distance, 6) + 0.0 AS distance FROM (
  SELECT q.vec_id AS query_index, v.node_id, 1 - list_dot_product(v.vector, q.vector) / (sqrt(list_dot_product(v.vector, v.vector)) * sqrt(list_dot_product(q.vector, q.vector))) AS distance,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(1 - list_dot_product(v.vector, q.vector) / (sqrt(list_dot_product(v.vector, v.vector)) * sqrt(list_dot_product(q.vector, q.vector))), 9), v.node_id) AS rank
  FROM vectors v, vectors q WHERE q.vec_id % 50 = 0) WHERE rank <= 8"""))
def v02_many_vectors(spark, sf_dir):
    """Queries that grow with the table: each vector whose id is divisible by 50, against all."""
    vectors = tables.embeddings(spark, sf_dir)
    queries = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_index"), F.col("vector").alias("query"))
    return search.by_vectors(vectors, queries, 8).select("query_index", "rank", "node_id", (F.round("distance", 6) + 0.0).alias("distance"))


@query(sql("""
SELECT id, type, name FROM (
  SELECT *, max(exact) OVER () AS any_exact FROM (
    SELECT id, type, name, (lower(name) = 'supplier#000000003')::INT AS exact, row_number() OVER (PARTITION BY type ORDER BY (lower(name) <> 'supplier#000000003')::INT, name, id) AS k
    FROM nodes WHERE type IN ('class', 'function') AND contains(lower(name), 'supplier#000000003')) WHERE k <= 20)
WHERE exact = 1 OR any_exact = 0 ORDER BY (lower(name) <> 'supplier#000000003')::INT, name, id LIMIT 20"""))
def v03_symbol_lookup(spark, sf_dir):
    return search.symbol_matches(tables.nodes(spark, sf_dir), "Supplier#000000003", ("class", "function")).select("id", "type", "name")


@query("SELECT l AS result_limit, least(200, greatest(20, 4 * l)) AS candidates FROM (SELECT unnest([1, 5, 10, 49, 50, 51, 200]) AS l)")
def h01_candidate_budget(spark, sf_dir):
    return spark.createDataFrame([(n, search.candidates(n)) for n in (1, 5, 10, 49, 50, 51, 200)], "result_limit int, candidates int")


@query(sql("SELECT id, round(score, 6) AS score, round(distance, 6) AS distance, sources FROM fused ORDER BY round(fused.score, 12) DESC, id LIMIT 10", _LISTS))
def h02_rrf_fusion(spark, sf_dir):
    return hybrid.top(search.fused(lists(spark, sf_dir)), 10).select("id", F.round("score", 6).alias("score"), F.round("distance", 6).alias("distance"), "sources")


@query(sql("""
SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, string_agg(DISTINCT q::VARCHAR, ',' ORDER BY q::VARCHAR) AS queries FROM (
  SELECT 0 AS q, id, row_number() OVER (ORDER BY name, id) AS rank FROM files WHERE contains(lower(name), 'ring') QUALIFY rank <= 100
  UNION ALL SELECT 1, id, row_number() OVER (ORDER BY name, id) FROM files WHERE contains(lower(name), 'red') QUALIFY row_number() OVER (ORDER BY name, id) <= 100
  UNION ALL SELECT 2, id, row_number() OVER (ORDER BY name, id) FROM files WHERE contains(lower(name), 'small') QUALIFY row_number() OVER (ORDER BY name, id) <= 100) GROUP BY id"""))
def h03_multi_query_merge(spark, sf_dir):
    files, out = tables.files(spark, sf_dir), None
    for k, word in enumerate(search.effective_queries(["ring", "red", "ring ", "small"])):
        found = search.by_name(files, word, 100).select("id", "name")
        rows = search.ranked(found, F.col("name"), F.col("id")).select(F.lit(k).alias("query_index"), "id", "rank", F.lit("lexical").alias("source"), F.lit(None).cast("double").alias("distance"))
        out = rows if out is None else out.unionByName(rows)
    merged = search.merged(search.fused(out, ("query_index",)))
    return merged.select("id", F.round("score", 6).alias("score"), F.array_join(F.col("query_indexes").cast("array<string>"), ",").alias("queries"))


@query(sql("SELECT CASE WHEN bool_or(contains(sources, 'semantic')) AND bool_or(contains(sources, 'lexical')) THEN 'hybrid_reranked' WHEN bool_or(contains(sources, 'semantic')) THEN 'semantic_reranked' WHEN bool_or(contains(sources, 'lexical')) THEN 'lexical_reranked' ELSE 'none' END AS mode, count(*) AS n FROM fused", _LISTS))
def h05_retrieval_mode(spark, sf_dir):
    fused = search.fused(lists(spark, sf_dir))
    return fused.agg(F.array_join(F.collect_set("sources"), " ").alias("s"), F.count(F.lit(1)).alias("n")).select(search.mode(F.col("s"), True).alias("mode"), "n")


@query(sql("SELECT id, rerank_score FROM (SELECT id, (regexp_extract(id, '[0-9]+')::BIGINT * 7919 % 1009)::INT AS rerank_score FROM fused) ORDER BY rerank_score DESC, id LIMIT 10", _LISTS))
def h06_rerank(spark, sf_dir):
    score = F.regexp_extract("id", "[0-9]+", 0).cast("long") * 7919 % 1009
    found = hybrid.finished(search.fused(lists(spark, sf_dir)), 10, "thorough", lambda rows, seconds: rows.select("id", score.cast("int").alias("rerank_score")))
    return found.results.select("id", "rerank_score")


_ANSWERS = """answers AS (SELECT user_id AS case_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS position, (event_id % 23)::INT - 1 AS index, CASE WHEN event_id % 29 = 0 THEN NULL ELSE value END AS score FROM events),
flagged AS (SELECT *, lag(score) OVER (PARTITION BY case_id ORDER BY position) AS before, count(*) OVER (PARTITION BY case_id, index) AS times FROM answers)"""


@query(f"""WITH {_ANSWERS} SELECT * FROM (SELECT case_id, position, CASE WHEN index < 0 OR index >= 21 THEN 'index out of range' WHEN times > 1 THEN 'index repeats' WHEN score IS NULL OR NOT isfinite(score) THEN 'score not finite' WHEN score > before THEN 'scores increase' END AS problem FROM flagged) WHERE problem IS NOT NULL
UNION ALL SELECT case_id, NULL, 'wrong number of results' FROM answers GROUP BY case_id HAVING count(*) <> 10""")
def h07_rerank_contract(spark, sf_dir):
    """Each user's events as an answer about 21 documents of which 10 were asked for."""
    e, i = tables.read(spark, sf_dir, "events"), F.col("event_id")
    position = search.ranked(e, i, by=("user_id",)).select(F.col("user_id").alias("case_id"), (F.col("rank") - 1).alias("position"), ((i % 23).cast("int") - 1).alias("index"), F.when(i % 29 != 0, F.col("value")).alias("score"))
    return search.rerank_errors(position, 21, 10)


@query(sql("""
SELECT target_id AS id, min(rank)::INT AS found_by FROM (
  SELECT r.rank, e.target_id, row_number() OVER (PARTITION BY e.source_id ORDER BY e.target_id, e.relationship) AS k FROM results r JOIN edges e ON e.source_id = r.id)
WHERE k <= 20 AND target_id NOT IN (SELECT id FROM results) GROUP BY target_id""", _LISTS + ", results AS (SELECT id, row_number() OVER (ORDER BY round(score, 12) DESC, id) AS rank FROM fused QUALIFY rank <= 10)"))
def h08_neighbor_expansion(spark, sf_dir):
    best = hybrid.top(search.fused(lists(spark, sf_dir)), 10)
    results = search.ranked(best, F.desc(F.round("score", 12)), F.col("id")).select("rank", "id")
    return search.neighbors_of_results(results, tables.edges(spark, sf_dir))


_MATCHES = """found AS (SELECT 0 AS q, id, row_number() OVER (ORDER BY name, id) AS rank FROM files WHERE contains(lower(name), 'ring') QUALIFY row_number() OVER (ORDER BY name, id) <= 40
  UNION ALL SELECT 1, id, row_number() OVER (ORDER BY name, id) FROM files WHERE contains(lower(name), 'red') QUALIFY row_number() OVER (ORDER BY name, id) <= 40),
best AS (SELECT id, string_agg(q::VARCHAR, '+' ORDER BY q) AS queries FROM found GROUP BY id ORDER BY round(sum(1.0::DOUBLE / (60 + rank)), 12) DESC, id LIMIT 10)"""


@query(sql("SELECT (SELECT string_agg(id || ':' || queries, ',' ORDER BY id) FROM best) AS query_matches, (SELECT count(*) FROM found) AS lexical, 0::BIGINT AS semantic, NULL::VARCHAR AS degraded_stage, false AS timed_out", _MATCHES))
def h09_search_diagnostics(spark, sf_dir):
    files, found = tables.files(spark, sf_dir), None
    for k, word in enumerate(("ring", "red")):
        rows = search.ranked(search.by_name(files, word, 40), F.col("name"), F.col("id")).select(F.lit(k).alias("query_index"), "id", "rank", F.lit("lexical").alias("source"), F.lit(None).cast("double").alias("distance"))
        found = rows if found is None else found.unionByName(rows)
    best = hybrid.top(search.merged(search.fused(found, ("query_index",))), 10)
    out = search.diagnostics(best, found)
    text = F.transform(F.map_entries("query_matches"), lambda e: F.concat(e["key"], F.lit(":"), F.array_join(e["value"].cast("array<string>"), "+")))
    return out.select(F.array_join(text, ",").alias("query_matches"), "lexical", "semantic", "degraded_stage", "timed_out")


@query(sql("SELECT id, row_number() OVER (ORDER BY round(score, 12) DESC, id)::INT AS rank, 'rerank' AS degraded_stage, 'hybrid' AS mode FROM fused QUALIFY rank <= 10", _LISTS))
def h06_rerank_failure(spark, sf_dir):
    """A reranker that fails leaves the head of the fused list."""

    def broken(candidates, seconds):
        raise RuntimeError("the reranker is away")

    found = hybrid.finished(search.fused(lists(spark, sf_dir)), 10, "thorough", broken)
    return found.results.select("id", "rank", F.lit(found.degraded_stage).alias("degraded_stage"), F.lit(found.mode).alias("mode"))


@query("SELECT 'repository is not indexed' AS degraded_reason, 0::BIGINT AS n")
def h10_unindexed_repository(spark, sf_dir):
    return hybrid.unindexed(tables.files(spark, sf_dir).filter("repo_id = -1"))


@query("SELECT doc_id, substr(trim('file ' || doc_id || '.txt' || CASE WHEN coalesce(trim(text, ' '), '') = '' THEN '' ELSE chr(10) || trim(text, ' ') END), 1, 4096) AS doc FROM documents")
def p21_rerank_documents(spark, sf_dir):
    d = tables.read(spark, sf_dir, "documents")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select("doc_id", text.rerank_document(F.lit("file"), name, F.lit(""), F.lit(""), F.lit(None).cast("string"), F.col("text")).alias("doc"))


@query("SELECT doc_id, 'file: ' || doc_id || CASE WHEN coalesce(text, '') = '' THEN '' ELSE ': ' || substr(text, 1, 512) END AS embed FROM documents")
def p15_embed_text(spark, sf_dir):
    d = tables.read(spark, sf_dir, "documents")
    none = F.lit(None).cast("string")
    return d.select("doc_id", text.embed_text(F.lit("file"), none, F.col("doc_id").cast("string"), none, F.col("text"), none).alias("embed"))


@query("SELECT doc_id, substr(t, 1, list_max(list_filter(range(0, 512), lambda k: strlen(substr(t, 1, k)) <= 511))) AS head FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def p14_truncate_bytes(spark, sf_dir):
    d = tables.read(spark, sf_dir, "documents")
    return d.select("doc_id", text.cut_bytes(F.coalesce("text", F.lit("")), 511).alias("head"))
