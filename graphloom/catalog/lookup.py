"""Look-ups, lists, membership, identity."""

from pyspark.sql import functions as F

from graphloom.catalog.registry import Registry
from graphloom.functions import ids
from graphloom.operators import aggregates, lookup
from graphloom.sources import tables
from graphloom.sources.tables import sql

registry = query = Registry()


def some_ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


@query(sql("SELECT id, type, name, file_path FROM nodes WHERE id = 'P:17'"))
def f01_get_node(spark, sf_dir):
    return tables.nodes(spark, sf_dir).filter("id = 'P:17'").select("id", "type", "name", "file_path")


@query(sql("SELECT id, type, name, repo_id FROM nodes WHERE id IN ('P:1', 'S:3', 'C:5', 'N:7', 'O:11', 'none')"))
def f02_batch_get_nodes(spark, sf_dir):
    return lookup.by_ids(tables.nodes(spark, sf_dir), some_ids(spark, "P:1", "S:3", "C:5", "N:7", "O:11", "none", "P:1")).select("id", "type", "name", "repo_id")


@query(sql("SELECT id, name FROM nodes WHERE type = 'function' AND repo_id = 2 ORDER BY id LIMIT 50 OFFSET 100"))
def f03_list_nodes(spark, sf_dir):
    return lookup.page(tables.nodes(spark, sf_dir), 50, 100, "function", 2).select("id", "name")


@query(sql("SELECT vec_id AS id FROM (SELECT p_partkey AS vec_id FROM part) WHERE vec_id NOT IN (SELECT vec_id FROM vectors)"))
def f04_nodes_without_embeddings(spark, sf_dir):
    nodes = tables.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return lookup.without_embedding(nodes, tables.embeddings(spark, sf_dir).select(F.col("vec_id").alias("node_id")))


@query(sql("SELECT repo_id, qualified_name, min(id) AS id FROM functions WHERE ends_with(name, '_7') GROUP BY ALL"))
def f05_resolve_qualified_name(spark, sf_dir):
    nodes = tables.functions(spark, sf_dir)
    return lookup.first_by_qualified_name(nodes, nodes.filter(F.endswith("name", F.lit("_7"))))


@query(sql("SELECT file_path, count(*) AS n, min(id) AS first_id FROM nodes WHERE file_path IS NOT NULL GROUP BY file_path"))
def f06_node_ids_of_files(spark, sf_dir):
    return tables.nodes(spark, sf_dir).filter("file_path is not null").groupBy("file_path").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query(sql("SELECT DISTINCT repo_id, file_path FROM nodes WHERE file_path IS NOT NULL"))
def f07_file_paths(spark, sf_dir):
    return lookup.file_paths(tables.nodes(spark, sf_dir))


@query(sql("SELECT file_path, id FROM files"))
def f08_file_node_map(spark, sf_dir):
    return tables.files(spark, sf_dir).select("file_path", "id")


@query(sql("SELECT DISTINCT f.file_path FROM files f WHERE f.id NOT IN (SELECT 'P:' || vec_id FROM vectors)"))
def f09_files_of_unembedded_nodes(spark, sf_dir):
    vectors = tables.embeddings(spark, sf_dir).select(F.concat(F.lit("P:"), F.col("vec_id").cast("string")).alias("node_id"))
    return lookup.without_embedding(tables.files(spark, sf_dir), vectors).select("file_path").distinct()


_REPOS = "repos AS (SELECT r_regionkey::BIGINT AS id, '/repos/' || lower(r_name) AS path FROM region)"


@query(f"WITH {_REPOS}, new AS (SELECT DISTINCT '/repos/' || lower(n_name) AS path FROM nation WHERE '/repos/' || lower(n_name) NOT IN (SELECT path FROM repos)) SELECT id, path FROM repos UNION ALL SELECT (SELECT max(id) FROM repos) + row_number() OVER (ORDER BY path), path FROM new")
def f10_scopes(spark, sf_dir):
    """Repositories that are asked for by path are there afterwards."""
    asked = tables.read(spark, sf_dir, "nation").select(F.concat(F.lit("/repos/"), F.lower("n_name")).alias("path"))
    return lookup.scopes(tables.repos(spark, sf_dir), asked.union(tables.repos(spark, sf_dir).select("path")))


@query(f"WITH {_REPOS} SELECT r.id, a.path FROM (SELECT '/repos/' || lower(n_name) AS path FROM nation UNION ALL SELECT path FROM repos) a LEFT JOIN repos r USING (path) UNION ALL SELECT n_nationkey::BIGINT, r.path FROM nation LEFT JOIN repos r ON r.id = n_nationkey")
def f10_resolved_scopes(spark, sf_dir):
    repos, nation = tables.repos(spark, sf_dir), tables.read(spark, sf_dir, "nation")
    paths = nation.select(F.concat(F.lit("/repos/"), F.lower("n_name")).alias("path")).union(repos.select("path"))
    asked = paths.withColumn("id", F.lit(None).cast("long")).unionByName(nation.select(F.lit(None).cast("string").alias("path"), F.col("n_nationkey").cast("long").alias("id")))
    return lookup.resolved_scopes(repos, asked)


@query(sql("SELECT type, count(*) AS n FROM nodes WHERE NOT (type = 'commit' AND name = '5-LOW') GROUP BY type"))
def f11_delete_by_metadata(spark, sf_dir):
    return aggregates.count_by_type(lookup.without_metadata(tables.nodes(spark, sf_dir), "name", "5-LOW", "commit"))


@query("SELECT source, doc_id AS rel_path, sha256(coalesce(text, '')) AS content_hash FROM documents")
def f12_hash_map(spark, sf_dir):
    return tables.read(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("rel_path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))


@query(sql("""
SELECT file_path, line, id, start_line, end_line FROM (
  SELECT n.file_path, q.line, n.id, n.start_line, n.end_line, row_number() OVER (PARTITION BY n.file_path, q.line ORDER BY n.end_line - n.start_line, n.id) AS k
  FROM (SELECT file_path, line FROM files, (SELECT unnest([10, 120, 299]) AS line)) q
  JOIN nodes n ON n.file_path = q.file_path AND q.line BETWEEN n.start_line AND n.end_line) WHERE k = 1"""))
def f13_node_at_position(spark, sf_dir):
    positions = tables.files(spark, sf_dir).select("file_path", F.explode(F.array(*[F.lit(x).cast("int") for x in (10, 120, 299)])).alias("line"))
    return lookup.at_positions(tables.nodes(spark, sf_dir), positions).select("file_path", "line", "id", "start_line", "end_line")


@query(sql("""
SELECT f.file_path AS path, max_by(r.root, length(r.root)) AS parent FROM files f
JOIN (SELECT DISTINCT replace(p_brand, '#', '') AS root FROM part WHERE p_partkey % 2 = 0 UNION SELECT DISTINCT replace(p_brand, '#', '') || '/' || replace(p_type, ' ', '_') FROM part WHERE p_size > 25) r
ON starts_with(f.file_path, r.root || '/') GROUP BY f.file_path"""))
def f14_nearest_parent(spark, sf_dir):
    files = tables.files(spark, sf_dir).select(F.col("file_path").alias("path"))
    part = tables.read(spark, sf_dir, "part")
    brand, kind = F.replace(F.col("p_brand"), F.lit("#"), F.lit("")), F.replace(F.col("p_type"), F.lit(" "), F.lit("_"))
    roots = part.filter("p_partkey % 2 = 0").select(brand.alias("path")).union(part.filter("p_size > 25").select(F.concat_ws("/", brand, kind))).distinct()
    return lookup.nearest_parent(files, roots)


@query(sql("SELECT id, name, (SELECT count(*) FROM nodes WHERE type = 'class') AS total FROM nodes WHERE type = 'class' ORDER BY id LIMIT 20 OFFSET 40"))
def f15_symbol_list(spark, sf_dir):
    page, total = lookup.symbols(tables.nodes(spark, sf_dir), "class", 20, 40)
    return page.select("id", "name").join(F.broadcast(total), F.lit(True))


@query("SELECT vec_id::VARCHAR AS node_id, label::INT AS label FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT vec_id::VARCHAR, 99 FROM embeddings WHERE vec_id % 3 = 0")
def v04_embedding_upsert(spark, sf_dir):
    stored = tables.read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("node_id"), F.col("label").cast("int").alias("label"))
    return lookup.upserted(stored, stored.filter("cast(node_id as long) % 3 = 0").withColumn("label", F.lit(99)), ["node_id"])


@query(sql("SELECT count(*) FILTER (WHERE len(vector) <> 64) AS rejected_64, count(*) FILTER (WHERE len(vector) <> 3) AS rejected_3 FROM vectors"))
def v05_dimension_check(spark, sf_dir):
    vectors = tables.embeddings(spark, sf_dir)
    n = lambda d: lookup.dimension_errors(vectors, d).agg(F.count(F.lit(1)).alias(f"rejected_{d}"))
    return n(64).join(F.broadcast(n(3)), F.lit(True))


@query(sql("SELECT 'V:' || p_partkey AS id FROM part WHERE 'V:' || p_partkey NOT IN (SELECT node_id FROM vectors)"))
def v06_vectors_absent(spark, sf_dir):
    return lookup.absent(tables.read(spark, sf_dir, "part").select(F.concat(F.lit("V:"), F.col("p_partkey").cast("string")).alias("id")), tables.embeddings(spark, sf_dir))


@query(sql("""
SELECT source_id, target_id, relationship, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id
FROM (SELECT *, sha1(from_hex('a1b2c3d4e5f67890abcdef1234567890') || encode(source_id || ':' || target_id || ':' || relationship)) AS h FROM edges)"""))
def id01_edge_ids(spark, sf_dir):
    e = tables.edges(spark, sf_dir)
    return e.select("source_id", "target_id", "relationship", ids.edge_id(F.col("source_id"), F.col("target_id"), F.col("relationship")).alias("id"))


@query(sql("""
SELECT file_path, occurrence, substr(sha256(CASE WHEN occurrence < 1 THEN '' ELSE 'occurrence:' || occurrence || ':' END || 'repo:' || file_path || ':function:' || qualified_name), 1, 32) AS id
FROM (SELECT file_path, qualified_name, (row_number() OVER (PARTITION BY file_path, qualified_name ORDER BY id) - 1)::INT AS occurrence FROM functions)"""))
def p18_occurrence_ids(spark, sf_dir):
    from graphloom.operators.ingestion import occurrences

    rows = occurrences(tables.functions(spark, sf_dir), ("file_path", "qualified_name"), "id")
    return rows.select("file_path", "occurrence", ids.node_id(F.lit("repo"), F.col("file_path"), F.lit("function"), F.col("qualified_name"), F.col("occurrence")).alias("id"))


@query("SELECT c_custkey, substr(sha256('contributor:' || lower(c_name)), 1, 32) AS contributor, substr(sha256('file:repo:' || c_name), 1, 32) AS file, sha256(c_name) AS store FROM customer")
def id02_record_ids(spark, sf_dir):
    c = tables.read(spark, sf_dir, "customer")
    return c.select("c_custkey", ids.contributor_id(F.col("c_name")).alias("contributor"), ids.file_id(F.lit("repo"), F.col("c_name")).alias("file"), ids.store_id(F.col("c_name")).alias("store"))


def _hmac_sql(key: bytes, value: str) -> str:
    inner, outer = (bytes(b ^ pad for b in key.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))
    return f"substr(sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode({value})))), 1, 16)"


@query(f"SELECT c_custkey, CASE WHEN coalesce(n, '') = '' THEN '' ELSE {_hmac_sql(b'key', 'n')} END AS h FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_name END AS n FROM customer)")
def id03_keyed_hash(spark, sf_dir):
    """A ninth of the names are absent."""
    name = F.when(F.col("c_custkey") % 9 != 0, F.col("c_name"))
    return tables.read(spark, sf_dir, "customer").select("c_custkey", ids.keyed_hash(b"key", name).alias("h"))


@query(sql("SELECT 'symbol' AS kind, id, name, type AS node_type, coalesce(file_path, 'meta/' || id) AS file_path, start_line, end_line, 'search' AS stage FROM nodes"))
def p20_evidence(spark, sf_dir):
    """Nodes without a path of their own have one in their metadata."""
    from graphloom.plans import playbooks

    metadata = F.create_map(F.lit("file_path"), F.concat(F.lit("meta/"), "id"))
    rows = playbooks.evidence(tables.nodes(spark, sf_dir).withColumn("metadata", metadata), "symbol", "search")
    return rows.select("kind", "id", "name", "node_type", "file_path", "start_line", "end_line", "stage")
