"""Edges, neighbourhoods, traversal, inspection, impact."""

from pyspark.sql import functions as F

from graphloom.catalog.registry import Registry
from graphloom.operators import graph, search
from graphloom.plans import context
from graphloom.sources import tables
from graphloom.sources.tables import sql

registry = query = Registry()

SEEDS = ("P:40", "S:9", "N:3")
_SEEDS = "seeds AS (SELECT unnest(['P:40', 'S:9', 'N:3']) AS id)"


def seeds(spark, *names):
    return spark.createDataFrame([(n,) for n in names or SEEDS], "id string")


@query(sql("SELECT source_id, target_id, relationship, weight FROM edges WHERE source_id = 'S:9' OR target_id = 'S:9'"))
def g01_get_edges(spark, sf_dir):
    return graph.related(tables.edges(spark, sf_dir), seeds(spark, "S:9"), "both").select("source_id", "target_id", "relationship", "weight")


@query(sql("SELECT s.id, relationship, count(*) AS n, sum(weight) AS weight FROM seeds s JOIN (SELECT source_id AS id, * FROM edges UNION ALL SELECT target_id, * FROM edges) e ON e.id = s.id GROUP BY s.id, relationship", _SEEDS))
def g02_batch_get_edges(spark, sf_dir):
    return graph.related(tables.edges(spark, sf_dir), seeds(spark), "both").groupBy("id", "relationship").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))


@query(sql("SELECT id, other_id, relationship FROM (SELECT source_id AS id, target_id AS other_id, relationship, row_number() OVER (PARTITION BY source_id ORDER BY target_id, relationship) AS k FROM edges WHERE source_id IN (SELECT id FROM seeds)) WHERE k <= 5", _SEEDS))
def g03_neighbors(spark, sf_dir):
    return graph.neighbors(tables.edges(spark, sf_dir), seeds(spark), "out", limit=5)


_WALK = """, step AS (SELECT DISTINCT source_id AS here, target_id AS nxt FROM edges WHERE relationship IN ({rels})),
l0 AS (SELECT id AS seed, id, 0 AS depth, [id] AS path FROM seeds),
l1 AS (SELECT seed, nxt AS id, 1 AS depth, min(list_append(path, nxt)) AS path FROM l0 JOIN step ON here = id WHERE (seed, nxt) NOT IN (SELECT (seed, id) FROM l0) GROUP BY seed, nxt),
s1 AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1),
l2 AS (SELECT seed, nxt AS id, 2 AS depth, min(list_append(path, nxt)) AS path FROM l1 JOIN step ON here = id WHERE (seed, nxt) NOT IN (SELECT (seed, id) FROM s1) GROUP BY seed, nxt),
s2 AS (SELECT * FROM s1 UNION ALL SELECT * FROM l2),
l3 AS (SELECT seed, nxt AS id, 3 AS depth, min(list_append(path, nxt)) AS path FROM l2 JOIN step ON here = id WHERE (seed, nxt) NOT IN (SELECT (seed, id) FROM s2) GROUP BY seed, nxt),
s3 AS (SELECT * FROM s2 UNION ALL SELECT * FROM l3)"""


@query(sql("SELECT seed, id, depth, array_to_string(path, '>') AS path FROM s3", _SEEDS + _WALK.format(rels="'imports', 'contains', 'inherits'")))
def g04_traverse(spark, sf_dir):
    edges = tables.edges(spark, sf_dir, ("imports", "contains", "inherits"))
    return graph.traverse(edges, seeds(spark), 3).select("seed", "id", "depth", F.array_join("path", ">").alias("path"))


@query(sql("SELECT id, min(depth)::INT AS depth FROM s2 WHERE depth > 0 AND id NOT IN (SELECT id FROM seeds) GROUP BY id", "seeds AS (SELECT 'P:' || vec_id AS id FROM vectors WHERE vec_id IN (SELECT vec_id FROM vectors, (SELECT list_transform(range(1, 65), lambda i: (i % 7 - 3)::DOUBLE) AS q) ORDER BY 1 - list_dot_product(vector, q) / (sqrt(list_dot_product(vector, vector)) * sqrt(list_dot_product(q, q))), node_id LIMIT 5))" + _WALK.format(rels="'imports', 'contains'")))
def g05_graph_rag(spark, sf_dir):
    from graphloom.catalog.retrieval import QUERY_VECTOR

    vectors = tables.embeddings(spark, sf_dir)
    hits = search.by_vector(vectors, QUERY_VECTOR, 5).select(F.concat(F.lit("P:"), F.col("vec_id").cast("string")).alias("id"))
    return context.around(tables.edges(spark, sf_dir, ("imports", "contains")), hits, 2)


@query(sql("SELECT direction, id, depth FROM (SELECT 'out' AS direction, id, depth FROM s2 UNION ALL SELECT 'in', 'S:2', 0 UNION ALL SELECT 'in', source_id, 1 FROM edges WHERE relationship = 'inherits' AND target_id = 'S:2' UNION ALL SELECT 'in', e2.source_id, 2 FROM edges e1 JOIN edges e2 ON e2.target_id = e1.source_id WHERE e1.target_id = 'S:2' AND e1.relationship = 'inherits' AND e2.relationship = 'inherits')", "seeds AS (SELECT 'S:2' AS id)" + _WALK.format(rels="'inherits'")))
def g06_related(spark, sf_dir):
    return context.related(tables.edges(spark, sf_dir, ("inherits",)), seeds(spark, "S:2"), 2).select("direction", "id", "depth")


@query(sql("""
SELECT id, depth::INT AS depth, found_by FROM (SELECT id, depth, seed AS found_by, row_number() OVER (PARTITION BY id ORDER BY place, direction DESC, depth) AS k FROM (
  SELECT s2.*, 'out' AS direction FROM s2 UNION ALL
  SELECT id, id, 0, [id], 'in' FROM seeds UNION ALL SELECT * FROM i1 UNION ALL SELECT * FROM i2) w
  JOIN (SELECT id AS sid, row_number() OVER (ORDER BY id) AS place FROM seeds) p ON p.sid = w.seed) WHERE k = 1""",
    _SEEDS + _WALK.format(rels="'imports', 'inherits'") + """,
i1 AS (SELECT DISTINCT s.id AS seed, e.source_id AS id, 1 AS depth, [s.id] AS path, 'in' AS direction FROM seeds s JOIN edges e ON e.target_id = s.id AND e.relationship IN ('imports', 'inherits') WHERE e.source_id <> s.id),
i2 AS (SELECT DISTINCT i1.seed, e.source_id AS id, 2 AS depth, [i1.seed] AS path, 'in' AS direction FROM i1 JOIN edges e ON e.target_id = i1.id AND e.relationship IN ('imports', 'inherits') WHERE e.source_id <> i1.seed AND (i1.seed, e.source_id) NOT IN (SELECT (seed, id) FROM i1))"""))
def g07_graph_context(spark, sf_dir):
    ranked = search.ranked(seeds(spark), F.col("id")).select("id", F.col("rank").alias("place"))
    return context.graph_context(tables.edges(spark, sf_dir, ("imports", "inherits")), ranked, 2)


_INSPECT = """own AS (SELECT * FROM nodes WHERE file_path = (SELECT file_path FROM files WHERE id = 'P:40')),
chosen AS (SELECT * FROM own ORDER BY CASE WHEN type IN ('class', 'function', 'method', 'variable', 'constant', 'type_alias') THEN 0 WHEN type IN ('file', 'module') THEN 1 ELSE 2 END, start_line, lower(name), id LIMIT 10),
around AS (SELECT c.id, e.* FROM chosen c JOIN edges e ON e.source_id = c.id UNION ALL SELECT c.id, e.* FROM chosen c JOIN edges e ON e.target_id = c.id)"""


def _inspected(spark, sf_dir):
    path = tables.files(spark, sf_dir).filter("id = 'P:40'").first()["file_path"]
    return graph.inspect_file(tables.nodes(spark, sf_dir), tables.edges(spark, sf_dir), path, 10, 8)


@query(sql("SELECT id, type, start_line, (SELECT count(*) FROM own) > 10 AS truncated FROM chosen", _INSPECT))
def g08_inspect_file_nodes(spark, sf_dir):
    return _inspected(spark, sf_dir)[0].select("id", "type", "start_line", "truncated")


@query(sql("SELECT id, source_id, target_id, relationship, (SELECT count(*) FROM around) > 8 AS truncated FROM around ORDER BY id, source_id, target_id, relationship LIMIT 8", _INSPECT))
def g08_inspect_file_edges(spark, sf_dir):
    return _inspected(spark, sf_dir)[1].select("id", "source_id", "target_id", "relationship", "truncated")


_CHANGED = """changed AS (SELECT n.id FROM nodes n JOIN (SELECT DISTINCT file_path FROM files WHERE starts_with(file_path, 'Brand2/')) p ON p.file_path = n.file_path),
found AS (SELECT e.source_id AS id, string_agg(DISTINCT e.relationship, ',' ORDER BY e.relationship) AS relationships, count(*) AS links
  FROM edges e JOIN (SELECT DISTINCT id FROM changed) t ON t.id = e.target_id LEFT JOIN (SELECT DISTINCT id AS own FROM changed) s ON s.own = e.source_id
  WHERE e.relationship IN ('calls', 'imports', 'inherits', 'implements', 'references') AND s.own IS NULL GROUP BY e.source_id)"""


@query(sql("SELECT f.id, n.type, n.name, f.relationships, f.links, coalesce(contains(n.file_path, 'tests/') OR contains(n.file_path, 'test/') OR contains(n.file_path, 'test_'), false) AS is_test, (SELECT count(*) FROM found) AS total_dependents FROM (SELECT * FROM found ORDER BY id LIMIT 1000) f JOIN nodes n ON n.id = f.id", _CHANGED))
def g09_regression_risk(spark, sf_dir):
    paths = tables.files(spark, sf_dir).filter(F.startswith("file_path", F.lit("Brand2/"))).select("file_path")
    edges = tables.edges(spark, sf_dir, ("calls", "imports", "inherits"))
    return graph.regression_risk(tables.nodes(spark, sf_dir), edges, paths).select("id", "type", "name", "relationships", "links", "is_test", "total_dependents")


@query(sql("""
SELECT e.source_id, e.target_id, e.relationship, n.name AS source_name FROM (
  SELECT id FROM (SELECT n.id, row_number() OVER (PARTITION BY n.file_path, 25 ORDER BY n.end_line - n.start_line, n.id) AS k FROM nodes n WHERE 25 BETWEEN n.start_line AND n.end_line AND n.file_path IS NOT NULL) WHERE k = 1) t
JOIN edges e ON e.target_id = t.id JOIN nodes n ON n.id = e.source_id"""))
def g10_references_at_position(spark, sf_dir):
    positions = tables.files(spark, sf_dir).select("file_path", F.lit(25).alias("line"))
    return graph.references(tables.nodes(spark, sf_dir), tables.edges(spark, sf_dir), positions).select("source_id", "target_id", "relationship", "source_name")


@query(sql("SELECT source_id, target_id, relationship, max_by(weight, position) AS weight FROM (SELECT *, 1 AS position FROM edges WHERE relationship = 'inherits' UNION ALL SELECT source_id, target_id, relationship, weight + 5, 2 FROM edges WHERE relationship = 'inherits' AND source_id < 'S:3' UNION ALL SELECT 'S:1', 'gone', 'calls', 1, 3) WHERE source_id IN (SELECT id FROM nodes) AND target_id IN (SELECT id FROM nodes) GROUP BY ALL"))
def g12_upsert_edges(spark, sf_dir):
    old = tables.edges(spark, sf_dir, ("inherits",))
    new = old.filter("source_id < 'S:3'").withColumn("weight", F.col("weight") + 5)
    lost = spark.createDataFrame([("S:1", "gone", "calls", 1.0)], "source_id string, target_id string, relationship string, weight double")
    rows = old.withColumn("position", F.lit(1)).unionByName(new.withColumn("position", F.lit(2))).unionByName(lost.withColumn("position", F.lit(3)))
    return graph.accepted(rows, tables.nodes(spark, sf_dir))


@query(sql("SELECT (SELECT count(*) FROM nodes WHERE type <> 'class') AS nodes, (SELECT count(*) FROM edges WHERE source_id NOT IN (SELECT id FROM classes) AND target_id NOT IN (SELECT id FROM classes)) AS edges"))
def g13_delete_cascade(spark, sf_dir):
    vectors = tables.embeddings(spark, sf_dir)
    nodes, edges, _ = graph.deleted(tables.nodes(spark, sf_dir), tables.edges(spark, sf_dir), vectors, tables.classes(spark, sf_dir))
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).join(F.broadcast(edges.agg(F.count(F.lit(1)).alias("edges"))), F.lit(True))


@query(sql("SELECT relationship, count(*) AS n FROM edges WHERE NOT (source_id = 'S:9' AND target_id = 'S:3' AND relationship = 'inherits') GROUP BY relationship"))
def g14_delete_edge(spark, sf_dir):
    from graphloom.functions.ids import edge_id

    gone = edge_id(F.lit("S:9"), F.lit("S:3"), F.lit("inherits"))
    e = tables.edges(spark, sf_dir)
    return e.filter(edge_id(F.col("source_id"), F.col("target_id"), F.col("relationship")) != gone).groupBy("relationship").agg(F.count(F.lit(1)).alias("n"))

