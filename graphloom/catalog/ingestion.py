"""Discovery, change detection, planning, resolution, batches, provenance, parsing."""

from pyspark.sql import functions as F

from graphloom.catalog.registry import Registry
from graphloom.functions import parsing
from graphloom.operators import aggregates, discovery, ingestion, search
from graphloom.sources import snapshots, tables
from graphloom.sources.tables import sql

registry = query = Registry()

# Documents as the files of a corpus: a path of source, language and number.
_EXT = "['py', 'txt', 'css', 'min.js', 'go', 'bin']"
_FOLDER = "['src', 'vendor', 'node_modules', 'lib/cache', 'docs', 'tests']"
_FILES = f"corpus AS (SELECT doc_id, {_FOLDER}[1 + doc_id % 6] || '/' || coalesce(source, 'none') || '/f' || doc_id || '.' || {_EXT}[1 + (doc_id // 6) % 6] AS path, coalesce(text, '') AS content, strlen(coalesce(text, ''))::BIGINT AS size FROM documents)"


def corpus(spark, sf_dir):
    pick = lambda names, at: F.element_at(F.array(*[F.lit(n) for n in names]), (at + 1).cast("int"))
    d = tables.read(spark, sf_dir, "documents")
    folder = pick(["src", "vendor", "node_modules", "lib/cache", "docs", "tests"], F.col("doc_id") % 6)
    ext = pick(["py", "txt", "css", "min.js", "go", "bin"], F.floor(F.col("doc_id") / 6) % 6)
    path = F.concat(folder, F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("/f"), F.col("doc_id").cast("string"), F.lit("."), ext)
    content = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return d.select("doc_id", path.alias("path"), content.alias("content"), F.octet_length(content).cast("long").alias("size"))


@query(sql("SELECT path AS rel_path, CASE WHEN ends_with(path, '.py') THEN 'python' WHEN ends_with(path, '.css') THEN 'css' WHEN ends_with(path, '.js') THEN 'javascript' WHEN ends_with(path, '.go') THEN 'go' ELSE 'text' END AS language, size AS byte_size, sha256(content) AS content_hash FROM corpus WHERE NOT contains(path, 'node_modules/') AND size <= 1048576 AND NOT (size > 8192 AND substr(hex(encode(content)), 16385, 1) IN ('8', '9', 'A', 'B'))", _FILES))
def s01_discover(spark, sf_dir):
    """Also S4 to S6 and S12: skipped folders, text sniffing, languages and hashes."""
    return discovery.discovered(corpus(spark, sf_dir))


RULES = "# generated\n*.bin\n!keep.bin\n/vendor/\ndocs/**/f1*\nf?.css\n!f7.css\nlib/\n!lib/cache/src0/\n"


@query(sql("""SELECT path AS rel_path FROM corpus WHERE NOT contains(path, 'node_modules/') AND size <= 1048576 AND NOT (size > 8192 AND substr(hex(encode(content)), 16385, 1) IN ('8', '9', 'A', 'B'))
  AND NOT (ends_with(path, '.bin') OR starts_with(path, 'vendor/') OR starts_with(path, 'lib/') OR regexp_matches(path, '^docs/(.*/)?f1[^/]*$') OR (regexp_matches(path, '(^|/)f.\\.css$') AND NOT ends_with(path, '/f7.css')))""", _FILES))
def s03_ignored(spark, sf_dir):
    """Files that an ignore file's rules leave: exceptions, folders, anchors; nothing in an ignored folder comes back."""
    files = corpus(spark, sf_dir)
    gone = files.filter(discovery.ignored(F.col("path"), discovery.ignore_rules(RULES)))
    return discovery.discovered(files, ignored=gone).select("rel_path")


@query(sql("SELECT path, contains(path, '.min.') AS generated FROM corpus", _FILES))
def s07_generated_names(spark, sf_dir):
    return corpus(spark, sf_dir).select("path", discovery.generated_name(F.col("path")).alias("generated"))


@query(sql("""
SELECT folder, count(*) AS files, sum(size)::BIGINT AS bytes, round(avg(CASE WHEN k <= 64 THEN contains(path, '.min.')::INT END), 6) AS generated FROM (
  SELECT folder, path, size, row_number() OVER (PARTITION BY folder ORDER BY path) AS k FROM (
    SELECT split_part(path, '/', 1) AS folder, path, size FROM corpus UNION ALL SELECT regexp_replace(path, '/[^/]*$', ''), path, size FROM corpus
    UNION ALL SELECT 'lib/cache', path, size FROM corpus WHERE starts_with(path, 'lib/cache/'))) GROUP BY folder""", _FILES))
def s08_folder_statistics(spark, sf_dir):
    return aggregates.folders(corpus(spark, sf_dir)).select("folder", "files", F.col("bytes").cast("long").alias("bytes"), F.round("generated", 6).alias("generated"))


@query(sql("SELECT path FROM corpus WHERE NOT starts_with(path, 'vendor/') AND NOT starts_with(path, 'lib/cache/')", _FILES))
def s09_outside_pruned(spark, sf_dir):
    files = corpus(spark, sf_dir)
    # Limits small enough for these tables: folders of over 20 files that look generated go.
    gone = discovery.pruned_folders(aggregates.folders(files), max_files=20).filter("folder in ('vendor', 'lib/cache')")
    return discovery.outside(files, gone).select("path")


_CHILDREN = "children AS (SELECT folder, count(*) AS files, sum(size)::BIGINT AS bytes, avg(CASE WHEN k <= 64 THEN contains(path, '.min.')::INT END) AS generated FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY path) AS k FROM (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, path, size FROM corpus)) GROUP BY folder)"


@query(sql("SELECT folder, files, bytes, round(generated, 6) AS generated FROM children", f"{_FILES}, {_CHILDREN}"))
def s10_direct_children(spark, sf_dir):
    """The single-file rule looks at a folder's own files only."""
    return aggregates.direct_children(corpus(spark, sf_dir)).withColumn("generated", F.round("generated", 6))


@query(sql("SELECT DISTINCT c.path FROM corpus c JOIN children f ON starts_with(c.path, f.folder || '/') WHERE f.files > 2 AND (generated >= 0.8 OR len(list_filter(string_split(folder, '/'), lambda x: x IN ('cache', 'vendor'))) > 0)", f"{_FILES}, {_CHILDREN}"))
def s10_below_generated(spark, sf_dir):
    files = corpus(spark, sf_dir)
    return discovery.generated_around(files, aggregates.direct_children(files), max_files=2)


@query(sql("SELECT path AS rel_path, CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 5 = 1 THEN 'changed' ELSE 'unembedded' END AS why FROM corpus WHERE doc_id % 5 < 3", _FILES))
def j03_changed_files(spark, sf_dir):
    found = corpus(spark, sf_dir).select("doc_id", F.col("path").alias("rel_path"), F.sha2("content", 256).alias("content_hash"))
    indexed = found.filter("doc_id % 5 <> 0").withColumn("content_hash", F.when(F.col("doc_id") % 5 == 1, "old").otherwise(F.col("content_hash")))
    return ingestion.changed(found.drop("doc_id"), indexed, found.filter("doc_id % 5 = 2")).select("rel_path", "why")


@query(sql("SELECT path AS rel_path FROM corpus WHERE doc_id % 7 = 0", _FILES))
def j02_stale_files(spark, sf_dir):
    indexed = corpus(spark, sf_dir).select("doc_id", F.col("path").alias("rel_path"))
    return ingestion.stale(indexed.filter("doc_id % 7 <> 0"), indexed)


@query(sql("""
SELECT source_id, target_id, relationship, max(weight) AS weight FROM (
  SELECT s.id AS source_id, coalesce(t.id, r.id) AS target_id, 'imports' AS relationship, 1.0::DOUBLE AS weight
  FROM (SELECT p_partkey, p_partkey // 2 AS to FROM part WHERE p_partkey > 1) e
  JOIN names s ON s.q = 'm' || e.p_partkey LEFT JOIN names t ON t.q = 'm' || e.to LEFT JOIN names r ON r.q = 'src.m' || e.to) WHERE target_id IS NOT NULL GROUP BY ALL""",
    """plan AS (SELECT 'm' || p_partkey AS q, 'n' || p_partkey AS id, p_partkey AS position FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT 'm' || p_partkey, 'x' || p_partkey, -1 FROM part WHERE p_partkey % 3 = 1),
stored AS (SELECT CASE WHEN p_partkey % 6 = 0 THEN 'src.m' ELSE 'm' END || p_partkey AS q, 'g' || p_partkey AS id FROM part WHERE p_partkey % 2 = 0),
own AS (SELECT q, max_by(id, position) AS id FROM plan GROUP BY q), old AS (SELECT q, min(id) AS id FROM stored GROUP BY q),
names AS (SELECT q, coalesce(own.id, old.id) AS id FROM own FULL JOIN old USING (q))"""))
def j01_resolve_edges(spark, sf_dir):
    part = tables.read(spark, sf_dir, "part").select("p_partkey")
    name = lambda prefix, c="p_partkey": F.concat(F.lit(prefix), F.col(c).cast("string"))
    plan = part.filter("p_partkey % 3 <> 0").select(name("m").alias("qualified_name"), name("n").alias("id"), F.col("p_partkey").alias("position"))
    plan = plan.unionByName(part.filter("p_partkey % 3 = 1").select(name("m").alias("qualified_name"), name("x").alias("id"), F.lit(-1).cast("long").alias("position")))
    stored = part.filter("p_partkey % 2 = 0").select(F.when(F.col("p_partkey") % 6 == 0, name("src.m")).otherwise(name("m")).alias("qualified_name"), name("g").alias("id"))
    edges = part.filter("p_partkey > 1").withColumn("to", F.floor(F.col("p_partkey") / 2)).select(name("m").alias("source_qualified_name"), name("m", "to").alias("target_qualified_name"), F.lit("imports").alias("relationship"), F.lit(1.0).alias("weight"), F.lit("python").alias("language"))
    return ingestion.resolved(edges, plan, stored)


@query(sql("SELECT e.source_id, e.target_id, e.relationship FROM edges e WHERE target_id IN (SELECT id FROM files WHERE repo_id = 1 AND end_line > 0 AND right(id, 1) <> '1') AND source_id NOT IN (SELECT id FROM files WHERE repo_id = 1)"))
def j04_retained_edges(spark, sf_dir):
    replaced = tables.files(spark, sf_dir).filter("repo_id = 1").select("id")
    return ingestion.retained(tables.edges(spark, sf_dir), replaced, replaced.filter("right(id, 1) <> '1'")).select("source_id", "target_id", "relationship")


@query(sql("SELECT type, coalesce(file_path LIKE 'Brand2/%', false) AS replaced, count(*) AS n FROM (SELECT type, file_path FROM nodes WHERE file_path IS NULL OR NOT starts_with(file_path, 'Brand2/') UNION ALL SELECT 'module', file_path FROM files WHERE starts_with(file_path, 'Brand2/')) GROUP BY ALL"))
def i04_replace_files(spark, sf_dir):
    changed = tables.files(spark, sf_dir).filter(F.startswith("file_path", F.lit("Brand2/")))
    out = ingestion.replaced_files(tables.nodes(spark, sf_dir), changed.withColumn("type", F.lit("module")), changed)
    return out.groupBy("type", F.coalesce(F.startswith("file_path", F.lit("Brand2/")), F.lit(False)).alias("replaced")).agg(F.count(F.lit(1)).alias("n"))


_GREEDY = """ordered AS (SELECT p_size AS repo, 'f' || lpad(p_partkey::VARCHAR, 9, '0') AS rel_path, (p_partkey % 97)::BIGINT AS entities, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS k FROM part),
walk AS (SELECT repo, rel_path, entities, k, 0 AS batch, 1 AS items, entities AS total FROM ordered WHERE k = 1
  UNION ALL SELECT o.repo, o.rel_path, o.entities, o.k, w.batch + full_, CASE WHEN full_ = 1 THEN 1 ELSE items + 1 END, CASE WHEN full_ = 1 THEN o.entities ELSE total + o.entities END
  FROM (SELECT w.*, CASE WHEN items >= 32 OR total + n.entities > 512 THEN 1 ELSE 0 END AS full_ FROM walk w JOIN ordered n ON n.repo = w.repo AND n.k = w.k + 1) w JOIN ordered o ON o.repo = w.repo AND o.k = w.k + 1)"""


@query(sql("SELECT repo, rel_path, entities, batch FROM walk", _GREEDY))
def w07_file_batches(spark, sf_dir):
    part = tables.read(spark, sf_dir, "part")
    path = F.concat(F.lit("f"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    return ingestion.file_batches(part.select(F.col("p_size").alias("repo"), path.alias("rel_path"), (F.col("p_partkey") % 97).alias("entities")))


_REQUESTS = """inputs AS (SELECT coalesce(source, '') AS queue, doc_id AS position, length(coalesce(text, ''))::BIGINT AS characters FROM documents),
ordered AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY position) AS k FROM inputs WHERE characters <= 120000),
walk AS (SELECT queue, position, characters, k, 0 AS batch, 1 AS items, characters AS total FROM ordered WHERE k = 1
  UNION ALL SELECT queue, position, characters, k, batch + full_, CASE WHEN full_ = 1 THEN 1 ELSE items + 1 END, CASE WHEN full_ = 1 THEN characters ELSE total + characters END
  FROM (SELECT n.*, w.batch, w.items, w.total, CASE WHEN w.items >= 128 OR w.total + n.characters > 120000 THEN 1 ELSE 0 END AS full_ FROM walk w JOIN ordered n ON n.queue = w.queue AND n.k = w.k + 1))"""


@query(sql("SELECT queue, position, characters, batch, NULL::VARCHAR AS error FROM walk UNION ALL SELECT queue, position, characters, NULL, 'an input is too long for a request' FROM inputs WHERE characters > 120000", _REQUESTS))
def w08_request_batches(spark, sf_dir):
    d = tables.read(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("queue"), F.col("doc_id").alias("position"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("characters"))
    return ingestion.request_batches(d)


@query(sql("SELECT repo_id, id, ((row_number() OVER (PARTITION BY repo_id ORDER BY id) - 1) // 128)::INT AS chunk FROM files"))
def w09_fixed_chunks(spark, sf_dir):
    return ingestion.chunks(tables.files(spark, sf_dir), F.col("id"), 128, ("repo_id",)).select("repo_id", "id", "chunk")


@query(sql("SELECT (SELECT count(*) FROM corpus) AS discovered, (SELECT count(*) FROM corpus WHERE doc_id % 5 < 2) AS changed, (SELECT count(*) FROM corpus WHERE doc_id % 7 = 0) AS deleted, (SELECT count(*) FROM corpus WHERE doc_id % 5 = 0) AS failed, (SELECT count(*) FROM files) AS entities, (SELECT count(DISTINCT (l_orderkey, l_partkey)) FROM lineitem) AS edges, (SELECT count(*) FROM vectors) AS embeddings, (SELECT count(*) - count(DISTINCT (l_orderkey, l_partkey)) FROM lineitem) AS dropped", _FILES))
def a15_ingestion_counters(spark, sf_dir):
    files, line = corpus(spark, sf_dir), tables.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return ingestion.result_counts(files, files.filter("doc_id % 5 < 2"), files.filter("doc_id % 7 = 0"), files.filter("doc_id % 5 = 0"), tables.files(spark, sf_dir), line, line.distinct(), tables.embeddings(spark, sf_dir))


@query("SELECT sha, author, count(p)::INT AS paths FROM (SELECT 's' || o_orderkey AS sha, 'C' || o_custkey AS author, unnest(['a', 'b']) AS p FROM orders WHERE o_orderkey % 10 <> 0) GROUP BY ALL")
def s13_git_log(spark, sf_dir):
    o = tables.read(spark, sf_dir, "orders")
    fields = lambda *c: F.concat_ws("\x1f", *c)
    sha, who = F.concat(F.lit("s"), F.col("o_orderkey").cast("string")), F.concat(F.lit("C"), F.col("o_custkey").cast("string"))
    head = F.when(F.col("o_orderkey") % 10 == 0, fields(sha, who)).otherwise(fields(sha, who, F.lit("a@b"), F.lit("2020-01-01"), F.lit("subject")))
    log = o.select(F.col("o_orderkey").alias("position"), F.concat(head, F.lit("\n\na\nb\n")).alias("line"))
    return ingestion.history(log).select("sha", "author", F.size("paths").alias("paths"))


def _commits(spark, sf_dir):
    o, line = tables.read(spark, sf_dir, "orders"), tables.read(spark, sf_dir, "lineitem")
    paths = line.groupBy("l_orderkey").agg(F.collect_set(F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("paths"))
    email = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "U").otherwise("u"), (F.col("o_custkey") % 50).cast("string"))
    return o.join(paths, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("position"), F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("sha"), F.concat(F.lit("A"), F.col("o_custkey").cast("string")).alias("author"), email.alias("email"), F.coalesce("paths", F.array().cast("array<string>")).alias("paths"))


@query("SELECT substr(sha256('contributor:u' || (o_custkey % 50)), 1, 32) AS id, min_by('A' || o_custkey, o_orderkey) AS name FROM orders GROUP BY o_custkey % 50")
def i07_contributors(spark, sf_dir):
    nodes, _ = ingestion.provenance(_commits(spark, sf_dir), tables.files(spark, sf_dir))
    return nodes.filter("type = 'contributor'").select("id", "name")


@query("SELECT 'P:' || l_partkey AS target_id, count(DISTINCT l_orderkey) AS commits FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_partkey")
def j05_commit_files(spark, sf_dir):
    files = tables.read(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("file_path"), F.concat(F.lit("P:"), F.col("p_partkey").cast("string")).alias("id"))
    _, edges = ingestion.provenance(_commits(spark, sf_dir), files)
    return edges.filter("relationship = 'modifies'").groupBy("target_id").agg(F.count(F.lit(1)).alias("commits"))


# What each template holds, by its language's place among them: written down from the rules, not from the parsers' output.
_LANGUAGES = "(VALUES (0, 'python'), (1, 'typescript'), (2, 'rust'), (3, 'go'), (4, 'swift'), (5, 'elixir'), (6, 'bash'), (7, 'css')) l(k, language)"
_KINDS = """(VALUES (0, 'file', 1, 0), (0, 'import', 3, 0), (0, 'constant', 1, 0), (0, 'class', 1, 0), (0, 'method', 1, 3), (0, 'function', 1, 1),
  (1, 'file', 1, 0), (1, 'import', 1, 0), (1, 'class', 2, 0), (1, 'method', 1, 2), (1, 'function', 1, 1), (1, 'variable', 1, 0),
  (2, 'file', 1, 0), (2, 'import', 3, 0), (2, 'class', 2, 0), (2, 'method', 1, 2), (2, 'function', 1, 1), (2, 'constant', 1, 0),
  (3, 'file', 1, 0), (3, 'module', 1, 0), (3, 'import', 1, 0), (3, 'class', 1, 0), (3, 'variable', 1, 0), (3, 'method', 1, 2), (3, 'function', 1, 1),
  (4, 'file', 1, 0), (4, 'import', 1, 0), (4, 'class', 1, 0), (4, 'variable', 1, 0), (4, 'method', 1, 1), (4, 'function', 1, 1),
  (5, 'file', 1, 0), (5, 'class', 1, 0), (5, 'import', 1, 0), (5, 'constant', 1, 0), (5, 'method', 2, 2),
  (6, 'file', 1, 0), (6, 'import', 1, 0), (6, 'constant', 1, 0), (6, 'function', 1, 2),
  (7, 'file', 1, 0), (7, 'import', 1, 0), (7, 'variable', 1, 0), (7, 'class', 3, 0), (7, 'function', 1, 0)) t(k, kind, n, complexity)"""
_RELATIONSHIPS = """(VALUES (0, 'contains', 7), (0, 'imports', 3), (0, 'inherits', 1), (0, 'calls', 2), (1, 'contains', 6), (1, 'imports', 1), (1, 'inherits', 1), (1, 'calls', 1),
  (2, 'contains', 8), (2, 'imports', 3), (2, 'inherits', 1), (2, 'implements', 1), (3, 'contains', 6), (3, 'imports', 1), (4, 'contains', 4), (4, 'imports', 1), (4, 'inherits', 1),
  (5, 'contains', 4), (5, 'imports', 1), (6, 'contains', 2), (6, 'imports', 1), (7, 'contains', 5), (7, 'imports', 1)) t(k, relationship, n)"""
_PARTS = "(SELECT p_partkey % 8 AS k, count(*) AS parts FROM part GROUP BY 1) p"


@query(f"SELECT language, kind, n * parts AS n, complexity * parts AS complexity FROM {_LANGUAGES} JOIN {_KINDS} USING (k) JOIN {_PARTS} USING (k)")
def p01_parse(spark, sf_dir):
    """Entities of generated sources in each language, one file for each part."""
    found = parsing.parse_files(parsing.samples(tables.read(spark, sf_dir, "part")))
    return found.groupBy("language", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("complexity", F.lit(0)).cast("long")).alias("complexity"))


@query(f"SELECT language, relationship, n * parts AS n FROM {_LANGUAGES} JOIN {_RELATIONSHIPS} USING (k) JOIN {_PARTS} USING (k)")
def p13_edges(spark, sf_dir):
    return parsing.parse_edges(parsing.samples(tables.read(spark, sf_dir, "part"))).groupBy("language", "relationship").agg(F.count(F.lit(1)).alias("n"))


_MODULE = "SELECT 'src.f' || p_partkey AS m, regexp_replace(lower(p_name), '[^a-z]+', '_', 'g') AS w, p_partkey AS n FROM part WHERE p_partkey % 8 = 0"


@query(f"""WITH files AS ({_MODULE}), rows AS (
SELECT m AS source, m || '.import.' || x AS target, 'contains' AS relationship FROM files, (SELECT unnest(['os', 'a.b.c', 'd.e']) AS x)
UNION ALL SELECT m, x, 'imports' FROM files, (SELECT unnest(['os', 'a.b.c', 'd.e']) AS x)
UNION ALL SELECT m, m || '.' || x, 'contains' FROM (SELECT m, unnest(['LIMIT', 'K' || n, w]) AS x FROM files)
UNION ALL SELECT m || '.K' || n, m || '.K' || n || '.go', 'contains' FROM files UNION ALL SELECT m || '.K' || n, 'Base', 'inherits' FROM files
UNION ALL SELECT m || '.K' || n || '.go', 'helper', 'calls' FROM files UNION ALL SELECT m || '.' || w, 'K' || n, 'calls' FROM files)
SELECT * FROM rows""")
def p03_python_edges(spark, sf_dir):
    """Every edge of the Python files: dots before a module, renamed names and calls as they are read."""
    files = parsing.samples(tables.read(spark, sf_dir, "part")).filter(F.endswith("path", F.lit(".py")))
    return parsing.parse_edges(files).select(F.col("source_qualified_name").alias("source"), F.col("target_qualified_name").alias("target"), "relationship")


@query("SELECT doc_id || '.txt' AS name, doc_id || '.txt' AS qualified_name, 'file' AS kind, 0 AS start_line, len(regexp_extract_all(coalesce(text, ''), '\n'))::INT AS end_line, coalesce(text, '') AS docstring, coalesce(text, '') AS raw_text FROM documents")
def p16_text_fallback(spark, sf_dir):
    """The entity that a text file is: its source is whole, the cut belongs to the node it becomes (P17)."""
    files = tables.read(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("rel_path"), F.coalesce("text", F.lit("")).alias("content"))
    return ingestion.text_entities(files)


@query(sql("""
SELECT type, name, file_path, substr(name, 1, 2048) AS content, substr(sha256(CASE WHEN k = 0 THEN '' ELSE 'occurrence:' || k || ':' END || 'repo:' || file_path || ':' || type || ':' || qualified_name), 1, 32) AS id
FROM (SELECT *, row_number() OVER (PARTITION BY file_path, type, qualified_name ORDER BY id) - 1 AS k FROM nodes WHERE file_path IS NOT NULL)"""))
def p17_planned_nodes(spark, sf_dir):
    f = tables.nodes(spark, sf_dir).filter("file_path is not null")
    empty = F.lit(None).cast("string")
    rows = f.select(F.col("file_path").alias("file"), F.col("type").alias("kind"), "name", "qualified_name", "start_line", "end_line", F.lit("python").alias("language"), empty.alias("signature"), empty.alias("docstring"), F.col("name").alias("raw_text"), F.array().cast("array<string>").alias("bases"), F.array().cast("array<string>").alias("imports"), F.lit(1).alias("complexity"), F.col("id").alias("pos"))
    return ingestion.planned_nodes(rows, "repo").select("id", "type", "name", "file_path", "content")


@query(sql("SELECT path AS rel_path, 'python' AS language, size AS byte_size FROM corpus WHERE path = (SELECT min(path) FROM corpus WHERE ends_with(path, '.py') AND starts_with(path, 'src/') AND size < 8192)", _FILES))
def s02_single_file(spark, sf_dir):
    files = corpus(spark, sf_dir)
    path = files.filter("path like 'src/%.py' and size < 8192").agg(F.min("path")).first()[0]
    return discovery.discovered(files.filter(F.col("path") == path)).select("rel_path", "language", "byte_size")


@query(sql("SELECT 'alias/' || doc_id AS path, path AS target FROM corpus WHERE doc_id % 4 = 1", _FILES))
def s11_contained_aliases(spark, sf_dir):
    files = corpus(spark, sf_dir)
    inside = F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("x/./../"), F.col("path"))).otherwise(F.concat(F.lit("../"), F.col("path")))
    return snapshots.contained_aliases(files, files.select(F.concat(F.lit("alias/"), F.col("doc_id").cast("string")).alias("path"), inside.alias("target")))


@query("""
WITH records AS (SELECT user_id AS repo, event_id AS pos, CASE WHEN event_id % 7 = 0 THEN 'R  a' || event_id || chr(0) || 'b' || event_id ELSE ' M a' || event_id END AS record FROM events),
paths AS (SELECT repo, pos, 0 AS nth, 'a' || pos AS path FROM records UNION ALL SELECT repo, pos, 1, 'b' || pos FROM records WHERE pos % 7 = 0),
states AS (SELECT repo, string_agg(record || chr(0), '' ORDER BY pos) AS status FROM records GROUP BY repo),
tails AS (SELECT repo, string_agg(chr(0) || CASE WHEN pos % 3 = 0 THEN 'missing' ELSE '(' || path || ', ' || pos || ')' END, '' ORDER BY pos, nth) AS tail FROM paths GROUP BY repo)
SELECT c_custkey AS repo, sha256(c_name || chr(0) || coalesce(status, '') || coalesce(tail, '')) AS fingerprint FROM customer LEFT JOIN states s ON s.repo = c_custkey LEFT JOIN tails t ON t.repo = c_custkey""")
def s14_state_fingerprint(spark, sf_dir):
    """A user's events as dirty paths: every seventh a rename of two fields, every third path gone."""
    i, number = F.col("event_id"), F.col("event_id").cast("string")
    e = tables.read(spark, sf_dir, "events").select(F.col("user_id").alias("repo"), "event_id")
    a, b = F.concat(F.lit("a"), number), F.concat(F.lit("b"), number)
    record = F.when(i % 7 == 0, F.concat(F.lit("R  "), a, F.lit("\0"), b)).otherwise(F.concat(F.lit(" M "), a))
    listing = e.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("event_id", F.concat(record, F.lit("\0")).alias("r")))).alias("all"))
    states = tables.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("repo"), F.col("c_name").alias("head")).join(listing, "repo", "left")
    states = states.select("repo", "head", F.array_join(F.transform("all", lambda x: x["r"]), "").alias("status"))
    seen = e.filter(i % 3 != 0).select("repo", "event_id", F.explode(F.when(i % 7 == 0, F.array(a, b)).otherwise(F.array(a))).alias("path"))
    return snapshots.fingerprints(states, seen.select("repo", "path", F.concat(F.lit("("), "path", F.lit(", "), F.col("event_id").cast("string"), F.lit(")")).alias("metadata")))


@query("SELECT r_regionkey AS id, r_name AS root, count(c_custkey) AS files, max('2024-01-' || lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0')) AS last_indexed FROM region LEFT JOIN customer ON c_custkey % 4 = r_regionkey GROUP BY ALL")
def s16_saved_projects(spark, sf_dir):
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("c_custkey") % 28 + 1).cast("string"), 2, "0"))
    records = tables.read(spark, sf_dir, "customer").select((F.col("c_custkey") % 4).alias("project_id"), F.to_json(F.struct(day.alias("indexed_at"))).alias("value"))
    return snapshots.saved_projects(tables.read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("root")), records)


@query(sql("SELECT id, type, name, qualified_name, file_path, start_line, end_line, NULL::VARCHAR AS signature, substr(name || ' ' || coalesce(qualified_name, ''), 1, 1024) AS content, NULL::DOUBLE AS distance FROM nodes"))
def p19_compact_projection(spark, sf_dir):
    whole = F.concat_ws(" ", "name", F.coalesce("qualified_name", F.lit("")))
    return search.compact(tables.nodes(spark, sf_dir).withColumn("content", whole))


@query(sql("SELECT path AS rel_path, ((row_number() OVER (ORDER BY path) - 1) // 32)::INT AS chunk FROM corpus WHERE doc_id % 7 = 0", _FILES))
def i06_delete_batches(spark, sf_dir):
    indexed = corpus(spark, sf_dir).select("doc_id", F.col("path").alias("rel_path"))
    gone = ingestion.stale(indexed.filter("doc_id % 7 <> 0"), indexed)
    return ingestion.chunks(gone.withColumn("repo", F.lit("repo")), F.col("rel_path"), ingestion.DELETE_BATCH, ("repo",)).select("rel_path", "chunk")


@query(f"SELECT language, count(*) FILTER (WHERE NOT bad) AS good, count(*) FILTER (WHERE bad) AS failed FROM (SELECT language, language = 'python' AND broken AS bad FROM (SELECT p_partkey % 8 AS k, p_partkey % 7 = 0 AS broken FROM part) JOIN {_LANGUAGES} USING (k)) GROUP BY language")
def i05_parse_failures(spark, sf_dir):
    """Every seventh generated file has a NUL in it; failures are rows.

    Python's parser fails on those; the declaration scanners of the other languages read past what is broken.
    """
    part = tables.read(spark, sf_dir, "part")
    files = parsing.samples(part)
    number = F.regexp_extract("path", "f([0-9]+)[.]", 1).cast("long")
    broken = files.withColumn("content", F.when(number % 7 == 0, F.concat(F.col("content"), F.lit("\0"))).otherwise(F.col("content")))
    names = F.create_map(*[F.lit(x) for pair in parsing.LANGUAGES.items() for x in pair])
    language = F.coalesce("language", names[F.substring_index("file", ".", -1)])  # a failure has none
    file = parsing.parse_files(broken).filter("error is not null or kind = 'file'").select(language.alias("language"), F.col("error").isNull().alias("ok"))
    return file.groupBy("language").agg(F.sum(F.col("ok").cast("long")).alias("good"), F.sum((~F.col("ok")).cast("long")).alias("failed"))
