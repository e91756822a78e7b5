"""Graph views over relational tables: each gives typed nodes, weighted edges, vectors or logs as DataFrames.

Every view reads only the columns it needs, so that projections and filters reach the Parquet scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = ["id", "type", "name", "file_path", "qualified_name", "start_line", "end_line", "repo_id"]
EDGE = ["source_id", "target_id", "relationship", "weight"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _key(prefix: str, *columns: str):
    return F.concat_ws(":", F.lit(prefix), *[F.col(c).cast("string") for c in columns])


def _path(brand: str = "p_brand", kind: str = "p_type", key: str = "p_partkey"):
    return F.concat_ws("/", F.replace(F.col(brand), F.lit("#"), F.lit("")), F.replace(F.col(kind), F.lit(" "), F.lit("_")), F.concat(F.col(key).cast("string"), F.lit(".py")))


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.concat(F.lit("/repos/"), F.lower("r_name")).alias("path"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path()
    name = F.replace(F.regexp_replace(path, r"\.py$", ""), F.lit("/"), F.lit("."))
    return read(spark, sf_dir, "part").select(
        _key("P", "p_partkey").alias("id"), F.lit("file").alias("type"), F.col("p_name").alias("name"), path.alias("file_path"), name.alias("qualified_name"), F.lit(0).cast("long").alias("start_line"), F.lit(400).cast("long").alias("end_line"), (F.col("p_partkey") % 5).alias("repo_id")
    )


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files grow with the data, and their paths are far larger than the Parquet file that Spark judges them by: the join
    merges, as a broadcast would fill the driver."""
    part = read(spark, sf_dir, "part").select("p_partkey", _path().alias("file_path"))
    name = F.concat_ws("_", F.lower("l_returnflag"), F.lower("l_linestatus"), F.col("l_suppkey").cast("string"))
    start = F.col("l_orderkey") % 300
    line = read(spark, sf_dir, "lineitem").select(_key("L", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), "l_partkey", name.alias("name"), start.alias("start_line"), (start + F.col("l_quantity").cast("long")).alias("end_line"))
    return line.join(part.hint("merge"), F.col("l_partkey") == F.col("p_partkey")).select(
        "id", F.lit("function").alias("type"), "name", "file_path", F.concat_ws(".", F.replace(F.regexp_replace("file_path", r"\.py$", ""), F.lit("/"), F.lit(".")), "name").alias("qualified_name"), "start_line", "end_line", (F.col("l_partkey") % 5).alias("repo_id")
    )


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(
        _key("S", "s_suppkey").alias("id"), F.lit("class").alias("type"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("file_path"), F.concat(F.lit("suppliers."), "s_name").alias("qualified_name"), F.lit(0).cast("long").alias("start_line"), F.lit(0).cast("long").alias("end_line"), (F.col("s_suppkey") % 5).alias("repo_id")
    )


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(
        _key("N", "n_nationkey").alias("id"), F.lit("module").alias("type"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("file_path"), F.concat(F.lit("nations."), "n_name").alias("qualified_name"), F.lit(0).cast("long").alias("start_line"), F.lit(0).cast("long").alias("end_line"), F.col("n_regionkey").cast("long").alias("repo_id")
    )


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        _key("O", "o_orderkey").alias("id"), F.lit("commit").alias("type"), F.col("o_orderpriority").alias("name"), F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("string").alias("qualified_name"), F.lit(0).cast("long").alias("start_line"), F.lit(0).cast("long").alias("end_line"), (F.col("o_custkey") % 5).alias("repo_id")
    )


def contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(
        _key("C", "c_custkey").alias("id"), F.lit("contributor").alias("type"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("string").alias("qualified_name"), F.lit(0).cast("long").alias("start_line"), F.lit(0).cast("long").alias("end_line"), (F.col("c_custkey") % 5).alias("repo_id")
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [f(spark, sf_dir) for f in (files, functions, classes, modules, commits, contributors)])


def _edge(df: DataFrame, source, target, relationship: str, weight) -> DataFrame:
    return df.select(source.alias("source_id"), target.alias("target_id"), F.lit(relationship).alias("relationship"), weight.cast("double").alias("weight"))


def edges(spark: SparkSession, sf_dir: str, relationships: tuple[str, ...] | None = None) -> DataFrame:
    """Edges of the relationships asked for; other tables aren't read."""
    one = F.lit(1)
    line = read(spark, sf_dir, "lineitem")
    made = {
        "authored_by": lambda: _edge(read(spark, sf_dir, "orders"), _key("O", "o_orderkey"), _key("C", "o_custkey"), "authored_by", one),
        "modifies": lambda: _edge(line.groupBy("l_orderkey", "l_partkey").agg(F.count(one).alias("n")), _key("O", "l_orderkey"), _key("P", "l_partkey"), "modifies", F.col("n")),
        "calls": lambda: _edge(line.groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q")), _key("S", "l_suppkey"), _key("P", "l_partkey"), "calls", F.col("q")),
        "contains": lambda: _edge(read(spark, sf_dir, "supplier"), _key("N", "s_nationkey"), _key("S", "s_suppkey"), "contains", one).unionByName(_edge(line, _key("P", "l_partkey"), _key("L", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "contains", one)),
        "imports": lambda: _edge(read(spark, sf_dir, "part").filter("p_partkey > 1"), _key("P", "p_partkey"), F.concat(F.lit("P:"), F.floor(F.col("p_partkey") / 2).cast("string")), "imports", one),
        "inherits": lambda: _edge(read(spark, sf_dir, "supplier").filter("s_suppkey > 2"), _key("S", "s_suppkey"), F.concat(F.lit("S:"), F.floor(F.col("s_suppkey") / 3).cast("string")), "inherits", one),
    }
    return reduce(DataFrame.unionByName, [made[r]() for r in relationships or made])


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.concat(F.lit("V:"), F.col("vec_id").cast("string")).alias("node_id"), "vec_id", F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("int").alias("label"))


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operation log: an event is an operation of its user's backend."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("b"), (F.col("user_id") % 4).cast("string")).alias("backend"), F.col("event_type").alias("operation"), "ts", F.col("user_id").alias("repo"), F.col("value").alias("duration_ms"), F.when(F.col("event_type") == "error", "failed").alias("error"))


#: The same views in DuckDB's SQL, to put before a query.
SQL = """
files AS (SELECT 'P:' || p_partkey AS id, 'file' AS type, p_name AS name, replace(p_brand, '#', '') || '/' || replace(p_type, ' ', '_') || '/' || p_partkey || '.py' AS file_path,
  replace(replace(p_brand, '#', '') || '/' || replace(p_type, ' ', '_') || '/' || p_partkey, '/', '.') AS qualified_name, 0::BIGINT AS start_line, 400::BIGINT AS end_line, (p_partkey % 5)::BIGINT AS repo_id FROM part),
functions AS (SELECT 'L:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS id, 'function' AS type, lower(l_returnflag) || '_' || lower(l_linestatus) || '_' || l_suppkey AS name, f.file_path,
  f.qualified_name || '.' || lower(l_returnflag) || '_' || lower(l_linestatus) || '_' || l_suppkey AS qualified_name, (l_orderkey % 300)::BIGINT AS start_line, (l_orderkey % 300 + l_quantity::BIGINT)::BIGINT AS end_line, (l_partkey % 5)::BIGINT AS repo_id
  FROM lineitem JOIN files f ON f.id = 'P:' || l_partkey),
classes AS (SELECT 'S:' || s_suppkey AS id, 'class' AS type, s_name AS name, NULL::VARCHAR AS file_path, 'suppliers.' || s_name AS qualified_name, 0::BIGINT AS start_line, 0::BIGINT AS end_line, (s_suppkey % 5)::BIGINT AS repo_id FROM supplier),
modules AS (SELECT 'N:' || n_nationkey AS id, 'module' AS type, n_name AS name, NULL::VARCHAR AS file_path, 'nations.' || n_name AS qualified_name, 0::BIGINT AS start_line, 0::BIGINT AS end_line, n_regionkey::BIGINT AS repo_id FROM nation),
commits AS (SELECT 'O:' || o_orderkey AS id, 'commit' AS type, o_orderpriority AS name, NULL::VARCHAR AS file_path, NULL::VARCHAR AS qualified_name, 0::BIGINT AS start_line, 0::BIGINT AS end_line, (o_custkey % 5)::BIGINT AS repo_id FROM orders),
contributors AS (SELECT 'C:' || c_custkey AS id, 'contributor' AS type, c_name AS name, NULL::VARCHAR AS file_path, NULL::VARCHAR AS qualified_name, 0::BIGINT AS start_line, 0::BIGINT AS end_line, (c_custkey % 5)::BIGINT AS repo_id FROM customer),
nodes AS (SELECT * FROM files UNION ALL SELECT * FROM functions UNION ALL SELECT * FROM classes UNION ALL SELECT * FROM modules UNION ALL SELECT * FROM commits UNION ALL SELECT * FROM contributors),
edges AS (
  SELECT 'O:' || o_orderkey AS source_id, 'C:' || o_custkey AS target_id, 'authored_by' AS relationship, 1.0::DOUBLE AS weight FROM orders
  UNION ALL SELECT 'O:' || l_orderkey, 'P:' || l_partkey, 'modifies', count(*)::DOUBLE FROM lineitem GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT 'S:' || l_suppkey, 'P:' || l_partkey, 'calls', sum(l_quantity)::DOUBLE FROM lineitem GROUP BY l_suppkey, l_partkey
  UNION ALL SELECT 'N:' || s_nationkey, 'S:' || s_suppkey, 'contains', 1.0 FROM supplier
  UNION ALL SELECT 'P:' || l_partkey, 'L:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey, 'contains', 1.0 FROM lineitem
  UNION ALL SELECT 'P:' || p_partkey, 'P:' || (p_partkey // 2), 'imports', 1.0 FROM part WHERE p_partkey > 1
  UNION ALL SELECT 'S:' || s_suppkey, 'S:' || (s_suppkey // 3), 'inherits', 1.0 FROM supplier WHERE s_suppkey > 2),
vectors AS (SELECT 'V:' || vec_id AS node_id, vec_id, embedding::DOUBLE[] AS vector, label::INT AS label FROM embeddings),
ops AS (SELECT event_id AS id, 'b' || (user_id % 4) AS backend, event_type AS operation, ts, user_id AS repo, value AS duration_ms, CASE WHEN event_type = 'error' THEN 'failed' END AS error FROM events)
"""


def sql(query: str, more: str = "") -> str:
    """DuckDB SQL of a query over the views; more: further named queries."""
    return f"WITH RECURSIVE {SQL.strip()}{',' + more if more else ''}\n{query}"
