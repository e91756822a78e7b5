"""Point look-ups, lists and membership over nodes, files and vectors. Lists are ordered by id unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Node types, in their order, and those that are symbols; relationships.
NODE_TYPES = ("file", "module", "class", "function", "method", "variable", "constant", "import", "type_alias", "commit", "contributor")
SYMBOL_TYPES = ("class", "function", "method", "variable", "constant", "type_alias")
RELATIONSHIPS = ("contains", "calls", "imports", "inherits", "implements", "references", "authored_by", "modifies")
SYMBOL_LIMIT = 200


def scoped(nodes: DataFrame, kind: str | None = None, repo: int | None = None) -> DataFrame:
    """Nodes of a type and a repository, where given."""
    if kind is not None:
        if kind not in NODE_TYPES:
            raise ValueError(f"unknown node type {kind!r}")
        nodes = nodes.filter(F.col("type") == kind)
    return nodes if repo is None else nodes.filter(F.col("repo_id") == repo)


def by_ids(nodes: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Nodes whose id is among ids (column id), each once."""
    return nodes.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_semi")


def page(nodes: DataFrame, limit: int, offset: int = 0, kind: str | None = None, repo: int | None = None) -> DataFrame:
    """A page of nodes in id order."""
    if limit <= 0 or offset < 0:
        raise ValueError("a page needs limit > 0 and offset >= 0")
    return scoped(nodes, kind, repo).orderBy("id").offset(offset).limit(limit)


def symbols(nodes: DataFrame, kind: str, limit: int = 50, offset: int = 0, repo: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A page of one symbol type's nodes and the count of all of them."""
    if kind not in SYMBOL_TYPES or not 0 < limit <= SYMBOL_LIMIT:
        raise ValueError("symbols need a symbol type and a limit up to 200")
    return page(nodes, limit, offset, kind, repo), scoped(nodes, kind, repo).agg(F.count(F.lit(1)).alias("total"))


def without_embedding(nodes: DataFrame, embeddings: DataFrame) -> DataFrame:
    return nodes.join(embeddings.select(F.col("node_id").alias("id")), "id", "left_anti")


def first_by_qualified_name(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(repo_id, qualified_name, id): the least id of each asked name (repo_id, qualified_name) in its repository."""
    keys = ["repo_id", "qualified_name"]
    return nodes.join(names.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(F.min("id").alias("id"))


def scopes(repos: DataFrame, paths: DataFrame) -> DataFrame:
    """Repositories (id, path) with those of paths (path) that are new, numbered on in path order after the largest id."""
    new = paths.select("path").distinct().join(repos, "path", "left_anti")
    last = repos.agg(F.coalesce(F.max("id"), F.lit(-1).cast("long")).alias("last"))
    nth = F.row_number().over(Window.orderBy("path"))  # repositories, not files
    return repos.unionByName(new.withColumn("nth", nth).join(F.broadcast(last), F.lit(True)).select((F.col("last") + F.col("nth")).alias("id"), "path"))


def resolved_scopes(repos: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (path or id) with both: a path's id, an id's path, null where there is none."""
    by_path = asked.filter("path is not null").select("path").join(repos, "path", "left").select("id", "path")
    by_id = asked.filter("path is null").select("id").join(repos, "id", "left").select("id", "path")
    return by_path.unionByName(by_id)


def file_paths(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("file_path").isNotNull()).select("repo_id", "file_path").distinct()


def without_metadata(nodes: DataFrame, key: str, value, kind: str | None = None) -> DataFrame:
    """Nodes that stay when those with key = value (and of the type) are deleted."""
    gone = F.col(key) == value
    if kind is not None:
        gone &= F.col("type") == kind
    return nodes.filter(~F.coalesce(gone, F.lit(False)))


def span() -> Column:
    return F.coalesce("end_line", F.lit(-1)) - F.coalesce("start_line", F.lit(-1))


def at_positions(nodes: DataFrame, positions: DataFrame) -> DataFrame:
    """For each position (file_path, line) the node with the narrowest line range that holds it; of equal ones the least id.

    Rows meet by file and by a block of lines, whose size is the power of two that holds a node's span: a node is in at
    most two blocks of its size, and a position asks in one block of each size that there is. So a file of many nodes and
    many positions compares few of them with each other. Spark takes the positions for as small as before their rows were
    multiplied and would broadcast them, so the join is asked to merge.
    """
    start, end = F.coalesce("start_line", F.lit(-1)).cast("long"), F.coalesce("end_line", F.lit(-1)).cast("long")
    own = nodes.select("file_path", "id", "name", "start_line", "end_line", start.alias("from"), end.alias("to")).filter(F.col("file_path").isNotNull() & (F.col("from") <= F.col("to")))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.col("to") - F.col("from") + 1))).cast("int")
    own = own.withColumn("level", level)
    levels = own.select("level").distinct()  # 64 at most
    own = own.withColumn("block", F.explode(F.array_distinct(F.array(F.expr("shiftright(`from`, level)"), F.expr("shiftright(`to`, level)")))))
    asked = positions.select("file_path", "line").distinct().join(F.broadcast(levels), F.lit(True)).withColumn("block", F.expr("shiftright(cast(line as bigint), level)"))
    met = asked.hint("merge").join(own, ["file_path", "level", "block"]).filter(F.col("line").between(F.col("from"), F.col("to")))
    best = met.groupBy("file_path", "line").agg(F.min_by(F.struct("id", "name", "start_line", "end_line"), F.struct(span(), "id")).alias("n"))
    return best.select("file_path", "line", "n.*")


def ancestors(path: Column) -> Column:
    """All proper prefixes of a path at its slashes, the longest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def nearest_parent(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, parent): the longest root that is a proper ancestor of the path; an equi-join over its exploded ancestors."""
    up = paths.select("path", F.explode(ancestors(F.col("path"))).alias("parent")).filter("parent <> path")
    return up.join(roots.select(F.col("path").alias("parent")), "parent", "left_semi").groupBy("path").agg(F.max_by("parent", F.length("parent")).alias("parent"))


def dimension_errors(vectors: DataFrame, dimension: int) -> DataFrame:
    """Vectors that a store of the dimension rejects; any row rejects the whole write."""
    return vectors.filter((F.size("vector") != dimension) | F.exists("vector", lambda x: x.isNull() | F.isnan(x)))


def upserted(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """stored with new rows in place of those with the same keys."""
    return stored.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def absent(ids: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Ids without a stored vector: none of them means that all are durable."""
    return ids.select("id").join(embeddings.select(F.col("node_id").alias("id")), "id", "left_anti")


def last_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the order."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("nth = 1").drop("nth")
