"""Incremental ingestion: change detection, planning, name resolution, retained edges, batches, provenance."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import ids
from graphloom.functions.text import CONTENT

# Sizes of batches.
BATCH_FILES, BATCH_ENTITIES, EMBED_BATCH, DELETE_BATCH, READ_BATCH, REQUEST_CHARACTERS = 32, 512, 128, 32, 128, 120_000


def changed(found: DataFrame, indexed: DataFrame, unembedded: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Files (rel_path, content_hash) that are new, have another hash, or lack vectors; all of them if forced."""
    rows = found.join(indexed.select("rel_path", F.col("content_hash").alias("old_hash")), "rel_path", "left")
    why = F.when(F.lit(force), "forced").when(F.col("old_hash").isNull(), "new").when(~F.col("old_hash").eqNullSafe(F.col("content_hash")), "changed")
    if unembedded is not None:
        rows = rows.join(unembedded.select("rel_path", F.lit(True).alias("lacks")).distinct(), "rel_path", "left")
        why = F.coalesce(why, F.when(F.col("lacks"), "unembedded"))
    return rows.withColumn("why", why).filter("why is not null").select("rel_path", "content_hash", "why")


def stale(found: DataFrame, indexed: DataFrame) -> DataFrame:
    """Indexed files that aren't found any more."""
    return indexed.select("rel_path").join(found.select("rel_path"), "rel_path", "left_anti")


def occurrences(entities: DataFrame, keys: tuple[str, ...] = ("file", "kind", "qualified_name"), order: str = "pos") -> DataFrame:
    """Entities with their ordinal among those of one name in their file, from 0, in parse order."""
    return entities.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)


def text_entities(files: DataFrame) -> DataFrame:
    """Text files (rel_path, content) as one entity each, with the whole source; end_line counts line ends."""
    lines = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))
    path, source = F.col("rel_path"), F.col("content")
    return files.select(path.alias("name"), path.alias("qualified_name"), F.lit("file").alias("kind"), F.lit(0).alias("start_line"), lines.alias("end_line"), source.alias("docstring"), source.alias("raw_text"))


def planned_nodes(entities: DataFrame, repo: str) -> DataFrame:
    """Parsed entities as nodes: id, content, and the metadata that isn't empty."""
    rows = occurrences(entities)
    full = {"file_path": "file", "language": "language", "qualified_name": "qualified_name", "start_line": "start_line", "end_line": "end_line"}
    always = [(k, F.col(c).cast("string")) for k, c in full.items()]
    listed = lambda c: F.when(F.size(c) > 0, F.to_json(F.col(c)))
    maybe = [("signature", F.nullif(F.col("signature"), F.lit(""))), ("docstring", F.nullif(F.col("docstring"), F.lit(""))), ("bases", listed("bases")), ("imports", listed("imports")), ("cyclomatic_complexity", F.col("complexity").cast("string"))]
    metadata = F.map_filter(F.create_map(*[x for k, v in [*always, *maybe] for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    return rows.select(
        ids.node_id(F.lit(repo), F.col("file"), F.col("kind"), F.col("qualified_name"), F.col("occurrence")).alias("id"), F.col("kind").alias("type"), "name", F.substring("raw_text", 1, CONTENT).alias("content"), "qualified_name", F.col("file").alias("file_path"), "language", metadata.alias("metadata"), "pos"
    )


def resolved(parsed_edges: DataFrame, plan: DataFrame, stored: DataFrame) -> DataFrame:
    """Parsed edges (source_qualified_name, target_qualified_name, relationship, weight, language) between node ids.

    A name is looked up in the plan (qualified_name, id, position: the last wins), then in the stored graph (the least
    id). A Python import that fails is tried again below src. Edges without both ends are dropped; one is left of each
    (source, target, relationship).
    """
    own = plan.groupBy("qualified_name").agg(F.max_by("id", "position").alias("own"))
    old = stored.groupBy("qualified_name").agg(F.min("id").alias("old"))
    names = own.join(old, "qualified_name", "full").select("qualified_name", F.coalesce("own", "old").alias("id"))
    at = lambda c, alias: names.select(F.col("qualified_name").alias(c), F.col("id").alias(alias))
    rows = parsed_edges.withColumn("retry", F.when((F.col("language") == "python") & (F.col("relationship") == "imports"), F.concat(F.lit("src."), F.col("target_qualified_name"))))
    rows = rows.join(at("source_qualified_name", "source_id"), "source_qualified_name").join(at("target_qualified_name", "first_id"), "target_qualified_name", "left").join(at("retry", "second_id"), "retry", "left")
    rows = rows.withColumn("target_id", F.coalesce("first_id", "second_id")).filter("target_id is not null")
    return rows.groupBy("source_id", "target_id", "relationship").agg(F.max("weight").alias("weight"))


def retained(edges: DataFrame, replaced: DataFrame, recreated: DataFrame) -> DataFrame:
    """Edges from nodes that stay into nodes that are replaced and there again (both: id)."""
    gone = replaced.select("id").distinct()
    into = edges.join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_semi").join(recreated.select(F.col("id").alias("target_id")).distinct(), "target_id", "left_semi")
    return into.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti")


def replaced_files(nodes: DataFrame, new: DataFrame, files: DataFrame) -> DataFrame:
    """nodes with those of the files (file_path) replaced by the new ones."""
    return nodes.join(files.select("file_path").distinct(), "file_path", "left_anti").select(*nodes.columns).unionByName(new)


def greedy(sizes: DataFrame, by: str, order: str, size: str, max_items: int, max_size: int) -> DataFrame:
    """sizes with `batch`: successive items, `max_items` and `max_size` at most, an item never split.

    The scan is sequential within a group by definition, so a group (a repository, a request queue) is one task.
    """
    kinds = dict(sizes.dtypes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable")
        batch, items, total, out = 0, 0, 0, []
        for n in group[size]:
            if items and (items >= max_items or total + n > max_size):
                batch, items, total = batch + 1, 0, 0
            items, total = items + 1, total + n
            out.append(batch)
        return pd.DataFrame({by: group[by].to_numpy(), order: group[order].to_numpy(), size: group[size].to_numpy(), "batch": out})

    return sizes.select(by, order, size).groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, {order} {kinds[order]}, {size} {kinds[size]}, batch int")


def file_batches(files: DataFrame) -> DataFrame:
    """Files (repo, rel_path, entities) in batches of ingestion."""
    return greedy(files, "repo", "rel_path", "entities", BATCH_FILES, BATCH_ENTITIES)


def request_batches(texts: DataFrame, items: int = EMBED_BATCH, characters: int = REQUEST_CHARACTERS) -> DataFrame:
    """Inputs (queue, position, characters) in requests; one that is too long for any is a row with an error and no batch."""
    fits = F.col("characters") <= characters
    batches = greedy(texts.filter(fits), "queue", "position", "characters", items, characters)
    bad = texts.filter(~fits).select("queue", "position", "characters", F.lit(None).cast("int").alias("batch"), F.lit("an input is too long for a request").alias("error"))
    return batches.withColumn("error", F.lit(None).cast("string")).unionByName(bad)


def chunks(df: DataFrame, order: Column, size: int, by: tuple[str, ...] = ()) -> DataFrame:
    """df with `chunk`: each `size` successive rows of a group."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("chunk", F.floor((nth - 1) / size).cast("int"))


def result_counts(found: DataFrame, todo: DataFrame, gone: DataFrame, failed: DataFrame, entities: DataFrame, parsed_edges: DataFrame, kept_edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row of an ingestion's counters; dropped edges count repeats too."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = n(found, "discovered")
    for df, name in ((todo, "changed"), (gone, "deleted"), (failed, "failed"), (entities, "entities"), (parsed_edges, "parsed"), (kept_edges, "edges"), (vectors, "embeddings")):
        out = out.join(F.broadcast(n(df, name)), F.lit(True))
    return out.withColumn("dropped", F.col("parsed") - F.col("edges")).drop("parsed")


def history(log: DataFrame) -> DataFrame:
    """Log lines (position, line: fields by \\x1f, then paths by newline) as position, sha, author, email, authored_at, subject, paths."""
    head = F.split(F.split("line", "\n")[0], "\x1f")
    paths = F.filter(F.slice(F.split("line", "\n"), 2, 1_000_000), lambda p: F.trim(p) != "")
    rows = log.select("position", head.alias("h"), paths.alias("paths")).filter(F.size("h") == 5)
    return rows.select("position", *[F.col("h")[k].alias(c) for k, c in enumerate(("sha", "author", "email", "authored_at", "subject"))], "paths")


def provenance(commits: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of commits (position, sha, author, email, paths): a contributor by email, whose first name wins."""
    c = commits.select(ids.commit_id(F.col("sha")).alias("id"), F.lit("commit").alias("type"), F.col("sha").alias("name"))
    p = commits.groupBy(ids.contributor_id(F.col("email")).alias("id")).agg(F.min_by("author", "position").alias("name")).select("id", F.lit("contributor").alias("type"), "name")
    by = commits.select(ids.commit_id(F.col("sha")).alias("source_id"), ids.contributor_id(F.col("email")).alias("target_id"), F.lit("authored_by").alias("relationship"))
    at = commits.select(ids.commit_id(F.col("sha")).alias("source_id"), F.explode("paths").alias("path")).join(files.select(F.col("file_path").alias("path"), F.col("id").alias("target_id")), "path")
    return c.unionByName(p), by.unionByName(at.select("source_id", "target_id", F.lit("modifies").alias("relationship"))).distinct()


def parsed(files: DataFrame, parse) -> DataFrame:
    """Files (file, content) through parse(content, file) -> (entities, edges); a file's failure is a row, not the job's."""
    schema = "file string, ok boolean, error string, entities int, edges int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, content in zip(batch["file"], batch["content"], strict=True):
                try:
                    found = parse(content, file)
                    rows.append((file, True, None, len(found[0]), len(found[1])))
                except Exception as e:  # noqa: BLE001
                    rows.append((file, False, type(e).__name__, 0, 0))
            yield pd.DataFrame(rows, columns=["file", "ok", "error", "entities", "edges"])

    return files.select("file", "content").mapInPandas(run, schema)
