"""Suites, saved projects, repository fingerprints and alias paths."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUITE = "name string, cases array<struct<query: string, relevant: array<struct<qualified_name: string, file_path: string, relevance: int>>>>"


def suite(spark: SparkSession, path: str) -> DataFrame:
    """An evaluation suite's judgments, strictly read: case_id, query, pos, qualified_name, file_path, grade."""
    rows = spark.read.schema(SUITE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    cases = rows.select(F.posexplode("cases").alias("case_id", "c")).select("case_id", "c.query", F.posexplode("c.relevant").alias("pos", "r"))
    valid = F.assert_true((F.length(F.trim("query")) > 0) & (F.col("r.relevance") >= 1), F.lit("a case needs a query and relevances from 1"))
    return cases.filter(valid.isNull()).select("case_id", "query", "pos", "r.qualified_name", "r.file_path", F.col("r.relevance").alias("grade"))


def saved_projects(projects: DataFrame, records: DataFrame) -> DataFrame:
    """Projects (id, root) with the number of their records (project_id, value: JSON) and the last indexing in them."""
    by = records.groupBy("project_id").agg(F.count(F.lit(1)).alias("files"), F.max(F.get_json_object("value", "$.indexed_at")).alias("last_indexed"))
    return projects.join(by, F.col("id") == F.col("project_id"), "left").select("id", "root", F.coalesce("files", F.lit(0).cast("long")).alias("files"), "last_indexed")


def dirty_paths(status: Column) -> Column:
    """The paths of a NUL-separated status listing in order; a rename or copy has a second field, its source."""
    records = F.split(status, "\0")
    start = F.struct(F.array().cast("array<string>").alias("paths"), F.lit(False).alias("source"))

    def step(acc: Column, record: Column) -> Column:
        path = F.when(acc["source"], record).otherwise(F.substring(record, F.lit(4), F.length(record)))
        two = ~acc["source"] & F.substring(record, 1, 2).rlike("[RC]")
        return F.when(record == "", acc).otherwise(F.struct(F.concat(acc["paths"], F.array(path)).alias("paths"), two.alias("source")))

    return F.aggregate(records, start, step, lambda acc: acc["paths"])


def fingerprints(states: DataFrame, metadata: DataFrame) -> DataFrame:
    """Each repository's state (repo, head, status: NUL-separated records) with the metadata of its dirty paths (repo,
    path, metadata; without a row the path is missing) as one digest: head, status and metadata, joined by NUL."""
    dirty = states.select("repo", F.posexplode(dirty_paths(F.col("status"))).alias("at", "path"))
    seen = dirty.join(metadata, ["repo", "path"], "left").select("repo", F.struct("at", F.coalesce("metadata", F.lit("missing")).alias("m")).alias("m"))
    lines = seen.groupBy("repo").agg(F.array_sort(F.collect_list("m")).alias("all"))  # a repository's own dirty paths
    tail = F.coalesce(F.array_join(F.transform("all", lambda x: F.concat(F.lit("\0"), x["m"])), ""), F.lit(""))
    whole = F.concat(F.coalesce("head", F.lit("")), F.lit("\0"), F.coalesce("status", F.lit("")), tail)
    return states.join(lines, "repo", "left").select("repo", F.sha2(F.encode(whole, "UTF-8"), 256).alias("fingerprint"))


def visible_paths(root: str) -> list[str]:
    """The paths of a work tree that version control doesn't ignore, sorted; where it can't say, all files that the
    root's ignore file doesn't name are left to `discovery.ignored`. A listing of names on the driver, not of contents."""
    try:
        found = subprocess.run(["git", "ls-files", "-co", "--exclude-standard", "-z"], cwd=root, capture_output=True, timeout=60, check=True)
        names = found.stdout.decode("utf-8", "surrogateescape").split("\0")
        return sorted({n for n in names if n and (Path(root) / n).is_file()})
    except (OSError, subprocess.SubprocessError):
        return sorted(p.relative_to(root).as_posix() for p in Path(root).rglob("*") if p.is_file())


def work_tree(spark: SparkSession, root: str) -> DataFrame:
    """The visible files of a work tree (path, content, size) below a folder that all executors see.

    Files are opened by name in the tasks: Spark's own file readers leave out names that begin with a dot or underscore.
    """
    from graphloom.operators.discovery import ignore_rules, ignored

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                content = (Path(root) / name).read_bytes()
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary()), pa.array([len(content)], pa.int64())], names=["path", "content", "size"])

    listed = spark.createDataFrame([(p,) for p in visible_paths(root)], "path string")
    rules = Path(root) / ".gitignore"
    if rules.exists():
        listed = listed.filter(~ignored(F.col("path"), ignore_rules(rules.read_text())))
    return listed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(read, "path string, content binary, size long")


def normalized(path: Column) -> Column:
    """A path without empty, '.' and '..' parts; null if it leads out of its root."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    step = lambda acc, p: F.when(acc.isNull(), acc).when(p != "..", F.concat(acc, F.array(p))).when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def contained_aliases(files: DataFrame, aliases: DataFrame) -> DataFrame:
    """Aliases (path, target) whose target is a kept file of the repository; the alias keeps its own name."""
    targets = aliases.withColumn("target", normalized(F.col("target"))).filter("target is not null")
    return targets.join(files.select(F.col("path").alias("target")), "target", "left_semi").select("path", "target")
