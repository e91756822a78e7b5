"""Ingestion as one incremental job: discover, compare, parse, plan, resolve, replace, embed, acknowledge.

The steps are DataFrames that end in commits of the store. The structure (nodes, edges, and what is deleted) is one
version, the vectors another; files are acknowledged last, when their vectors are there and their bytes are still those
that were parsed. So a run that breaks off leaves whole versions behind, and the next one reads the files again that
weren't acknowledged.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import ids, parsing
from graphloom.functions.text import embed_text
from graphloom.operators import aggregates, discovery, graph, ingestion, lookup
from graphloom.sources.store import Store

#: Turns texts (a column) into vectors.
Embedder = Callable[[Column], Column]


@dataclass
class Result:
    """What a run did. Dropped edges count repeats too."""

    discovered: int = 0
    changed: int = 0
    deleted: int = 0
    failed: int = 0
    entities: int = 0
    edges: int = 0
    dropped: int = 0
    embeddings: int = 0
    degraded: str | None = None

    def row(self) -> dict:
        return asdict(self)


@dataclass
class Ingestion:
    """Ingests files (path, content: binary) of a repository into a store."""

    store: Store
    repo: str
    embed: Embedder | None = None
    now: str = "1970-01-01T00:00:00Z"
    #: Gives the files (path, content) again, to see before the acknowledgement whether they have changed.
    again: Callable[[], DataFrame] | None = None

    def full(self, files: DataFrame, force: bool = False, ignored: DataFrame | None = None) -> Result:
        """All files that can be discovered; indexed ones that can't any more are deleted."""
        found = self._discovered(files, ignored, prune=True)
        return self._ingest(found, force, self._stale(found))

    def some(self, files: DataFrame, deleted: tuple[str, ...] = ()) -> Result:
        """These files, and explicit deletions; other indexed files stay as they are."""
        gone = self.store.spark.createDataFrame([(p,) for p in deleted], "rel_path string")
        return self._ingest(self._discovered(files), False, gone)

    def cleanup(self, files: DataFrame, ignored: DataFrame | None = None) -> Result:
        """Deletes indexed files that can't be discovered any more."""
        found = self._discovered(files, ignored, prune=True)
        result = Result(discovered=found.count())
        self._delete(self._stale(found), result)
        return result

    # ---- Steps --------------------------------------------------------------------------------------------------

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        """A table of this run in the store's folder: read more than once, made once."""
        path = f"{self.store.root}/drafts/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def _own(self, table: str) -> DataFrame:
        return self.store.read(table).filter(F.col("repo") == self.repo)

    def _discovered(self, files: DataFrame, ignored: DataFrame | None = None, prune: bool = False) -> DataFrame:
        sized = files.select("path", "content", F.octet_length("content").cast("long").alias("size"))
        folders = discovery.pruned_folders(aggregates.folders(sized)) if prune else None
        found = discovery.discovered(sized, ignored=ignored, folders=folders)
        return self._kept(found.join(files.select(F.col("path").alias("rel_path"), "content"), "rel_path"), "found")

    def _stale(self, found: DataFrame) -> DataFrame:
        indexed = self._own("nodes").filter("file_path is not null").select(F.col("file_path").alias("rel_path")).union(self._own("files").select("rel_path")).distinct()
        return ingestion.stale(found, indexed)

    def _delete(self, gone: DataFrame, result: Result) -> None:
        """Nodes of files with their edges and vectors, and then the files' hashes, in one version."""
        gone = self._kept(gone, "gone")
        result.deleted = gone.count()
        if not result.deleted:
            return
        own = self._own("nodes").join(gone.withColumnRenamed("rel_path", "file_path"), "file_path", "left_semi").select("id")
        nodes, edges, vectors = graph.deleted(self.store.read("nodes"), self.store.read("edges"), self.store.read("vectors"), own)
        hashes = self.store.read("files").join(gone.withColumn("repo", F.lit(self.repo)), ["repo", "rel_path"], "left_anti")
        self.store.commit({"nodes": nodes, "edges": edges, "vectors": vectors, "files": hashes})

    def _unembedded(self) -> DataFrame | None:
        if self.embed is None:
            return None
        return lookup.without_embedding(self._own("nodes"), self.store.read("vectors")).select(F.col("file_path").alias("rel_path")).distinct()

    def _parsed(self, todo: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Entities, edges between names, and failures (file, error). Text files are one entity with their whole source."""
        source = todo.select(F.col("rel_path").alias("path"), "rel_path", "language", F.decode("content", "UTF-8").alias("content"))
        code = source.filter("language <> 'text'")
        entities = self._kept(parsing.parse_files(code), "entities")
        texts = ingestion.text_entities(source.filter("language = 'text'")).select(F.col("name").alias("file"), F.lit("text").alias("language"), F.lit(0).alias("pos"), "*")
        good = entities.filter("error is null").unionByName(texts, allowMissingColumns=True)
        none = F.array().cast("array<string>")
        good = good.withColumn("bases", F.coalesce("bases", none)).withColumn("imports", F.coalesce("imports", none))
        return good, parsing.parse_edges(code), entities.filter("error is not null").select("file", "error")

    def _ingest(self, found: DataFrame, force: bool, gone: DataFrame) -> Result:
        result = Result(discovered=found.count())
        self._delete(gone, result)
        changed = ingestion.changed(found.select("rel_path", "content_hash"), self._own("files"), self._unembedded(), force)
        todo = self._kept(found.join(changed.select("rel_path"), "rel_path", "left_semi"), "todo")
        result.changed = todo.count()
        if not result.changed:
            return result
        entities, named, failures = self._parsed(todo)
        result.failed = failures.count()
        done = todo.join(failures.select(F.col("file").alias("rel_path")), "rel_path", "left_anti")
        planned = self._kept(ingestion.planned_nodes(entities, self.repo).withColumn("repo", F.lit(self.repo)), "planned")
        # The plan's last node of a name wins; other names are looked up in what is stored of this repository.
        plan = planned.select("qualified_name", "id", F.struct("file_path", "pos").alias("position"))
        named = self._kept(named, "named")
        edges = self._kept(ingestion.resolved(named, plan, self._own("nodes")), "resolved")
        old = self._own("nodes").join(done.select(F.col("rel_path").alias("file_path")), "file_path", "left_semi").select("id")
        last = plan.groupBy("qualified_name").agg(F.max_by("id", "position").alias("id")).select("id")
        kept = ingestion.retained(self.store.read("edges"), old, last)
        nodes, rest, vectors = graph.deleted(self.store.read("nodes"), self.store.read("edges"), self.store.read("vectors"), old)
        nodes = nodes.select(*planned.drop("pos").columns).unionByName(planned.drop("pos"))
        new = edges.withColumn("position", F.lit(1)).unionByName(kept.withColumn("position", F.lit(0)))
        new = graph.accepted(new.unionByName(rest.withColumn("position", F.lit(-1))), nodes)
        self.store.commit({"nodes": nodes, "edges": new, "vectors": vectors})
        result.entities, result.edges = planned.count(), graph.accepted(edges.withColumn("position", F.lit(1)), self._own("nodes")).count()
        result.dropped = named.count() - edges.count()
        self._acknowledge(done, planned, entities, result)
        return result

    def _acknowledge(self, done: DataFrame, planned: DataFrame, entities: DataFrame, result: Result) -> None:
        """Vectors first, then a look at whether they are there and the sources unchanged, then the hashes."""
        if self.embed is not None:
            text = embed_text(F.col("kind"), F.col("name"), F.col("qualified_name"), F.col("signature"), F.col("docstring"), F.col("raw_text"))
            numbered = ingestion.occurrences(entities)
            node = ids.node_id(F.lit(self.repo), F.col("file"), F.col("kind"), F.col("qualified_name"), F.col("occurrence"))
            vectors = self._kept(numbered.select(node.alias("node_id"), self.embed(text).alias("vector")), "vectors")
            self.store.commit({"vectors": lookup.upserted(self.store.read("vectors"), vectors, ["node_id"])})
            result.embeddings = vectors.count()
            if not lookup.absent(planned, self.store.read("vectors")).isEmpty():
                result.failed += done.count()
                result.degraded = "a vector of this run is missing"
                return
        if self.again is not None:
            now = self.again().select(F.col("path").alias("rel_path"), F.sha2("content", 256).alias("now"))
            moved = done.join(now, "rel_path", "left").filter(~F.col("content_hash").eqNullSafe(F.col("now"))).select("rel_path")
            moved = self._kept(moved, "moved")
            if n := moved.count():
                result.failed += n
                result.degraded = "a source changed while it was ingested"
                done = done.join(moved, "rel_path", "left_anti")
        record = done.select(F.lit(self.repo).alias("repo"), "rel_path", ids.file_id(F.lit(self.repo), F.col("rel_path")).alias("file_id"), "language", "content_hash", "byte_size", F.lit(self.now).alias("indexed_at"))
        self.store.acknowledge(record)


def acknowledging(store: Store) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over (repo, rel_path, file_id, language, content_hash, byte_size, indexed_at, node_id, vector): a
    batch's vectors become a version, are looked for, and only then its files are acknowledged. A batch that is given
    again writes the same rows again."""

    def step(batch: DataFrame, _number: int) -> None:
        batch = batch.persist()
        try:
            vectors = batch.select("node_id", F.col("vector").cast("array<float>").alias("vector")).filter("node_id is not null")
            store.commit({"vectors": lookup.upserted(store.read("vectors"), vectors.dropDuplicates(["node_id"]), ["node_id"])})
            missing = lookup.absent(vectors.select(F.col("node_id").alias("id")), store.read("vectors"))
            if not missing.isEmpty():
                raise RuntimeError("a vector of this batch is missing")
            store.acknowledge(batch.drop("node_id", "vector").dropDuplicates(["repo", "rel_path"]))
        finally:
            batch.unpersist()

    return step
