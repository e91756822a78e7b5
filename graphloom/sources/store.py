"""A graph store of versioned Parquet tables, which is the sink of ingestion.

A version is a small JSON manifest that names the folders of its tables. A commit writes new folders first and then the
next manifest, by a rename that fails if another writer was there before. Readers hold a version: what they read doesn't
change below them, and a deletion that is being committed neither waits for them nor makes them fail. Tables a commit
doesn't name are carried over by reference. vacuum() deletes folders that the last versions don't name.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph, lookup

SCHEMAS = {
    "nodes": "id string, type string, name string, content string, qualified_name string, file_path string, language string, metadata map<string,string>, repo string",
    "edges": "source_id string, target_id string, relationship string, weight double",
    "vectors": "node_id string, vector array<float>",
    "files": "repo string, rel_path string, file_id string, language string, content_hash string, byte_size long, indexed_at string",
    "identity": "provider string, model string, dimension int",
}
# The closed lists of node types and relationships.
NODE_TYPES = ("file", "module", "class", "function", "method", "variable", "constant", "import", "type_alias", "commit", "contributor")
RELATIONSHIPS = ("contains", "calls", "imports", "inherits", "implements", "references", "authored_by", "modifies")


class Conflict(RuntimeError):
    """Another writer committed first."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ---- Versions -----------------------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/versions")
        if not self._fs.exists(folder):
            return []
        return sorted(int(f.getPath().getName().removesuffix(".json")) for f in self._fs.listStatus(folder) if f.getPath().getName().endswith(".json"))

    def version(self) -> int:
        """The last committed version; 0 for an empty store."""
        return max(self.versions(), default=0)

    def manifest(self, version: int) -> dict[str, str]:
        if not version:
            return {}
        stream = self._fs.open(self._path(f"{self.root}/versions/{version:09d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as it is in a version, the last by default; it stays so whatever is committed later."""
        folder = self.manifest(self.version() if version is None else version).get(table)
        if folder is None:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.root}/{folder}")

    def write(self, table: str, rows: DataFrame) -> str:
        """rows in a folder of their own, which no version names yet."""
        names = [c.split()[0] for c in SCHEMAS[table].replace("map<string,string>", "map").split(", ")]
        folder = f"data/{table}-{uuid.uuid4().hex}"
        rows.select(*names).write.parquet(f"{self.root}/{folder}")
        return folder

    def commit(self, tables: dict[str, DataFrame], on: int | None = None) -> int:
        """The next version, with these tables in place of version `on`'s (the last by default)."""
        on = self.version() if on is None else on
        folders = self.manifest(on) | {name: self.write(name, rows) for name, rows in tables.items()}
        draft = self._path(f"{self.root}/drafts/{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(folders).encode()))
        stream.close()
        self._fs.mkdirs(self._path(f"{self.root}/versions"))
        target = self._path(f"{self.root}/versions/{on + 1:09d}.json")
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise Conflict(f"version {on + 1} is there already")
        return on + 1

    def vacuum(self, keep: int = 1) -> int:
        """Deletes folders that none of the last `keep` versions names, and older manifests; how many folders went."""
        every = self.versions()
        named = {f for v in every[-keep:] for f in self.manifest(v).values()}
        gone = 0
        data = self._path(f"{self.root}/data")
        if self._fs.exists(data):
            for status in self._fs.listStatus(data):
                if f"data/{status.getPath().getName()}" not in named:
                    gone += self._fs.delete(status.getPath(), True)
        for v in every[:-keep]:
            self._fs.delete(self._path(f"{self.root}/versions/{v:09d}.json"), False)
        return gone

    def truncate(self) -> int:
        """A version without rows."""
        return self.commit({t: self.spark.createDataFrame([], s) for t, s in SCHEMAS.items()})

    def clear_hashes(self) -> int:
        """A version in which no file counts as ingested, so that the next run reads all again."""
        return self.commit({"files": self.spark.createDataFrame([], SCHEMAS["files"])})

    # ---- Upserts ------------------------------------------------------------------------------------------------

    def upsert_nodes(self, new: DataFrame) -> int:
        checked(new, "type", NODE_TYPES)
        return self.commit({"nodes": lookup.upserted(self.read("nodes"), new, ["id"])})

    def upsert_edges(self, new: DataFrame) -> int:
        """One edge for each (source, target, relationship), the new one's weight; those without both nodes are dropped."""
        checked(new, "relationship", RELATIONSHIPS)
        rows = self.read("edges").withColumn("position", F.lit(0)).unionByName(new.withColumn("position", F.lit(1)))
        return self.commit({"edges": graph.accepted(rows, self.read("nodes"))})

    def upsert_vectors(self, new: DataFrame, provider: str, model: str, dimension: int) -> int:
        """Vectors (node_id, vector); one of another dimension rejects all of them. Another identity quarantines the stored ones."""
        if not lookup.dimension_errors(new, dimension).isEmpty():
            raise ValueError(f"a vector hasn't {dimension} dimensions")
        identity = self.spark.createDataFrame([(provider, model, dimension)], SCHEMAS["identity"])
        old = self.read("vectors") if self.identity() in (None, (provider, model, dimension)) else self.read("vectors", 0)
        return self.commit({"vectors": lookup.upserted(old, new, ["node_id"]), "identity": identity})

    def identity(self, version: int | None = None) -> tuple[str, str, int] | None:
        row = self.read("identity", version).first()
        return tuple(row) if row else None

    def searchable(self, provider: str, model: str, dimension: int, version: int | None = None) -> DataFrame:
        """The vectors, if they are of this provider, model and dimension; none if they are quarantined."""
        found = self.identity(version)
        return self.read("vectors", version if found in (None, (provider, model, dimension)) else 0)

    def delete_nodes(self, ids: DataFrame) -> int:
        """Nodes (id) with their edges and vectors, in one version."""
        nodes, edges, vectors = graph.deleted(self.read("nodes"), self.read("edges"), self.read("vectors"), ids)
        return self.commit({"nodes": nodes, "edges": edges, "vectors": vectors})

    def acknowledge(self, files: DataFrame) -> int:
        """Files as ingested, in the place of what was known of them."""
        return self.commit({"files": lookup.upserted(self.read("files"), files, ["repo", "rel_path"])})


def checked(rows: DataFrame, column: str, allowed: tuple[str, ...]) -> None:
    """Raises for a value that isn't in the closed list: nothing is written then."""
    bad = rows.filter(~F.col(column).isin(*allowed) | F.col(column).isNull()).select(column).first()
    if bad is not None:
        raise ValueError(f"unknown {column}: {bad[0]}")
