"""The whole ingestion against a store of its own."""

import pytest
from pyspark.sql import functions as F

from graphloom.plans import ingest
from graphloom.sources.store import Conflict, Store

FILES = {
    "src/a.py": "import b\n\ndef one():\n    return two()\n",
    "src/b.py": "def two():\n    pass\n\nclass K(Base):\n    def go(self):\n        one()\n",
    "notes.md": "plain\ntext\n",
    "node_modules/x.py": "def hidden(): pass\n",
    "bad.py": "x = '\0'\n",
}


def frame(spark, files):
    return spark.createDataFrame([(p, t.encode()) for p, t in files.items()], "path string, content binary")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def embed(text):
    return F.array(F.length(text).cast("float"), F.lit(1.0).cast("float"))


def graph_of(store):
    return rows(store.read("nodes"), "id", "type", "name", "file_path", "content"), rows(store.read("edges"), "source_id", "target_id", "relationship", "weight"), rows(store.read("files"), "rel_path", "content_hash"), rows(store.read("vectors"), "node_id")


def test_full_ingest_and_what_follows(spark, tmp_path):
    store = Store(spark, str(tmp_path / "one"))
    job = ingest.Ingestion(store, "/repo", embed)
    found = job.full(frame(spark, FILES)).row()
    assert (found["discovered"], found["changed"], found["failed"], found["deleted"]) == (3, 3, 0, 0)
    names = {r[0] for r in rows(store.read("nodes"), "qualified_name")}
    assert {"src.a", "src.a.one", "src.b.two", "src.b.K.go", "notes.md"} <= names and not any("hidden" in n for n in names)
    by_name = {r["id"]: r["qualified_name"] for r in store.read("nodes").collect()}
    edges = {(by_name[a], by_name[b], r) for a, b, r in rows(store.read("edges"), "source_id", "target_id", "relationship")}
    assert ("src.a", "src.b", "imports") in edges and ("src.b.K", "src.b.K.go", "contains") in edges
    assert found["embeddings"] == found["entities"] == len(by_name)
    assert job.full(frame(spark, FILES)).changed == 0
    # A changed file, an explicit deletion, and what a full run of the same files gives.
    later = FILES | {"src/b.py": "def two():\n    return 3\n"}
    step = job.some(frame(spark, {"src/b.py": later["src/b.py"]}), ("notes.md",))
    assert (step.changed, step.deleted) == (1, 1)
    del later["notes.md"]
    other = Store(spark, str(tmp_path / "two"))
    ingest.Ingestion(other, "/repo", embed).full(frame(spark, later))
    assert graph_of(store) == graph_of(other)
    del later["src/a.py"]
    assert job.cleanup(frame(spark, later)).deleted == 1
    assert {r[0] for r in rows(store.read("files"), "rel_path")} == {"src/b.py"}


def test_a_file_that_fails_or_changes_is_not_acknowledged(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    broken = {"ok.py": "a1 = 1\n", "deep.py": "(" * 300 + "1" + ")" * 300 + "\n"}
    moved = dict(broken, **{"ok.py": "a1 = 2\n"})
    found = ingest.Ingestion(store, "/r", again=lambda: frame(spark, moved)).full(frame(spark, broken))
    assert found.degraded == "a source changed while it was ingested" and found.failed >= 1
    assert "ok.py" not in {r[0] for r in rows(store.read("files"), "rel_path")}
    again = ingest.Ingestion(store, "/r").full(frame(spark, {"ok.py": "a1 = 1\n"}))
    assert again.changed == 1 and {r[0] for r in rows(store.read("files"), "rel_path")} == {"ok.py"}


def test_versions_of_a_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "v"))
    node = lambda i: (i, "function", i, "", i, "f.py", "python", {}, "/r")
    from graphloom.sources.store import SCHEMAS

    nodes = lambda *names: spark.createDataFrame([node(n) for n in names], SCHEMAS["nodes"])
    assert store.version() == 0 and store.read("nodes").count() == 0
    first = store.upsert_nodes(nodes("a", "b", "c"))
    edge = "source_id string, target_id string, relationship string, weight double"
    store.upsert_edges(spark.createDataFrame([("a", "b", "calls", 1.0), ("a", "gone", "calls", 1.0)], edge))
    store.upsert_edges(spark.createDataFrame([("a", "b", "calls", 2.0)], edge))
    assert rows(store.read("edges"), "source_id", "target_id", "weight") == [("a", "b", 2.0)]
    with pytest.raises(ValueError, match="unknown relationship"):
        store.upsert_edges(spark.createDataFrame([("a", "b", "likes", 1.0)], edge))
    with pytest.raises(ValueError, match="dimensions"):
        store.upsert_vectors(spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], SCHEMAS["vectors"]), "p", "m", 2)
    store.upsert_vectors(spark.createDataFrame([("a", [1.0, 2.0])], SCHEMAS["vectors"]), "p", "m", 2)
    assert store.searchable("p", "m", 2).count() == 1 and store.searchable("p", "other", 2).count() == 0
    held = store.read("nodes", first)
    store.delete_nodes(spark.createDataFrame([("a",)], "id string"))
    assert (held.count(), store.read("nodes").count(), store.read("edges").count(), store.read("vectors").count()) == (3, 2, 0, 0)
    with pytest.raises(Conflict):
        store.commit({"nodes": nodes("x")}, on=first)
    assert store.vacuum() > 0 and store.versions() == [store.version()]
    assert store.read("nodes").count() == 2
    store.truncate()
    assert store.read("nodes").count() == 0


def test_acknowledging_a_stream(spark, tmp_path):
    store = Store(spark, str(tmp_path / "a"))
    schema = "repo string, rel_path string, file_id string, language string, content_hash string, byte_size long, indexed_at string, node_id string, vector array<float>"
    spark.createDataFrame([("/r", "a.py", "f", "python", "h", 1, "t", f"n{k}", [1.0, 2.0]) for k in range(3)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = stream.writeStream.foreachBatch(ingest.acknowledging(store)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert rows(store.read("files"), "rel_path") == [("a.py",)] and store.read("vectors").count() == 3
