"""Expected answers on small inputs."""

import datetime
import hashlib
import hmac
import uuid

import pandas as pd
import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import ids, parsing, text
from graphloom.operators import discovery, evaluation, graph, ingestion, lookup, search
from graphloom.plans import playbooks
from graphloom.sources import tables
from graphloom.streaming import changes

EDGE = "source_id string, target_id string, relationship string, weight double"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_ids(spark):
    assert one(spark, ids.edge_id(F.lit("a"), F.lit("b"), F.lit("calls"))) == str(uuid.uuid5(uuid.UUID(ids.EDGE_NAMESPACE), "a:b:calls"))
    assert one(spark, ids.keyed_hash(b"k", F.lit("repo"))) == hmac.new(b"k", b"repo", "sha256").hexdigest()[:16]
    assert one(spark, ids.keyed_hash(b"k", F.lit(""))) == ""
    assert one(spark, ids.node_id(F.lit("r"), F.lit("a.py"), F.lit("function"), F.lit("a.f"))) == hashlib.sha256(b"r:a.py:function:a.f").hexdigest()[:32]
    assert one(spark, ids.node_id(F.lit("r"), F.lit("a.py"), F.lit("function"), F.lit("a.f"), F.lit(2))) == hashlib.sha256(b"occurrence:2:r:a.py:function:a.f").hexdigest()[:32]


@pytest.mark.parametrize("value", ["型" * 300, "─" * 171, "🔥" * 200, "a" * 600, "é" + "a" * 511, "a" * 511 + "é", "short"])
def test_truncation_never_splits_a_character(spark, value):
    assert one(spark, text.cut_bytes(F.lit(value), 512)) == value.encode()[:512].decode(errors="ignore")


def test_redaction(spark):
    found = one(spark, text.redacted(F.lit("repo_path=/Users/alice/x query=secret limit=20 /etc/passwd ok k=" + "z" * 97)))
    assert found == "repo_path=<redacted> query=<redacted> limit=20 ok k=<redacted>"


def test_fusion(spark):
    rows = [("semantic", 1, "semantic", 0.1), ("semantic", 2, "shared", 0.2), ("lexical", 1, "lexical", None), ("lexical", 2, "shared", None)]
    fused = search.fused(spark.createDataFrame(rows, "source string, rank int, id string, distance double"))
    found = {r["id"]: r["distance"] for r in fused.collect()}
    assert [r["id"] for r in fused.orderBy(F.desc("score"), "id").collect()] == ["shared", "lexical", "semantic"]
    assert found == {"shared": 0.2, "lexical": None, "semantic": 0.1}
    assert search.candidates(3) == 20
    with pytest.raises(ValueError):
        search.effective_queries(["a", " "])


def test_traversal_takes_the_least_shortest_path(spark):
    edges = spark.createDataFrame([("a", "c", "x", 1.0), ("a", "b", "x", 1.0), ("b", "d", "x", 1.0), ("c", "d", "x", 1.0), ("d", "a", "x", 1.0)], EDGE)
    found = {r["id"]: (r["depth"], r["path"]) for r in graph.traverse(edges, spark.createDataFrame([("a",)], "id string"), 3).collect()}
    assert found == {"a": (0, ["a"]), "b": (1, ["a", "b"]), "c": (1, ["a", "c"]), "d": (2, ["a", "b", "d"])}


def test_deletion_cascades(spark):
    nodes = spark.createDataFrame([(f"n{k}",) for k in range(8)], "id string")
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}", "calls", 1.0) for k in range(7)], EDGE)
    vectors = spark.createDataFrame([(f"n{k}",) for k in range(8)], "node_id string")
    left = graph.deleted(nodes, edges, vectors, nodes.filter("id < 'n7'"))
    assert [df.count() for df in left] == [1, 0, 1]


def test_inspection_order(spark):
    rows = [(f"a-{k:03}", "import", f"a-{k:03}", "f", 1, 1) for k in range(150)] + [(f"z-{k:03}", "function", f"z-{k:03}", "f", 5, 9) for k in range(12)]
    nodes = spark.createDataFrame(rows, "id string, type string, name string, file_path string, start_line long, end_line long")
    found, edges = graph.inspect_file(nodes, spark.createDataFrame([], EDGE), "f", 5)
    assert sorted(r["id"] for r in found.collect()) == [f"z-{k:03}" for k in range(5)]
    assert found.first()["truncated"] and edges.count() == 0


def test_narrowest_node_at_position(spark):
    nodes = spark.createDataFrame([("file", "f", 0, 9, "f"), ("run", "f", 1, 2, "run"), ("other", "f", 1, 2, "o")], "id string, file_path string, start_line long, end_line long, name string")
    found = lookup.at_positions(nodes, spark.createDataFrame([("f", 1), ("f", 8), ("g", 1)], "file_path string, line int")).collect()
    assert sorted((r["line"], r["id"]) for r in found) == [(1, "other"), (8, "file")]


def test_positions_are_not_broadcast(spark, tmp_path):
    """Only the table of levels may be: positions grow with the data."""
    spark.createDataFrame([(k, f"n{k}", "Brand#1", "A B") for k in range(4)], "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    files = tables.files(spark, str(tmp_path))
    found = lookup.at_positions(files, files.select("file_path", F.explode(F.array(F.lit(10), F.lit(401))).alias("line")))
    assert sorted(r["id"] for r in found.collect()) == ["P:0", "P:1", "P:2", "P:3"]
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().sparkPlan().toString()


def test_files_of_functions_are_not_broadcast(spark, tmp_path):
    """Their paths are far larger than their Parquet file and grow with the data."""
    spark.createDataFrame([(k, f"n{k}", "Brand#1", "A B") for k in range(4)], "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string"
    spark.createDataFrame([(k, k % 4, 1, 1, 7.0, "A", "F") for k in range(40)], line).write.parquet(f"{tmp_path}/lineitem.parquet")
    files, functions = tables.files(spark, str(tmp_path)), tables.functions(spark, str(tmp_path))
    found = lookup.at_positions(files.unionByName(functions), files.select("file_path", F.lit(10).alias("line")))
    assert sorted(r["id"] for r in found.collect()) == ["L:10:1:2:1", "L:3:1:3:1", "L:4:1:0:1", "L:5:1:1:1"]
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().sparkPlan().toString()


def test_node_of_any_span_at_position(spark):
    nodes = spark.createDataFrame([("all", "f", 0, 1 << 33, "all"), ("one", "f", 5, 5, "one")], "id string, file_path string, start_line long, end_line long, name string")
    found = lookup.at_positions(nodes, spark.createDataFrame([("f", 5), ("f", 1 << 32)], "file_path string, line long")).collect()
    assert sorted((r["line"], r["id"]) for r in found) == [(5, "one"), (1 << 32, "all")]


def test_ndcg(spark):
    judged = spark.createDataFrame([(1, 0, "parser", None, 3), (1, 1, "loader", None, 1)], "case_id int, pos long, qualified_name string, file_path string, grade int")
    results = spark.createDataFrame([(1, 1, "loader", "f"), (1, 2, "parser", "f"), (1, 3, "other", "f")], "case_id int, rank int, qualified_name string, file_path string")
    r = evaluation.retrieval(results, judged, 2).first()
    log3 = 1.584962500721156
    assert (r["recall"], r["reciprocal_rank"]) == (1.0, 1.0)
    assert abs(r["ndcg"] - (1 + 7 / log3) / (7 + 1 / log3)) < 1e-9


def test_a_judgment_is_used_once(spark):
    judged = spark.createDataFrame([(1, 0, "a", None, 1), (1, 1, "a", None, 2)], "case_id int, pos long, qualified_name string, file_path string, grade int")
    results = spark.createDataFrame([(1, k, "a", "f") for k in (1, 2, 3)], "case_id int, rank int, qualified_name string, file_path string")
    assert sorted((r["rank"], r["grade"]) for r in evaluation.matched(results, judged).collect()) == [(1, 1), (2, 2)]


def test_discovery(spark):
    rows = [("a.py", b"x = 1"), ("b.bin", b"\0\1"), ("big.py", b"x" * 2_000_000), ("node_modules/c.py", b"y"), ("note", b"hello"), ("cut.py", b"a" * 8191 + "é".encode())]
    files = spark.createDataFrame(rows, "path string, content binary").withColumn("size", F.octet_length("content").cast("long"))
    found = {r["rel_path"]: r["language"] for r in discovery.discovered(files).collect()}
    assert found == {"a.py": "python", "note": "text"}


def test_src_retry_resolves_an_import(spark):
    edges = spark.createDataFrame([("tests.t", "pkg.mod", "imports", 1.0, "python"), ("tests.t", "pkg.mod", "imports", 1.0, "rust"), ("tests.t", "gone", "calls", 1.0, "python")], "source_qualified_name string, target_qualified_name string, relationship string, weight double, language string")
    plan = spark.createDataFrame([("tests.t", "T", 1), ("src.pkg.mod", "M", 2)], "qualified_name string, id string, position int")
    assert [tuple(r) for r in ingestion.resolved(edges, plan, plan.filter("false")).collect()] == [("T", "M", "imports", 1.0)]


@settings(max_examples=3, deadline=None, phases=[Phase.explicit, Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from("abcd"), max_size=6), st.lists(st.sampled_from("abcd"), max_size=6))
def test_incremental_equals_full(spark, before, after):
    def planned(names):
        source = "\n".join(f"def {n}():\n    return {n}" for n in names) or "x0 = 1"
        files = spark.createDataFrame([("main.py", source), ("kept.py", "def kept():\n    pass")], "path string, content string")
        parsed = parsing.parse_files(files).withColumnRenamed("path", "file").withColumn("imports", F.array().cast("array<string>"))
        return ingestion.planned_nodes(parsed, "repo").drop("metadata")

    old, new = planned(before), planned(after)
    changed = spark.createDataFrame([("main.py",)], "file_path string")
    step = ingestion.replaced_files(old, new.join(changed, "file_path", "left_semi").select(*old.columns), changed)
    assert step.columns == old.columns
    assert sorted(map(str, step.collect())) == sorted(map(str, new.collect()))


@pytest.mark.parametrize("path", list(parsing.SAMPLES))
def test_parsers(path):
    source = parsing.SAMPLES[path].format(n=7, w="red_ring")
    language, entities, edges = parsing.parse(source, f"src/f7.{path}")
    names = {(e.kind, e.name) for e in entities}
    assert language == discovery.LANGUAGES[path]
    assert entities[0].kind == "file" and entities[0].qualified_name == "src.f7"
    if path not in ("sh", "css"):
        assert ("class", "K7") in names
    assert any(n == "red_ring" and k in ("function", "method") for k, n in names)
    assert any(k == "import" for k, _ in names) == any(e.relationship == "imports" for e in edges)


def test_python_quirks():
    _, entities, edges = parsing.parse("import a as b\nfrom m import x as y, z\nif 1:\n    pass\n\ndef f(a, b):\n    return a and b or g(a) or print(b)\n", "m.py")
    assert [e.name for e in entities if e.kind == "import"] == ["z"]
    assert [e.target for e in edges if e.relationship == "calls"] == ["g"]
    assert next(e.complexity for e in entities if e.name == "f") == 4


def test_python_by_the_letter():
    source = """from __future__ import annotations
from . import x
from .m import y, z
import os, sys as s
a, b = pair
x = yy
class K(Base, m.N, Generic[T], metaclass=M):
    '''Doc.'''
    import inner
    @deco(1)
    def go(self, x: int = (1, ")")[0]) -> "K":
        pass
        return [helper(i) for i in x if i for j in k] and self.run(len(x)) or foo()(1)

def broken(:
    pass

async def f():
    match 1:
        case 1: pass
"""
    _, entities, edges = parsing.parse(source, "src/p/q.py")
    got = {(e.kind, e.qualified_name.removeprefix("src.p.q").lstrip(".")) for e in entities}
    assert got == {("file", ""), ("import", "import.os"), ("import", "import.y.z"), ("import", "import.inner"), ("variable", "pair"), ("variable", "yy"), ("class", "K"), ("method", "K.go"), ("function", "f")}
    go, k, f = (next(e for e in entities if e.name == n) for n in ("go", "K", "f"))
    assert (go.signature, go.complexity, f.complexity) == ('(self, x: int = (1, ")")[0]) -> "K"', 4, 1)
    assert (k.bases, k.docstring, k.signature, k.parent) == (("Base", "m.N"), "Doc.", "", "src.p.q")
    assert sorted(e.target for e in edges if e.relationship == "calls") == ["foo", "helper", "run"]
    assert ("src.p.q", "src.p.q.import.os", "contains") in set(edges) and next(e for e in entities if e.name == "os").imports == ("os",)


def test_calls_and_members_of_scanned_languages():
    calls = lambda path, source: sorted((e.source.rsplit(".", 1)[-1], e.target) for e in parsing.parse(source, path)[2] if e.relationship == "calls")
    assert calls("a.ts", "function f(x) {\n  if (x) { g(x); }\n  console.log(h());\n  return new Thing(a.b.c(1));\n}\n") == [("f", "Thing"), ("f", "c"), ("f", "g"), ("f", "h")]
    assert calls("a.rs", "fn f() {\n    println!(\"x\");\n    let a = Some(g());\n    T::make(a.go());\n}\n") == [("f", "g"), ("f", "go"), ("f", "make")]
    assert calls("p/a.go", "package main\n\nfunc f() {\n\tg()\n\tx.H(len(y))\n}\n") == [("f", "H"), ("f", "p.main.g")]
    assert calls("a.ex", "defmodule M do\n  def f(x) do\n    if x do\n      Other.go(x)\n    end\n    run(x)\n  end\nend\n") == [("f", "go"), ("f", "run")]
    _, entities, edges = parsing.parse("package m\n\ntype S struct {\n\tBase\n\tA, B int\n}\n\ntype R interface {\n\tio.Closer\n\tRead(p []byte) int\n}\n\nfunc (s *S) Save() {}\n", "d/a.go")
    assert {("variable", "d.m.S.A"), ("variable", "d.m.S.B"), ("method", "d.m.R.Read"), ("method", "d.m.S.Save")} <= {(e.kind, e.qualified_name) for e in entities}
    assert {("d.m.S", "Base", "inherits"), ("d.m.R", "Closer", "inherits"), ("d.a", "d.m", "contains")} <= set(edges)


def test_parse_failure_is_a_row(spark):
    files = spark.createDataFrame([("a.py", "y1 = 2\0"), ("b.py", "x1 = 1"), ("c.unknown", "?")], "path string, content string")
    found = parsing.parse_files(files).select("file", "kind", "error").collect()
    assert sorted(map(tuple, found), key=str) == sorted([("a.py", "error", "SyntaxError"), ("b.py", "file", None), ("b.py", "variable", None)], key=str)


def test_greedy_batches_never_split(spark):
    rows = [("r", k, n) for k, n in enumerate([500, 12, 1, 600, 2, *[1] * 40])]
    found = ingestion.file_batches(spark.createDataFrame(rows, "repo string, rel_path int, entities int")).orderBy("rel_path").collect()
    assert [r["batch"] for r in found][:5] == [0, 0, 1, 2, 3]
    assert max(pd.Series([r["batch"] for r in found]).value_counts()) <= 32


def test_routing():
    assert "IMPACT" not in playbooks.eligible(playbooks.Request("x"))
    assert "REFERENCES" in playbooks.eligible(playbooks.Request("x", symbol_name="f"))
    assert "INVENTORY" not in playbooks.eligible(playbooks.Request("x", node_type="commit"))

    class Wrong:
        def classify(self, request):
            return playbooks.Decision("IMPACT", 1.0, {p: float(p == "IMPACT") for p in playbooks.PLAYBOOKS})

    assert playbooks.route(playbooks.Request("x"), Wrong())[1]
    assert not playbooks.route(playbooks.Request("x", file_paths=("a",)), Wrong())[1]
    with pytest.raises(ValueError):
        playbooks.Request(" ")


@pytest.mark.parametrize("playbook", playbooks.PLAYBOOKS)
def test_each_playbook_gives_evidence(spark, playbook):
    nodes = spark.createDataFrame([("f", "file", "a.py", "a.py", 0, 9, 1), ("g", "function", "go", "a.py", 1, 2, 1), ("t", "function", "test_go", "tests/t.py", 0, 3, 1)], "id string, type string, name string, file_path string, start_line long, end_line long, repo_id int")
    edges = spark.createDataFrame([("f", "g", "contains", 1.0), ("t", "g", "calls", 1.0)], EDGE)

    class Chosen:
        def classify(self, request):
            return playbooks.Decision(playbook, 0.9, {p: float(p == playbook) for p in playbooks.PLAYBOOKS})

    request = playbooks.Request("go", file_paths=("a.py",), node_ids=("g",), symbol_name="go")
    rows, decision, fallback = playbooks.run(spark, nodes, edges, request, Chosen())
    assert decision.playbook == playbook and not fallback
    assert "t" in {r["id"] for r in rows.collect()} if playbook in ("REFERENCES", "IMPACT") else rows.count() > 0


def _streamed(spark, tmp_path, df, build, name):
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = build(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"select * from {name}")


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [(r, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=7 * k), k, [None, "a", "a", "b"][(k * r) % 4]) for k in range(40) for r in (1, 2, 3)]
    looks = spark.createDataFrame(rows, "repo long, ts timestamp, id long, fingerprint string")
    found = _streamed(spark, tmp_path / "a", looks, changes.stream_changes, "streamed_changes")
    key = lambda df: sorted((r["repo"], r["id"], r["before"], r["fingerprint"]) for r in df.collect())
    assert key(found) == key(changes.changes(looks)) != []
    burst = _streamed(spark, tmp_path / "b", looks, lambda s: changes.stream_bursts(s, "10 minutes"), "streamed_bursts")
    assert burst.count() <= changes.bursts(looks, "10 minutes").count()
    hours = _streamed(spark, tmp_path / "c", looks.selectExpr("ts", "fingerprint as method", "1.0D as duration_ms", "'ok' as status"), lambda s: changes.stream_hourly(s, "1 minute"), "streamed_hours")
    assert set(hours.columns) == {"hour", "method", "calls", "duration_ms", "max_ms"}


def test_suite_is_read_strictly(spark, tmp_path):
    import json

    from graphloom.sources import snapshots

    good = {"name": "s", "cases": [{"query": "find it", "relevant": [{"qualified_name": "a.b", "relevance": 2}, {"qualified_name": "c", "file_path": "f.py", "relevance": 1}]}]}
    (tmp_path / "good.json").write_text(json.dumps(good))
    found = snapshots.suite(spark, str(tmp_path / "good.json")).collect()
    assert [(r["pos"], r["qualified_name"], r["file_path"], r["grade"]) for r in found] == [(0, "a.b", None, 2), (1, "c", "f.py", 1)]
    (tmp_path / "bad.json").write_text("{]")
    with pytest.raises(Exception):  # noqa: B017
        snapshots.suite(spark, str(tmp_path / "bad.json")).collect()


def test_paths_that_lead_out_have_no_normal_form(spark):
    from graphloom.sources.snapshots import normalized

    for path, expected in {"a/./b//../c": "a/c", "../a": None, "a/../..": None, "": ""}.items():
        assert one(spark, normalized(F.lit(path))) == expected


def test_text_fallback_keeps_the_whole_source(spark):
    from graphloom import catalog

    source = "line ä\n" * 1000
    row = ingestion.text_entities(spark.createDataFrame([("a/b.txt", source)], "rel_path string, content string")).first()
    assert (row["name"], row["qualified_name"], row["kind"], row["start_line"], row["end_line"]) == ("a/b.txt", "a/b.txt", "file", 0, 1000)
    assert row["docstring"] == row["raw_text"] == source
    assert "p16_text_fallback" in catalog.ORACLES


def test_parse_failures_over_all_parts_and_languages(spark):
    from graphloom import catalog

    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
    found = {r["language"]: (r["good"], r["failed"]) for r in catalog.QUERIES["i05_parse_failures"](spark, "/root/testdata/sf0.001").collect()}
    assert set(found) == set(parsing.LANGUAGES[k] for k in parsing.SAMPLES)
    assert sum(map(sum, found.values())) == parts
    assert found["python"][0] > found["python"][1] > 0


def test_many_queries_keep_ties_by_id_and_few_rows_a_task(spark):
    from graphloom import catalog

    # Each direction ten times: only ties, over several tasks.
    vectors = spark.createDataFrame([(f"n{i:03d}", [float(1 + i % 11), 1.0]) for i in range(110)], "node_id string, vector array<double>").repartition(5)
    queries = spark.createDataFrame([(q, [float(q + 1), 1.0]) for q in range(11)], "query_index int, query array<double>")
    near = search.by_vectors(vectors, queries, 4)
    plan = near._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "collect_list" not in plan
    found = near.collect()
    assert sorted((r["query_index"], r["rank"], r["node_id"]) for r in found) == [(q, k + 1, f"n{q + 11 * k:03d}") for q in range(11) for k in range(4)]
    sf_dir = "/root/testdata/sf0.1"
    asked = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("vec_id % 50 = 0").count()
    assert catalog.QUERIES["v02_many_vectors"](spark, sf_dir).count() == 8 * asked


def test_inputs_too_long_for_a_request_are_error_rows(spark):
    from graphloom import catalog

    sizes = [60_000, 60_000, 120_001, 1, 120_000, 500_000, 0]
    texts = spark.createDataFrame([("q", k, n) for k, n in enumerate(sizes)], "queue string, position int, characters long")
    found = sorted(ingestion.request_batches(texts).collect(), key=lambda r: r["position"])
    assert [r["characters"] for r in found] == sizes
    assert [r["batch"] for r in found] == [0, 0, None, 1, 2, None, 2]
    assert [r["error"] is None for r in found] == [r["batch"] is not None for r in found]
    sf_dir = "/root/testdata/sf0.1"
    lengths = {r[0]: len(r[1] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = catalog.QUERIES["w08_request_batches"](spark, sf_dir).collect()
    assert {r["position"]: r["characters"] for r in rows} == lengths
    assert [r["characters"] > 120_000 for r in rows] == [r["error"] is not None for r in rows]


def test_ignore_rules(spark):
    rules = discovery.ignore_rules("# c\n*.log\n!keep.log\n/build/\ndocs/**/x.txt\na?[bc].py\nfoo/\n!foo/in.py\n")
    rows = [("a.log", True), ("d/keep.log", False), ("build/x", True), ("src/build/x", False), ("docs/x.txt", True), ("docs/a/b/x.txt", True), ("a1b.py", True), ("q/a1d.py", False), ("foo/in.py", True), ("foo", False)]
    found = spark.createDataFrame(rows, "path string, expected boolean").withColumn("got", discovery.ignored(F.col("path"), rules)).collect()
    assert [r for r in found if r["got"] != r["expected"]] == []


def test_work_tree(spark, tmp_path):
    from graphloom.sources import snapshots

    (tmp_path / "a").mkdir()
    for name, text in (("a/x.py", "x"), ("a/y.log", "y"), ("z.txt", "z"), (".gitignore", "*.log\n")):
        (tmp_path / name).write_text(text)
    found = snapshots.work_tree(spark, str(tmp_path)).select("path", "size").collect()
    assert sorted(map(tuple, found)) == [(".gitignore", 6), ("a/x.py", 1), ("z.txt", 1)]


def test_answers_within_their_time(spark):
    nodes = spark.createDataFrame([(f"n{k}", "function", f"load{k}", f"f{k}.py", 1, 2, 0) for k in range(3)], "id string, type string, name string, file_path string, start_line long, end_line long, repo_id long")
    edges = spark.createDataFrame([("n0", "n1", "calls", 1.0)], EDGE)
    good = playbooks.answer(spark, nodes, edges, playbooks.Request("load", mode="thorough"))
    assert good.complete and good.rows.count() == 3
    chosen = playbooks.Choice("m", lambda request, able: {"model": "m", "choice": "INVENTORY", "confidence": 0.7, "probabilities": {p: 1 / len(able) for p in able}})
    assert playbooks.answer(spark, nodes, edges, playbooks.Request("load", mode="thorough"), chosen).decision.playbook == "INVENTORY"
    wrong = playbooks.Choice("other", lambda request, able: {"model": "m", "choice": "INVENTORY", "confidence": 0.7, "probabilities": {p: 1 / len(able) for p in able}})
    assert playbooks.answer(spark, nodes, edges, playbooks.Request("load", mode="thorough"), wrong).fallback


def test_providers(spark):
    from graphloom.plans import providers

    rows = spark.createDataFrame([(f"n{k}", f"text {k % 3} " * 5) for k in range(300)], "id string, text string")
    found = {r["node_id"]: tuple(r["vector"]) for r in providers.embedded(rows, "id", "text", lambda: providers.Hashing(16)).collect()}
    assert len(found) == 300 and len(set(found.values())) == 3 and all(len(v) == 16 for v in found.values())
    good = [{"index": 1, "embedding": [1, 2.0]}, {"index": 0, "embedding": [0, 0]}]
    assert providers.checked_embeddings(good, 2, 2) == [[0.0, 0.0], [1.0, 2.0]]
    for bad in ([good[0]], [good[0], good[0]], [{"index": 0, "embedding": [1]}, good[0]], [{"index": 0, "embedding": [float("nan"), 1]}, good[0]], [{"index": True, "embedding": [1, 1]}, good[1]]):
        with pytest.raises(ValueError):
            providers.checked_embeddings(bad, 2, 2)
    assert list(providers.requests(["a" * 50, "b" * 60, "c" * 10, "d"], 2, 100)) == [(0, 1), (1, 3), (3, 4)]
    with pytest.raises(ValueError):
        list(providers.requests(["a" * 101], 2, 100))
    assert providers.checked_ranking([{"index": 2, "score": 0.9}, {"index": 0, "score": 0.9}], 3, 2) == [(2, 0.9), (0, 0.9)]
    for bad in ([{"index": 0, "score": 1.0}], [{"index": 0, "score": 0.1}, {"index": 1, "score": 0.2}], [{"index": 0, "score": 1.0}, {"index": 0, "score": 0.5}]):
        with pytest.raises(ValueError):
            providers.checked_ranking(bad, 3, 2)


def test_a_bounded_stream_and_a_bounded_wait(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(k, "t")], "id int, topic string").write.mode("append").parquet(str(tmp_path / "in"))
    sizes = []
    stream = changes.subscribed(spark, str(tmp_path / "in"), "id int, topic string")
    query = stream.writeStream.foreachBatch(lambda df, n: sizes.append(df.count())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    while changes.waited(query, 10) == "timeout":
        pass
    assert sizes.count(1) == 3 and max(sizes) == 1
    with pytest.raises(ValueError):
        changes.waited(query, -1)
