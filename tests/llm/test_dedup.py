import os
import random

import numpy as np
import pytest

from graphloom.llm import exact_dedup, neardup, substring_dedup, suffix_dedup
from tests.llm import brute

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def by_id(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def odd_rows():
    """Short, long, empty, null, periodic and repeated texts with shared passages that start, end and branch."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, second = text(60), text(45)
    rows = [None, "", " \t\n", "a", "ä" * 99, "ä" * 50, "ab" * 400, "ab" * 400 + "c", "Ater. " * 300, "x " * 25, text(19), text(20)]
    for _ in range(12):
        rows += [text(rng.randint(0, 30)) + " " + passage + " " + text(rng.randint(0, 30)), passage[: rng.randint(100, 300)] + second[rng.randint(0, 50) :]]
    rows += [passage + " " + passage, rows[12], rows[12].upper(), rows[13], text(5000) + " " + second]
    base = text(200).split()
    for _ in range(60):
        edited = list(base)
        for _ in range(rng.randint(0, 9)):
            edited[rng.randrange(200)] = rng.choice(vocabulary)
        rows.append(" ".join(edited))
    order = rng.sample(range(len(rows)), len(rows))
    return [(7 * i - 50, rows[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("rows", ["documents", "odd", "none"])
def test_repeats(spark, documents, rows):
    docs = documents if rows == "documents" else spark.createDataFrame(odd_rows() if rows == "odd" else [], SCHEMA)
    assert by_id(substring_dedup.substring_dedup(docs)) == brute.substring_dedup(pairs(docs))
    assert by_id(suffix_dedup.suffix_dedup(docs)) == brute.suffix_dedup(pairs(docs))


def test_rows_that_share_an_id(spark):
    text = "one passage of words that is long enough to be seen as a repeat by windows of twenty words in a row or so it is " * 2
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text + "more"), (1, "other")], SCHEMA)
    found = sorted(substring_dedup.substring_dedup(docs).collect(), key=str)
    assert len(found) == 5
    assert sum(r["n_removed"] for r in found if r["doc_id"] is None) < 40
    assert all(r["n_removed"] == r["n_words"] for r in found if r["doc_id"] == 1 and r["n_words"] > 1)


@pytest.mark.parametrize("rows", ["documents", "odd", "none"])
def test_near_duplicates(spark, documents, rows):
    docs = documents if rows == "documents" else spark.createDataFrame(odd_rows() if rows == "odd" else [], SCHEMA)
    assert by_id(neardup.near_duplicates(docs, size=4)) == brute.near_duplicates(pairs(docs))


def test_a_large_group_of_near_copies_and_a_common_passage(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(100000)}"
    passage = [word() for _ in range(60)]
    base = [word() for _ in range(120)]
    rows = []
    for _ in range(150):
        edited = list(base)
        for _ in range(rng.randint(0, 8)):
            edited[rng.randrange(120)] = word()
        rows.append(" ".join(edited))
    rows += [" ".join([word() for _ in range(rng.randint(0, 40))] + passage + [word() for _ in range(rng.randint(0, 9))]) for _ in range(150)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    assert by_id(neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), size=4)) == brute.near_duplicates(rows)


def test_common_values_come_last_without_a_join(spark):
    rng = random.Random(17)
    often, seldom = [[rng.randrange(1 << 40) - (1 << 39) for _ in range(30)] for _ in range(2)]
    rows = [(n, 100, sorted(rng.sample(often, 20) + ([seldom[n]] if n < 30 else []))) for n in range(200)]
    reps = spark.createDataFrame(rows, "node long, n_shingles long, sketch array<long>")
    found = neardup.common_values(reps.selectExpr("explode(sketch) as value"))
    marked = lambda values: neardup.is_common(found, np.array(values, np.int64).view(np.uint64)).tolist()
    assert marked(often) == [True] * 30 and marked(seldom) == [False] * 30
    lists = neardup.inverted(reps, 80)
    assert "Join" not in lists._jdf.queryExecution().sparkPlan().toString()
    on = {}
    for r in lists.collect():
        on.setdefault(r["node"], []).append(r["value"])
    assert all(on[n][:1] == ([seldom[n]] if n < 30 else on[n][:1]) and len(on[n]) >= neardup.FIRST for n in range(200))


def test_linked_sets_share_a_list_whichever_values_are_common():
    rng = np.random.default_rng(19)
    found = rng.integers(0, 1 << 63, 1 << (neardup.BITS - 6), dtype=np.uint64)  # half of all values
    for _ in range(2000):
        n = int(rng.integers(1, 60))
        every = np.sort(rng.choice(1 << 20, n, replace=False)).astype(np.uint64)
        a, b = every[rng.random(n) > 0.1], every[rng.random(n) > 0.1]
        if 100 * len(np.intersect1d(a, b)) >= 80 * n and len(np.union1d(a, b)) == n:
            x, y = (neardup.chosen(len(v), v, neardup.is_common(found, v), 80) for v in (a, b))
            assert len(np.intersect1d(x, y))


def test_near_duplicates_of_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (3, "A b c d e f"), (3, "z z z z"), (9, "z z z z"), (4, None), (2, " ")], SCHEMA)
    found = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs, size=4).collect())
    assert found == [(-1, None, True), (2, 2, True), (3, 3, True), (3, 3, True), (4, 4, True), (5, 3, False), (9, 3, False)]


def test_near_copies_of_each_text_of_a_repeated_id(spark):
    rng = random.Random(11)
    long = lambda: [f"w{rng.randrange(10**6)}" for _ in range(300)]
    edited = lambda words: " ".join([*words[:150], "other", *words[151:]])
    rows, expected = [], []
    for n in range(20):
        first, second, third, low = long(), long(), long(), 10 * n
        texts = [" ".join(first), " ".join(second), " ".join(third)]
        rng.shuffle(texts)
        rows += [(low + 3, t) for t in texts] + [(low + 9, edited(first)), (low + 8, edited(second)), (low + 7, edited(third)), (low + 5, " ".join(long()))]
        # An id's other text may be that of a lower id.
        rows += [(low + 8, " ".join(first[:280])), (low + 4, edited(second[:290]))]
        expected += [(low + 3, low + 3, True)] * 3 + [(low + k, low + 3, False) for k in (4, 7, 8, 8, 9)] + [(low + 5, low + 5, True)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    found = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect())
    assert found == sorted(expected)
    assert sorted(r["doc_id"] for r in neardup.without_near_copies(docs).collect()) == sorted(d for d, _, kept in expected if kept)


def test_exact_dedup(spark, documents):
    docs = spark.createDataFrame([(4, "a"), (2, "a"), (None, "a"), (3, None), (1, ""), (7, "A"), (7, "A")], SCHEMA)
    found = sorted(((r["doc_id"] or 0), r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs).collect())
    assert found == [(0, 4, 3, False), (1, 3, 2, False), (2, 4, 3, False), (3, 3, 2, True), (4, 4, 3, True), (7, 7, 2, True), (7, 7, 2, True)]
    assert exact_dedup.exact_dedup(docs.filter("false")).count() == 0
    kept = exact_dedup.kept_documents(documents)
    assert kept.columns == documents.columns
    assert kept.count() == documents.select("text").distinct().count()
    assert sorted((r["doc_id"], r["text"]) for r in exact_dedup.kept_documents(docs).collect()) == [(3, None), (4, "a"), (7, "A")]


def thue_morse(n, one="a", two="b"):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join(two if b else one for b in bits[:n])


@pytest.mark.parametrize("size", [512, 1024, 4096])
def test_words_that_polynomials_modulo_a_power_of_two_confuse(spark, size):
    rest = [f"w{i}" for i in range(19)]
    rows = [(1, " ".join([thue_morse(size), *rest])), (2, " ".join([thue_morse(size, "b", "a"), *rest])), (3, " ".join([thue_morse(size), "x y z"])), (4, " ".join([thue_morse(size, "b", "a"), "x y z"]))]
    rows += [(5, " ".join(thue_morse(size))), (6, " ".join(thue_morse(size, "b", "a")))]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert by_id(neardup.near_duplicates(docs, size=4)) == brute.near_duplicates(rows)
    assert by_id(substring_dedup.substring_dedup(docs)) == brute.substring_dedup(rows)
    assert by_id(suffix_dedup.suffix_dedup(docs)) == brute.suffix_dedup(rows)
