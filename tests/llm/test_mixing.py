import hashlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from graphloom.llm import mixing
from tests.llm.test_dedup import SF


def shares(total, weights, rooms):
    """Plain rounds: deal by weight, cap, deal the rest again."""
    out = dict.fromkeys(rooms, Fraction(0))
    open_, left = set(rooms), Fraction(min(total, sum(rooms.values())))
    while left and open_:
        w = sum(weights[k] for k in open_)
        full = {k for k in open_ if rooms[k] - out[k] <= left * weights[k] / w}
        if not full:
            for k in open_:
                out[k] += left * weights[k] / w
            break
        for k in full:
            left -= rooms[k] - out[k]
            out[k] = Fraction(rooms[k])
        open_ -= full
    return {k: int(v) for k, v in out.items()}


def budgets(supply, total, epochs):
    """Top down through the tree, by plain rounds at each node."""
    weight = lambda level, name: mixing.WEIGHTS[level].get(name, mixing.OTHER)
    given, out = {(): total}, {}
    for depth, level in enumerate(mixing.LEVELS):
        nodes = {}
        for leaf, n in supply.items():
            if n:
                nodes.setdefault(leaf[:depth], {}).setdefault(leaf[depth], 0)
                nodes[leaf[:depth]][leaf[depth]] += n * epochs
        out = {}
        for parent, rooms in nodes.items():
            for name, b in shares(given[parent], {k: weight(level, k) for k in rooms}, rooms).items():
                out[(*parent, name)] = b
        given = out
    return out


@pytest.mark.parametrize("epochs,share", [(2, (1, 1)), (1, (1, 2)), (3, (5, 2))])
def test_budgets_and_prefixes(spark, epochs, share):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.leveled(docs).select("doc_id", *[F.col(mixing.own(c)).alias(c) for c in mixing.LEVELS], mixing.tokens().alias("n")).collect()
    supply, order = {}, {}
    for r in rows:
        leaf = tuple(r[c] for c in mixing.LEVELS)
        supply[leaf] = supply.get(leaf, 0) + r["n"]
        order.setdefault(leaf, []).append((r["doc_id"], r["n"]))
    expected = budgets(supply, sum(supply.values()) * share[0] // share[1], epochs)
    taken, found = {}, {}
    for r in mixing.mixed(docs, epochs=epochs, share=share).collect():
        leaf = (r["domain"], r["lang"], r["source"])
        taken[leaf] = taken.get(leaf, 0) + r["n_tokens"] * r["copies"]
        found.setdefault(leaf, {})[r["doc_id"]] = r["copies"]
        assert 1 <= r["copies"] <= epochs
    for leaf, budget in expected.items():
        most = max(n for _, n in order[leaf])
        assert budget - most < taken.get(leaf, 0) <= budget
        # Whole epochs, and of the next one the documents that come first in its seeded order, as long as they fit.
        whole, part = divmod(budget, supply[leaf])
        placed = sorted((hashlib.md5(f"{mixing.SEED}:{whole}:{d}".encode()).hexdigest(), d, n) for d, n in order[leaf])
        prefix, used = set(), 0
        for _, d, n in placed:
            if used + n > part or not part:
                break
            used += n
            prefix.add(d)
        copies = {d: whole + (d in prefix) for d, _ in order[leaf]}
        assert {d: c for d, c in copies.items() if c} == found.get(leaf, {})


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, 1), (None, "a b", "en", None, 2), (2, "c", None, "src0", 3), (2, "c", None, "src0", 3)], "doc_id long, text string, lang string, source string, extra int")
    found = mixing.mix(docs)
    assert found.columns == [*docs.columns, "copies"]
    assert {r["doc_id"] for r in found.collect()} <= {None, 2}
    assert mixing.mix(docs.filter("false")).count() == 0


def test_long_texts_and_ties(spark):
    rows = [(1, "w " * 200_000, "en", "s"), (1, "w " * 3, "en", "s"), (1, "w " * 3, "en", "s"), *[(k, "a b", "en", "s") for k in range(2, 40)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    copies = {}
    for r in mixing.mixed(docs, epochs=1, share=(1, 2)).collect():
        copies.setdefault(r["doc_id"], []).append((r["n_tokens"], r["copies"]))
    # Rows that share an id stand or fall together; all of them are over the budget here.
    assert 1 not in copies and sum(n * c for x in copies.values() for n, c in x) <= (200_006 + 76) // 2
