import hashlib
import zlib
from bisect import bisect_left, insort
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from graphloom.llm import packing, sharding
from tests.llm.test_dedup import SCHEMA, SF, odd_rows

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("rows", ["documents", "odd", "none"])
def test_pieces_and_places(spark, rows):
    odd = [*odd_rows(), (900, "It's <|endoftext|> don't 12a3!? İ ǅ é œuvre x\x1fy µ"), (901, "THE'S   ﬁ ½²"), (902, "Ä'LL àÉ_x-y 's"), (None, "a"), (903, "a"), (903, "a")]
    docs = spark.read.parquet(f"{SF}/documents.parquet") if rows == "documents" else spark.createDataFrame(odd if rows == "odd" else [], SCHEMA)
    found = packing.pack(docs, PATH).collect()
    tokenizer, expected = Tokenizer.from_file(PATH), []
    for row in docs.collect():
        ids = np.array([*tokenizer.encode(row["text"] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        expected += [(row["doc_id"], k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found), key=key) == sorted(expected, key=key)
    places = {}
    for r in found:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        assert sum(n for _, n in own) <= 4096
    total = sum(r["length"] for r in found)
    assert len(places) <= total / 4096 * 1.02 + 2


@pytest.mark.parametrize("lengths", [[4096] * 3, [1] * 9000, [2049] * 10 + [2047] * 3, [1000, 1096, 2000] * 7, []])
def test_patterns_use_every_piece_once(lengths):
    counts = np.bincount(lengths, minlength=4097) if lengths else np.zeros(4097, int)
    used = np.zeros(4097, int)
    for n, pieces in packing.patterns(counts):
        assert sum(a * b for a, b in pieces) <= 4096
        for a, b in pieces:
            used[a] += n * b
    assert (used == counts).all()


def test_exact_complements_are_found():
    counts = np.bincount([4000, 96, 3000, 1000, 96, 2000, 1000, 1000, 96], minlength=4097)
    assert sorted(sum(a * b for a, b in p) for _, p in packing.patterns(counts)) == [4096, 4096, 4096]


@pytest.mark.parametrize("shards", [16, 3, 1])
def test_bounded_loads(spark, shards):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = sharding.shard(docs, shards).collect()
    ring = sharding.points(shards)
    sizes = [0] * shards
    for r in found:
        sizes[r["shard"]] += 1
    assert len(found) == docs.count() and max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sizes[s]))
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert all(r["size"] == len(text[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) for r in found)
    at_home = sum(r["shard"] == r["home_shard"] for r in found)
    assert at_home >= 0.6 * len(found)
    assert len(ring) == shards * sharding.VNODES


def test_walk_skips_full_shards_only():
    rng = np.random.default_rng(1)
    owners = [int(x) for x in rng.integers(0, 5, 40)]
    counts = {a: int(n) for a, n in enumerate(rng.integers(0, 50, 40))}
    capacity = sharding.capacities(sum(counts.values()), 5)
    runs = sharding.walk(counts, owners, capacity)
    assert sum(r[2] for r in runs) == sum(counts.values())
    full = [0] * 5
    for _, _, n, s, slot in runs:
        assert slot == full[s]
        full[s] += n
    assert full == capacity


def test_sharding_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a"), (None, None), (1, ""), (1, ""), (2, "é")], SCHEMA)
    found = sharding.shard(docs, 2).collect()
    assert sorted(r["size"] for r in found) == [1, 1, 1, 2, 3]
    assert sharding.shard(docs.filter("false"), 2).count() == 0


def test_the_index_of_sums_knows_every_combination():
    rng = np.random.default_rng(4)
    for _ in range(40):
        counts = np.zeros(41, int)
        counts[rng.choice(np.arange(1, 41), 9, replace=False)] = rng.integers(1, 4, 9)
        sums = packing.Sums(counts)
        while sums.counts.any():
            pieces = np.repeat(np.arange(41), sums.counts).tolist()
            made = {sum(c) for n in (1, 2, 3) for c in combinations(pieces, n)}
            for gap in range(1, 41):
                found = sums.fill(gap, {})
                assert (found is not None) == (gap in made)
                if found:
                    assert sum(found) == gap and sums.free({}, *found)
            sums.counts[rng.choice(np.flatnonzero(sums.counts))] -= 1


@pytest.mark.parametrize("seed", range(6))
def test_no_more_sequences_than_plain_best_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(6, 1.2, 3000).astype(int), 1, 4096)
    gaps, plain = [], 0
    for n in sorted(lengths.tolist(), reverse=True):  # best fit, decreasing
        k = bisect_left(gaps, n)
        gap = gaps.pop(k) if k < len(gaps) else 4096
        plain += gap == 4096
        insort(gaps, gap - n)
    assert sum(n for n, _ in packing.patterns(np.bincount(lengths, minlength=4097))) <= plain


def plain_shards(ids, shards):
    """The ring walked arc by arc in rounds, each key one at a time."""
    place = lambda d: int(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[:8], 16)
    ring = sharding.points(shards)
    room = [len(ids) // shards + (s < len(ids) % shards) for s in range(shards)]
    left = {}
    for d in ids:
        left.setdefault(bisect_left([p for p, _ in ring], place(d)) % len(ring), []).append(d)
    count = dict.fromkeys(range(shards), 0)
    for k in range(len(ring)):
        for arc in sorted(left):
            owner = ring[(arc + k) % len(ring)][1]
            take = min(len(left[arc]), room[owner])
            room[owner] -= take
            count[owner] += take
            left[arc] = left[arc][take:]
    return count


@pytest.mark.parametrize("partitions", [1, 64])
def test_sharding_of_shuffled_rows(spark, partitions):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.limit(40)).unionByName(spark.createDataFrame([(None, "x"), (None, None), (7, "long " * 100_000)], SCHEMA))
    rows = docs.repartition(partitions, "text").dropDuplicates(["doc_id", "text"])
    found = sharding.shard(rows).collect()
    assert len(found) == rows.count()
    for s in range(16):
        own = sorted(r["slot"] for r in found if r["shard"] == s)
        assert own == list(range(len(own)))
    expected = plain_shards([r["doc_id"] for r in rows.collect()], 16)
    assert {s: sum(r["shard"] == s for r in found) for s in range(16)} == expected
    home = {r["doc_id"]: r["home_shard"] for r in found}
    ring = sharding.points(16)
    at = lambda d: bisect_left([p for p, _ in ring], int(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[:8], 16)) % len(ring)
    assert all(ring[at(d)][1] == s for d, s in home.items())
