"""Near-duplicate classes by bottom-k sketches from one hash function.

1. Each text's shingles are hashed once; the K least distinct hashes are its sketch. Texts of the same words in the same
   order (by a 128-bit digest of them) are one node; its text is one of the smallest doc_id's. A doc_id that repeats with
   different words has a node for each; ids come back in only when components are named.
2. Inverted lists of retained values give overlaps. A node is listed under its first few values only:
   - Sets of up to K shingles are their own sketch. A set that is similar enough lacks at most floor((1-t)*s) of a
     set's s values, so of two linked sets the first floor((1-t)*s) + 1 values of each (in one order of all values) share
     one. This is exact.
   - Of larger sets the first FIRST values are listed. All of them miss a linked set with a probability of at most
     (1-t)^FIRST, 7e-12 for t = 0.8.
   Values on more than LONG lists' entries are common (a shared passage, a large group of copies). They come last in the
   order, and a node whose other values suffice for the above isn't listed under them at all. Which are common is read
   from a map of bits; a value that shares the bit of a common one comes last too, which is an order of all values still.
3. Members of a list meet in one task, those of a list of more than BLOCK members in a task for each two blocks. The union
   sketch estimates their similarities; what leaves a task is a star for each component of the pairs that may be linked,
   so a list gives fewer rows than it has entries and blocks. The stars' components are clusters of candidates.
4. A cluster's texts meet in one task, those of a large one in a task for each two blocks, and the shingles themselves,
   not hashes, decide: an exact prefix filter inside the task (elements rare there come first) gives pairs, and what
   leaves it is a star for each component of the linked pairs. Their components are those of all links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import HOT_ROWS, discard, partitions, stash
from graphloom.llm.symbols import LOWER, SPACE, U, chunks, signed, windows, word_array, word_names, words

K = 64
FIRST = 16
#: Of a larger set's K values, so many may be common before it is listed under common ones too.
COMMON = 16
LONG = 40
#: Members that one task compares with as many others, and bytes of their texts.
BLOCK = 1024
BLOCK_BYTES = 4 << 20
#: A broadcast map has 2^BITS bits in 2^(BITS - 6) rows or words at most.
BITS = 24


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values in order: for short arrays much quicker than numpy's own function."""
    out = np.sort(values)
    return out[np.concatenate([[True], out[1:] != out[:-1]])] if len(out) else out


def shingle_sets(texts: pa.Array, size: int) -> Iterator[tuple[np.ndarray, bytes]]:
    """Each text's sorted distinct shingle hashes, and a digest of its words: of their bytes and lengths."""
    for lo, hi, data, offsets in chunks(texts):
        starts, ends, places = words(data, offsets)
        names = word_names(data, starts, ends, lower=True)
        every = windows(names, size)
        plain, length = LOWER[data][~SPACE[data]], (ends - starts).astype(np.uint32)
        upto = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])[places]
        for r in range(hi - lo):
            a, b = int(places[r]), int(places[r + 1])
            digest = hashlib.blake2b(plain[upto[r] : upto[r + 1]].data, digest_size=16)
            digest.update(length[a:b].data)
            if b - a >= size:
                yield distinct(every[a : b - size + 1]), digest.digest()
            else:
                yield windows(names[a:b], b - a) if b > a else np.zeros(0, U), digest.digest()


def sketch(size: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rows, same = [], [], []
            for found, digest in shingle_sets(batch.column(1), size):
                n.append(len(found))
                rows.append(signed(found[:k]))
                same.append(digest)
            long = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), long, pa.array(n, pa.int64()), pa.array(same, pa.binary()), lists], names=["doc_id", "tag", "n_bytes", "n_shingles", "content", "sketch"])

    return run


def common_values(values: DataFrame) -> np.ndarray:
    """The map of bits (64 a word) of values (value) that are in more than LONG rows: on the driver, of one size for any input."""
    often = values.groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LONG)
    place = often.select(F.col("value").bitwiseXOR(F.shiftrightunsigned("value", BITS)).bitwiseAND(F.lit((1 << BITS) - 1).cast("long")).alias("place"))
    words = place.select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place % 64 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    found = np.zeros(1 << (BITS - 6), U)
    found[words["word"].to_numpy()] = words["bits"].to_numpy().view(U)
    return found


def is_common(found: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether values have their bit in a map of common_values()."""
    place = (values ^ (values >> U(BITS))) & U((1 << BITS) - 1)
    return (found[(place >> U(6)).astype(np.int64)] >> (place & U(63))) & U(1) == 1


def listed(least: int, found: np.ndarray):
    """A pandas function: (n_shingles, sketch) to the values a set is listed under; found: the map of common values."""

    def values(n: pd.Series, sketches: pd.Series) -> pd.Series:
        out = []
        for s, own in zip(n, sketches, strict=True):
            own = np.asarray(own, dtype=np.int64).view(U)
            out.append(chosen(s, own, is_common(found, own), least).view(np.int64))
        return pd.Series(out)

    return F.pandas_udf(values, "array<long>")


def chosen(s: int, own: np.ndarray, last: np.ndarray, least: int) -> np.ndarray:
    """The values that a set of s shingles with the sketch `own` is listed under; last: which of them are common."""
    rest = own[~last]
    if s <= len(own):
        want = s * (100 - least) // 100 + 1
        enough = len(rest) >= want
    else:
        want = FIRST
        enough = last.sum() <= COMMON
    return rest[:want] if enough else np.concatenate([rest[:want], own[last][: max(want - len(rest), FIRST)]])


def inverted(reps: DataFrame, least: int) -> DataFrame:
    """node, value: the lists that each node is on."""
    found = common_values(reps.select(F.explode("sketch").alias("value")))
    return reps.select("node", F.explode(listed(least, found)("n_shingles", "sketch")).alias("value"))


def shares(a: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The union sketch's share of common values for a sketch and each of many, all of them with as many values."""
    k = len(a)
    both = np.sort(np.concatenate([np.broadcast_to(a, many.shape), many], axis=1), axis=1)
    twice = both[:, 1:] == both[:, :-1]
    place = np.cumsum(np.concatenate([np.ones((len(many), 1), bool), ~twice], axis=1), axis=1)  # of different values
    return (twice & (place[:, 1:] <= k)).sum(axis=1) / k


def close(n: int, a: np.ndarray, m: int, b: np.ndarray, k: int, least: int) -> bool:
    """Whether sets of n and m shingles with sketches a and b may be linked: exact for sets that are their own sketches;
    else by the union sketch's share of common values, with a margin of 7 deviations."""
    both = np.intersect1d(a, b, assume_unique=True)
    if n <= len(a) and m <= len(b):
        return 100 * len(both) >= least * (n + m - len(both))
    union = np.union1d(a, b)[:k]
    share = np.searchsorted(both, union[-1], side="right") / len(union)
    return share >= lowest(least, len(union))


def lowest(least: int, values) -> np.ndarray:
    t = least / 100
    return t - 7 * np.sqrt(t * (1 - t) / values)


def spanned(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of a graph on 0 ... n - 1. near(x, free): those of the free that x is linked with."""
    free, links = np.ones(n, bool), []
    for s in range(n):
        if free[s]:
            free[s], todo = False, [s]
            while todo:
                x = todo.pop()
                found = near(x, free)
                free[found] = False
                links += [(x, y) for y in found.tolist()]
                todo += found.tolist()
    return links


def flat_ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All places of some ranges, one range after the other."""
    n = hi - lo
    return np.repeat(hi - np.cumsum(n), n) + np.arange(int(n.sum()))


def likely(n: np.ndarray, flat: np.ndarray, offsets: np.ndarray, k: int, least: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of some sketches (their set sizes, values, offsets) that may be linked."""
    size = np.diff(offsets)
    own = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    whole = (size == k) & (n > k)
    of = np.repeat(np.arange(len(n)), size)
    order = np.argsort(flat, kind="stable")
    state = [flat[order], of[order], len(n)]  # postings of the free, and how many were free then

    def near(x: int, free: np.ndarray) -> np.ndarray:
        left = int(free.sum())
        if not left:
            return np.zeros(0, np.int64)
        if 2 * left < state[2]:
            state[0], state[1] = state[0][free[state[1]]], state[1][free[state[1]]]
            state[2] = left
        held, who = state[0], state[1]
        both = np.bincount(who[flat_ranges(np.searchsorted(held, own[x], "left"), np.searchsorted(held, own[x], "right"))], minlength=len(n))
        union = np.minimum(k, np.maximum(size, size[x]))  # at least so many values are in the union's sketch
        short = (n[x] <= size[x]) & (n <= size)
        enough = both >= np.where(short, least * np.maximum(n, n[x]) / 100, lowest(least, union) * union)
        found = np.flatnonzero(free & enough & (100 * np.minimum(n, n[x]) >= least * np.maximum(n, n[x])))
        if not len(found):
            return found
        good = np.zeros(len(found), bool)
        rest = np.ones(len(found), bool)
        if whole[x]:
            rest = ~whole[found]
            if not rest.all():
                good[~rest] = shares(own[x], np.stack([own[y] for y in found[~rest]])) >= lowest(least, k)
        good[rest] = [close(n[x], own[x], n[y], own[y], k, least) for y in found[rest]]
        return found[good]

    return spanned(len(n), near)


def linked(flat: np.ndarray, offsets: np.ndarray, least: int) -> list[tuple[int, int]]:
    """A spanning forest of the linked pairs of some sets (their elements as numbers, and offsets)."""
    n, size = len(offsets) - 1, np.diff(offsets)
    of = np.repeat(np.arange(n), size)
    _, code, often = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    often = np.sort(often, kind="stable")  # by rank
    element = rank[code]
    element = element[np.lexsort((element, of))]  # each set's elements, those rare here first
    first = np.arange(len(element)) - np.repeat(offsets[:-1], size) < np.repeat(size * (100 - least) // 100 + 1, size)
    first &= often[element] > 1
    held, who = element[first], of[first]
    begin = np.searchsorted(who, np.arange(n + 1))
    order = np.argsort(held, kind="stable")
    posted, posted_of = held[order], who[order]
    mark = np.zeros(len(often), np.int64)

    def near(x: int, free: np.ndarray) -> np.ndarray:
        mine = held[begin[x] : begin[x + 1]]
        found = np.unique(posted_of[flat_ranges(np.searchsorted(posted, mine, "left"), np.searchsorted(posted, mine, "right"))])
        found = found[free[found] & (100 * np.minimum(size[found], size[x]) >= least * np.maximum(size[found], size[x]))]
        if not len(found):
            return found
        own = element[offsets[x] : offsets[x + 1]]
        mark[own] = 1
        at = np.concatenate([[0], np.cumsum(size[found])[:-1]])
        both = np.add.reduceat(mark[element[flat_ranges(offsets[found], offsets[found + 1])]], at)
        mark[own] = 0
        return found[100 * both >= least * (size[found] + size[x] - both)]

    return spanned(n, near)


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles as numbers that are equal for equal shingles of these texts only, and n + 1 offsets."""
    data = np.frombuffer(texts.buffers()[2], np.uint8)
    kind = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data, offsets = LOWER[data[offsets[0] : offsets[-1]]], offsets - offsets[0]
    starts, ends, places = words(data, offsets)
    word = word_array(data, starts, ends).dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    # Texts of fewer words than a shingle are filled up with 0, which is no word.
    n = np.diff(places)
    room = np.maximum(n, size)
    begin = np.concatenate([[0], np.cumsum(room)])
    filled = np.zeros(begin[-1], np.int64)
    filled[np.repeat(begin[:-1], n) + np.arange(len(word)) - np.repeat(places[:-1], n)] = word
    base, name = int(word.max(initial=0)) + 1, filled
    for k in range(1, size):
        name = np.unique(name[: len(filled) - k] * base + filled[k:], return_inverse=True)[1]
    at = flat_ranges(begin[:-1], begin[1:] - size + 1)
    of = np.repeat(np.arange(len(n)), room - size + 1)
    top = int(name.max(initial=0)) + 1
    own = np.unique(of * top + name[at])
    return own % top, np.searchsorted(own, np.arange(len(n) + 1) * top)


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Some whole groups at a time (rows that share the first `keys` columns; they come one after the other), and n + 1 offsets."""

    def parted(held: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(held).combine_chunks()
        new = np.zeros(t.num_rows - 1, bool)
        for c in range(keys):
            v = t.column(c).to_numpy()
            new |= v[1:] != v[:-1]
        return t, np.concatenate([[0], np.flatnonzero(new) + 1, [t.num_rows]])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            t, offsets = parted([*held, batch])
            if len(offsets) > 2:
                yield t.slice(0, int(offsets[-2])), offsets[:-1]
            held = t.slice(int(offsets[-2])).to_batches()
    if held:
        yield parted(held)


def stars(links: list[tuple[int, int]]) -> pa.RecordBatch:
    """The links' components: each member with the least one."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    found = [(top(x), x) for x in list(up) if up[x] != x]
    a = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])


def meet(k: int, least: int):
    """For mapInArrow over (value, i, j, node, n_shingles, sketch): the pairs that may be linked, as stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, offsets in grouped(batches, 3):
            t = t.combine_chunks()
            node, n = (t.column(c).to_numpy().astype(np.int64) for c in ("node", "n_shingles"))
            lists = t.column("sketch").chunk(0)
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy().astype(np.int64))])
            flat = lists.flatten().to_numpy().view(U)
            found = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                if b - a == 2:
                    p, q = n[a], n[a + 1]
                    if 100 * min(p, q) >= least * max(p, q) and close(p, flat[at[a] : at[a + 1]], q, flat[at[a + 1] : at[b]], k, least):
                        found.append((node[a], node[a + 1]))
                elif b - a > 2:
                    found += [(node[a + x], node[a + y]) for x, y in likely(n[a:b], flat[at[a] : at[b]], at[a : b + 1] - at[a], k, least)]
            yield stars(found)

    return run


def decide(size: int, least: int):
    """For mapInArrow over (root, i, j, node, text): the linked pairs, as stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, offsets in grouped(batches, 3):
            node = t.column("node").to_numpy()
            texts = t.column("text").combine_chunks()
            upto = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))])[offsets]
            g = 0
            while g < len(offsets) - 1:  # some groups at a time, by their bytes
                h = max(g + 1, int(np.searchsorted(upto, upto[g] + BLOCK_BYTES, side="right")) - 1)
                lo, own = int(offsets[g]), offsets[g : h + 1] - offsets[g]
                flat, at = shingles(texts.slice(lo, int(own[-1])), size)
                found = []
                for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True):
                    if b - a > 1:
                        found += [(node[lo + a + x], node[lo + a + y]) for x, y in linked(flat[at[a] : at[b]], at[a : b + 1] - at[a], least)]
                yield stars(found)
                g = h

    return run


def together(members: DataFrame, key: str, n: Column, *columns: str) -> DataFrame:
    """Rows (key, i, j, node, columns) dealt so that any two members of a key share an (i, j); n: the key's blocks."""
    block = F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
    other = F.explode(F.when(F.col("n") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda j: j != F.col("block"))))
    dealt = members.withColumn("n", n.cast("int")).withColumn("block", block).withColumn("other", other)
    dealt = dealt.select(key, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", *columns)
    return dealt.repartition(partitions(members.sparkSession), key, "i", "j").sortWithinPartitions(key, "i", "j")


def candidates(lists: DataFrame, reps: DataFrame, k: int, least: int) -> DataFrame:
    """Pairs (a, b) of nodes whose components hold all pairs that share a list and may be linked."""
    sizes = stash(lists.groupBy("value").agg(F.count(F.lit(1)).alias("entries")).filter("entries > 1"), "shared-values")
    members = lists.join(sizes, "value").join(reps.select("node", "n_shingles", "sketch"), "node")
    dealt = together(members, "value", F.ceil(F.col("entries") / BLOCK), "n_shingles", "sketch")
    return stash(dealt.mapInArrow(meet(k, least), "a long, b long").distinct(), "candidates")


def hinted(texts: DataFrame, members: DataFrame) -> DataFrame:
    """texts without most rows that no member (doc_id, tag) has, before they are shuffled: a map of 2^BITS bits, broadcast
    in words of 64. The more members, the more rows pass; the join that follows decides."""
    place = F.pmod(F.xxhash64("doc_id", "tag"), F.lit(1 << BITS))
    word, bit = F.shiftright(place, 6), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id, tag), {1 << BITS}) % 64 as int))")
    bits = stash(members.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")), "bits-of-members")
    own = texts.withColumns({"word": word, "bit": bit})
    return own.join(F.broadcast(bits), (own["word"] == bits["word"]) & (F.col("bits").bitwiseAND(F.col("bit")) != 0), "left_semi").select(*texts.columns)


def verified(clusters: DataFrame, reps: DataFrame, texts: DataFrame, size: int, least: int) -> DataFrame:
    """Links (a, b) whose components are those of all linked pairs within the clusters (node, root)."""
    members = clusters.union(clusters.select("root", "root")).distinct().join(reps.select("node", "doc_id", "tag", "n_bytes"), "node")
    members = stash(members, "members-of-clusters")
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_bytes") / BLOCK_BYTES)).alias("blocks"))
    sizes = stash(sizes, "sizes-of-clusters")
    # Rows that share id and tag are equal; one of them is enough.
    own = hinted(texts, members).join(members.drop("n_bytes"), ["doc_id", "tag"]).dropDuplicates(["node"]).select("node", "root", F.encode("text", "UTF-8").alias("text"))
    dealt = together(stash(own, "texts-of-clusters").join(sizes, "root"), "root", F.col("blocks"), "text")
    return stash(dealt.mapInArrow(decide(size, least), "a long, b long").distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node it reaches) of links (a, b), by large-star and small-star rounds until all are stars.

    A node with very many links (the root of a large star) is a partial aggregate and one side of a join with a table,
    which Spark can split; windows are over a node's lesser neighbours only.
    """
    links = stash(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links-to-lower")
    while True:
        both = links.select(F.col("u").alias("node"), F.col("v").alias("other")).union(links.select("v", "u"))
        less = (F.col("other") < F.col("node")).cast("long")
        least = stash(both.groupBy("node").agg(F.min("other").alias("m"), F.sum(less).alias("lesser"), F.sum(1 - less).alias("greater")), "least-neighbours")
        if least.filter("lesser > 1 or lesser > 0 and greater > 0").isEmpty():
            discard(least)
            out = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out.graphloom_path = links.graphloom_path
            return out
        large = links.join(least.select(F.col("node").alias("v"), F.least("node", "m").alias("m")), "v").select("u", F.col("m").alias("v"))
        small = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        before, links = links, stash(small.distinct(), "links-to-lower")
        discard(before, least)


def tagged(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text, which tells texts that repeat a doc_id apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("tag"))


def sketched(texts: DataFrame, size: int, k: int) -> DataFrame:
    return texts.mapInArrow(sketch(size, k), "doc_id long, tag binary, n_bytes long, n_shingles long, content binary, sketch array<long>")


def tied(real: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links (a, b) between the nodes of each doc_id that repeats with different sets; nothing if none does."""
    several = stash(real.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"), "repeated-ids")
    if several.isEmpty():
        return None
    sets = real.select("doc_id", "content").join(several, "doc_id", "left_semi").distinct()
    nodes = stash(sets.join(classes.select("content", "node"), "content").select("doc_id", F.col("node").alias("b")), "nodes-of-repeated-ids")
    heads = stash(nodes.groupBy("doc_id").agg(F.min("b").alias("a")), "heads-of-repeated-ids")
    return nodes.join(heads, "doc_id").filter("a <> b").select("a", "b")


def named(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """node, component (the smallest doc_id of all nodes that have its root) of each node in roots."""
    members = stash(roots.union(roots.select("root", "root")).distinct(), "members-of-components")
    least = stash(classes.select("node", "rep").join(members, "node").groupBy("root").agg(F.min("rep").alias("component")), "names-of-components")
    return members.join(least, "root").select("node", "component")


def near_duplicates(docs: DataFrame, size: int = 5, least: int = 80, k: int = K) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept (doc_id = component_id).

    A text's set: its distinct shingles of `size` words (A-Z lowered, split at ASCII white space); with fewer words, all
    of them as one. Rows are linked if 100 * common >= least * all of two sets; component_id is the smallest doc_id
    that links reach. Texts without words (or null) are linked with nothing. Rows that repeat a doc_id count as one
    node that has each of their sets; null ids are linked with nothing and are kept. No rows in, no rows out; other
    columns are ignored.
    """
    texts = tagged(docs)
    every = stash(sketched(texts, size, k), "sketches")
    real = every.filter("n_shingles > 0 and doc_id is not null")
    row = F.struct("doc_id", "tag", "n_bytes", "n_shingles", "sketch")
    nodes = real.groupBy("content").agg(F.min(row).alias("r"), F.count(F.lit(1)).alias("size"))
    nodes = stash(nodes.select("content", "size", "r.*").withColumn("node", F.monotonically_increasing_id()), "nodes")
    classes = nodes.select("content", "size", "node", F.col("doc_id").alias("rep"))
    reps = nodes.select("node", "doc_id", "tag", "n_bytes", "n_shingles", "sketch")
    lists = stash(inverted(reps, least), "lists")
    pairs = candidates(lists, reps, k, least)
    clusters = components(pairs)
    discard(lists, pairs)
    links, ties = verified(clusters, reps, texts, size, least), tied(real, classes)
    roots = components(links.unionByName(ties) if ties else links)
    discard(clusters, links)
    # Back to the rows: classes of one that nothing links to need no look-up.
    placed = classes.join(named(classes, roots), "node", "left").withColumn("component", F.coalesce("component", "rep")).filter("size > 1 or component <> rep")
    placed = stash(placed.select("content", "size", "component"), "placed")
    hot = placed.orderBy(F.desc("size"), "content").limit(HOT_ROWS)  # all other classes have under 1/HOT_ROWS of the rows
    out = every.select("doc_id", "n_shingles", "content").join(F.broadcast(hot.select("content", F.col("component").alias("hot"))), "content", "left")
    key = F.when(F.col("hot").isNull() & F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("content")).otherwise(F.unhex(F.md5(F.concat_ws("/", F.col("doc_id").cast("string"), F.rand(5).cast("string")))))
    out = out.withColumn("key", key).join(placed.select(F.col("content").alias("key"), "component"), "key", "left")
    component = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.coalesce("hot", "component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def without_near_copies(docs: DataFrame, size: int = 5, least: int = 80) -> DataFrame:
    """The rows of docs, all columns, that near_duplicates keeps: of each component the row of its smallest doc_id.

    Of rows that repeat a kept doc_id all stay.
    """
    gone = near_duplicates(docs.select("doc_id", "text"), size, least).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
