"""Best-fit packing by exact-complement hashing.

Only lengths matter, and there are at most `room` of them, so the packer works on how many pieces there are of each
length. A sequence under construction has a gap; an index of the sums of one, two and three available lengths, looked up
by the gap, tells which combination fills it exactly, and the combination is consumed as often as the counts allow. Where none
does, the longest available piece that fits goes in and the smaller gap is looked up again; what can't be completed is
placed by best fit. The result is a list of runs (how many sequences have the same pieces), again no longer than the
number of lengths can make it, and independent of the number of documents.

Pieces get their sequence by rank within their length. Ranks come from windows over small cells of a length plus running
totals of the cells' counts, so one length may hold any share of all rows.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import partitions, stash

ROOM = 4096
#: Id put after each document's last token.
END = 1
#: Characters of text that are tokenized at once.
CHUNK = 2_000_000
#: Runs of characters whose ids a Python worker remembers.
MEMO = 400_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int"


class Sums:
    """An index of the sums of one, two and three available lengths.

    It is addressed by the sum itself: `two[s]` is the longest first length of a pair that makes s, `three[s]` that of a
    triple, 0 if there is none. Counts only go down, so an entry whose lengths have run out moves on to the next shorter
    first length for good.
    """

    def __init__(self, counts: np.ndarray):
        self.counts, self.room = np.array(counts, dtype=np.int64), len(counts) - 1
        self.two, self.three = np.zeros(self.room + 1, dtype=np.int64), np.zeros(self.room + 1, dtype=np.int64)
        have = np.flatnonzero(self.counts > 0)
        for a in have.tolist():  # ascending: the longest first length is written last
            b = have[(have < a) | ((have == a) & (self.counts[a] > 1))]
            self.two[a + b[a + b <= self.room]] = a
        sums = np.flatnonzero(self.two)
        for a in have.tolist():
            s = sums[(self.two[sums] <= a) & (a + sums <= self.room)]
            self.three[a + s] = a

    def free(self, used: dict[int, int], *lengths: int) -> bool:
        """Whether so many copies are there beside those that are in use."""
        return all(self.counts[x] - used.get(x, 0) >= lengths.count(x) for x in set(lengths))

    def pair(self, s: int, used: dict[int, int]) -> tuple[int, int] | None:
        a, gone = int(self.two[s]), True
        while a:
            if self.free(used, a, s - a):
                return a, s - a
            gone &= not self.free({}, a, s - a)
            first = np.arange((s + 1) // 2, a)
            both = np.flatnonzero((self.counts[first] > 0) & (self.counts[s - first] > (first == s - first)))
            a = int(first[both[-1]]) if len(both) else 0
            if gone:
                self.two[s] = a
        return None

    def triple(self, s: int, used: dict[int, int]) -> tuple[int, int, int] | None:
        a = int(self.three[s])
        if not a:
            return None
        first = np.arange(a, (s + 2) // 3 - 1, -1)
        rest = self.two[s - first]
        gone = True
        for a in first[(self.counts[first] > 0) & (rest > 0)].tolist():
            if self.free(used, a):
                found = self.pair(s - a, used | {a: used.get(a, 0) + 1})
                if found and found[0] <= a:
                    if gone:
                        self.three[s] = a
                    return a, *found
            # It is gone for good only if it is without what is in use.
            alone = self.pair(s - a, {a: 1}) if self.counts[a] > 0 else None
            gone &= not (alone and alone[0] <= a)
        if gone:
            self.three[s] = 0
        return None

    def fill(self, gap: int, used: dict[int, int]) -> tuple[int, ...] | None:
        """One, two or three available lengths that make gap exactly."""
        return (gap,) if self.free(used, gap) else self.pair(gap, used) or self.triple(gap, used)

    def fits(self, gap: int, used: dict[int, int]) -> int:
        """The longest available length up to gap, or 0."""
        for a in np.flatnonzero(self.counts[: gap + 1] > 0)[::-1].tolist():
            if self.free(used, a):
                return a
        return 0


def patterns(counts: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    """(sequences, [(length, copies in each)]) that use up counts, in which counts[l] pieces have length l."""
    sums, out = Sums(counts), []
    while longest := sums.fits(sums.room, {}):
        used, gap = {longest: 1}, sums.room - longest
        while gap:
            if more := sums.fill(gap, used):
                for a in more:
                    used[a] = used.get(a, 0) + 1
                break
            # The best fit: the longest piece that goes in, as often as there are copies and room.
            a = sums.fits(gap, used)
            if not a:
                break
            n = min(int(sums.counts[a]) - used.get(a, 0), max(1, gap // a - 3))
            used[a] = used.get(a, 0) + n
            gap -= n * a
        n = min(int(sums.counts[a]) // k for a, k in used.items())
        for a, k in used.items():
            sums.counts[a] -= n * k
        out.append((n, sorted(used.items(), reverse=True)))
    return out


def plan(counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Arrays in order of (length, first rank): length, first rank, first sequence, sequences, place of the first copy."""
    rank, rows, base = np.zeros(len(counts), dtype=np.int64), [], 0
    for n, pieces in patterns(counts):
        at = 0
        for length, copies in pieces:
            rows.append((length, rank[length], base, n, at))
            rank[length] += n * copies
            at += length * copies
        base += n
    table = np.array(sorted(rows) or [(0, 0, 0, 1, 0)], dtype=np.int64)
    return tuple(np.ascontiguousarray(table[:, k]) for k in range(5))


#: Texts of these characters are tokenized run by run: the tokenizer splits them at the ends of runs of letters, single
#: digits and runs of other signs, changes letters one by one, and finds no contraction or special token in them.
PLAIN = re.compile(r"[\t-\r -&(-~À-ÖØ-öø-ÿ]*")
RUNS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")
WORDS = re.compile(r"[^\t-\r ]+")


class Ids:
    """A text's ids as little-endian bytes. Ids of MEMO runs or words are remembered; others are found again."""

    def __init__(self, path: str):
        # One thread: all cores of an executor have tasks of their own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def runs(self, new: list[str]) -> dict[str, bytes]:
        """The ids of plain runs: tokenized as one text and parted after each id that ends a run."""
        ids = np.array(self.tokenizer.encode(" ".join(new), add_special_tokens=False).ids, dtype="<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(new):
            return self.words(new)
        raw, out, start = ids.tobytes(), {}, 0
        for run, end in zip(new, (4 * ends).tolist(), strict=True):
            out[run] = raw[start:end]
            start = end
        return out

    def words(self, new: list[str]) -> dict[str, bytes]:
        return {w: np.array(e.ids, dtype="<u4").tobytes() for w, e in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False), strict=True)}

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; what several texts need is found at once."""
        plain = [PLAIN.fullmatch(t) is not None and "<|" not in t for t in texts]
        # The tokenizer splits at white space, so that a word has the same ids wherever it stands.
        found = [RUNS.findall(t.lower()) if p else WORDS.findall(t) for t, p in zip(texts, plain, strict=True)]
        known, ids = self.known, {}
        for kind, find in ((True, self.runs), (False, self.words)):
            new = list(set().union(*[f for f, p in zip(found, plain, strict=True) if p is kind]) - known.keys() - ids.keys())
            for k in range(0, len(new), 5_000):
                ids |= find(new[k : k + 5_000])
        known.update(ids)
        out = [b"".join([known[w] for w in f]) for f in found]
        if len(known) > MEMO:
            for w in ids:
                del known[w]
        return out


def tokenize(path: str, room: int = ROOM, end: int = END):
    """A function for mapInArrow that cuts the ids of (doc_id, text) rows into pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        # A Python worker runs many tasks, one after the other; what one has found serves the next.
        ids_of = vars(sys).setdefault("graphloom_ids", {}).get(path) or vars(sys)["graphloom_ids"].setdefault(path, Ids(path))
        for batch in batches:
            out: list[tuple] = []
            doc_ids, lo = batch.column(0).to_pylist(), 0
            while lo < batch.num_rows:
                texts, size = [], 0
                while lo + len(texts) < batch.num_rows and size < CHUNK:
                    texts.append(batch.column(1)[lo + len(texts)].as_py() or "")
                    size += len(texts[-1])
                for doc_id, ids in zip(doc_ids[lo:], ids_of(texts), strict=False):
                    ids += end.to_bytes(4, "little")
                    for piece, at in enumerate(range(0, len(ids), 4 * room)):
                        part = ids[at : at + 4 * room]
                        out.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), task))
                lo += len(texts)
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task"])

    return run


def assign(table: tuple[np.ndarray, ...]):
    """A function for mapInArrow that turns each piece's rank in its length into a sequence and an offset."""
    length, first, base, many, at = table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = np.int64(1) << 46
        keys = length * span + first
        for batch in batches:
            own, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            k = np.searchsorted(keys, own * span + rank, side="right") - 1
            copy, nth = np.divmod(rank - first[k], many[k])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(base[k] + nth), pa.array(at[k] + copy * own)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, room: int = ROOM, end: int = END) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its whole text (null: empty) and then `end`; only longer ones than `room` are cut. Each
    row of docs is a document of its own, also where doc_id is null or repeats. No rows in, no rows out; columns other
    than doc_id and text are ignored.
    """
    pieces = stash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tokenize(path, room, end), PIECES), "pieces")
    counts = np.zeros(room + 1, dtype=np.int64)
    for row in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # `room` rows at most
        counts[row["length"]] = row["n"]
    cells = partitions(docs.sparkSession)
    cell = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "task"), F.lit(cells))
    rows = pieces.withColumn("cell", cell)
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    start = rows.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("n")).select("length", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = rows.withColumn("nth", nth).join(start, ["length", "cell"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(assign(plan(counts)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
