"""Dedup of repeated byte strings by column-wise construction of a multi-document transform.

The pieces that the repeat finder hands over (stretches of text around a common anchor, no longer than two windows) are
the documents of the construction. They are laid out with their anchors in one column. Each round inserts one symbol per
document, from the last column to the first: the documents in the order of their suffixes are dealt out by the new
symbol, keeping their order, which is where the Burrows-Wheeler transform inserts it, and the common prefixes of
neighbours grow by one where the symbol is the same and are cut to the least in between. Neighbours whose common prefix
reaches the window's length have equal windows at this column. The columns lie in a temporary file, written and read one
after the other, so a round holds one column, the order and the common prefixes.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import partitions
from graphloom.llm.repeats import CONTENT, different, found_pieces, looked_up, named, piece, struct_columns, unpacked, with_spans
from graphloom.llm.symbols import BYTES, chunks, covered

WINDOW = 100
#: Bytes of an anchor.
GRAM = 32
#: Documents of a construction, if no single anchor has more.
BATCH = 50_000

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
STRETCH = "anchor long, uid long, at long, n int, lead int, body binary"


def reader(data: np.ndarray, offsets: np.ndarray):
    return BYTES[0][data], offsets, lambda: BYTES[1][data]


def stretches(window: int):
    """For mapInArrow: the bytes of the pieces to look into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, p = struct_columns(batch.column(2))
            for lo, hi, data, offsets in chunks(batch.column(1)):
                own = slice(lists[lo], lists[hi])
                row = np.repeat(np.arange(lo, hi), np.diff(lists[lo : hi + 1]))
                start = offsets[row - lo] + p["at"][own]
                raw = data.tobytes()
                body = [raw[a:b] for a, b in zip(start.tolist(), (start + p["n"][own] + window - 1).tolist(), strict=True)]
                fixed = [pa.array(p[k][own]) for k in ("at", "n", "lead")]
                yield pa.RecordBatch.from_arrays([pa.array(p["anchor"][own]), batch.column(0).take(pa.array(row)), *fixed, pa.array(body, pa.binary())], names=["anchor", "uid", "at", "n", "lead", "body"])

    return run


def columnwise(body: list[bytes], lead: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, column) of each window that an earlier document has in the same column. Documents come in order."""
    size = np.array([len(b) for b in body], dtype=np.int64)
    most = int(lead.max())
    first, last = most - lead, most - lead + size - 1  # each document's columns
    width = int(last.max()) + 1
    with tempfile.TemporaryFile() as columns:
        table = np.zeros((len(body), width), dtype=np.uint8)
        flat = np.frombuffer(b"".join(body), dtype=np.uint8)
        table[np.repeat(np.arange(len(body)), size), np.repeat(first, size) + np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
        columns.write(np.ascontiguousarray(table.T[::-1]).data)
        del table, flat
        columns.seek(0)
        entering = np.argsort(-last, kind="stable")
        ends = -last[entering]
        order, common = np.zeros(0, np.int64), np.zeros(0, np.int64)
        documents, places = [], []
        for c in range(width - 1, -1, -1):
            column = np.frombuffer(columns.read(len(body)), dtype=np.uint8)
            new = entering[np.searchsorted(ends, -c, "left") : np.searchsorted(ends, -c, "right")]
            gone = first[order] > c
            if gone.any():
                kept = np.flatnonzero(~gone)
                if len(kept):
                    cut = np.concatenate([[0], kept[:-1] + 1])
                    common = np.minimum.reduceat(common[: kept[-1] + 1], cut)
                else:
                    common = common[:0]
                order = order[kept]
            if len(new):
                common = np.concatenate([np.zeros(len(new) + (len(order) > 0), np.int64), common[1:]])
                order = np.concatenate([new, order])
            if not len(order):
                continue
            symbol = column[order]
            deal = np.argsort(symbol, kind="stable")
            counts = np.bincount(symbol, minlength=256)
            fresh = np.empty(len(order), np.int64)
            at = 0
            for k in np.flatnonzero(counts):
                own = deal[at : at + counts[k]]
                fresh[at] = 0
                if counts[k] > 1:
                    fresh[at + 1 : at + counts[k]] = np.minimum.reduceat(common[: own[-1] + 1], own[:-1] + 1) + 1
                at += counts[k]
            order, common = order[deal], fresh
            same = common >= window
            if same.any():
                heads = np.flatnonzero(~same)
                least = np.minimum.reduceat(order, heads)
                group = np.cumsum(~same) - 1
                later = order != least[group]
                documents.append(order[later])
                places.append(np.full(int(later.sum()), c - most, np.int64))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *documents]), np.concatenate([none, *places])


def construct(window: int):
    """For mapInArrow over stretches sorted by anchor: windows that also start earlier."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        uid, at, n, lead = (t.column(k).to_numpy().astype(np.int64) for k in ("uid", "at", "n", "lead"))
        order = np.lexsort((at + lead, uid))
        body = t.column("body").to_pylist()
        document, column = columnwise([body[i] for i in order], lead[order], n[order], window)
        document = order[document]
        return pa.RecordBatch.from_arrays([pa.array(uid[document]), pa.array(at[document] + lead[document] + column)], names=["uid", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            anchor = batch.column(0).to_numpy()
            if rows + len(anchor) > BATCH and len(anchor):
                # Up to the last place where the anchor changes; what has one anchor stays together.
                if rows and anchor[0] != held[-1].column(0)[-1].as_py():
                    yield flush(held)
                    held, rows = [], 0
                turn = np.flatnonzero(np.diff(anchor))
                if len(turn):
                    yield flush([*held, batch.slice(0, int(turn[-1]) + 1)])
                    held, rows, batch = [], 0, batch.slice(int(turn[-1]) + 1)
            held.append(batch)
            rows += batch.num_rows
        if rows:
            yield flush(held)

    return run


def compare(pieces: DataFrame, texts: DataFrame, window: int = WINDOW) -> DataFrame:
    found = looked_up(pieces, texts, stretches(window), STRETCH)
    dealt = found.repartition(partitions(pieces.sparkSession), "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(construct(window), "uid long, at long")


def keep_bytes(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            lists, p = struct_columns(batch.column(2))
            for lo, hi, data, offsets in chunks(batch.column(1)):
                for r in range(lo, hi):
                    own, raw = slice(lists[r], lists[r + 1]), data[offsets[r - lo] : offsets[r - lo + 1]]
                    gone = covered(np.stack([p["at"][own], p["n"][own]], axis=1), window, len(raw)) if lists[r + 1] > lists[r] else np.zeros(len(raw), bool)
                    runs = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
                    out.append((len(raw), int(gone.sum()), runs, hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def suffix_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes).

    A byte of the UTF-8 text (null: empty) goes if a string of `window` bytes that covers it also starts earlier: in a
    row of smaller doc_id (null ids are smallest; of rows that repeat an id, by the text's digest), or earlier in the
    same row. Rows equal in doc_id and text don't count as earlier than each other. Texts shorter than a window keep
    all. No rows in, no rows out; columns other than doc_id and text are ignored.
    """
    rows = named(docs)
    found = found_pieces(rows, reader, window, gram, CONTENT)
    whole, branching = different(found, CONTENT)
    again = whole.filter("times > 1").select(*piece(CONTENT), "first")
    at, n, _ = unpacked()
    later = found.join(again, piece(CONTENT)).select("uid", at, n, "first").filter(F.struct("uid", "at") != F.col("first")).drop("first")
    single = compare(branching, rows.select("uid", "text"), window).select("uid", "at", F.lit(1).alias("n"))
    return with_spans(rows, later.unionByName(single)).select("doc_id", "text", "spans").mapInArrow(keep_bytes(window), RESULT)
