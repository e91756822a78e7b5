"""Substring dedup by De Bruijn compaction over words.

The graph's nodes are contexts of WINDOW - 1 words, its edges the windows (k-mers) that occur again; only repeated ones are
ever rows of their own. As usual for graphs beyond one machine's memory, texts are read as runs of windows with a common
anchor (repeats.py):

1. A run that occurs again, word for word, is a path of edges that are walked together: one edge of n windows from its
   first to its last context. Runs whose anchor stands in different runs are opened into single windows, once for each
   different run, and the windows that occur again are edges of one window.
2. Joins on contexts give each edge the edges that end where it begins. Where one edge comes in and one goes out (the
   context doesn't branch) and the first sources' coordinates say that the second edge goes on where the first ends, the
   two are compacted; a path is a maximal chain of these. Its first source is one place: a document and a start.
3. All sources of a path's edges are joined with it. A source's coordinates, less the edge's place in the path, say where
   the path would begin there; if that isn't the path's first source, the span is a repeat and goes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import discard, stash
from graphloom.llm.repeats import NODES, different, found_pieces, looked_up, named, piece, struct_columns, unpacked, with_spans
from graphloom.llm.symbols import BYTES, FACTORS, Names, Ranges, chunks, covered, signed, word_names, words

WINDOW = 20
#: Words of an anchor.
GRAM = 6

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def reader(data: np.ndarray, offsets: np.ndarray):
    starts, ends, places = words(data, offsets)
    return Ranges(BYTES[0][data], FACTORS[0])(starts, ends), places, lambda: word_names(data, starts, ends)


def single_windows(window: int):
    """For mapInArrow: the windows of the runs to look into, each with its two contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, p = struct_columns(batch.column(2))
            for lo, hi, data, offsets in chunks(batch.column(1)):
                starts, ends, places = words(data, offsets)
                name = Names(word_names(data, starts, ends))
                own = slice(lists[lo], lists[hi])
                row = np.repeat(np.arange(lo, hi), np.diff(lists[lo : hi + 1]))
                n = p["n"][own].astype(np.int64)
                first = np.repeat(p["at"][own], n)
                at = first + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row = np.repeat(row, n)
                start = places[row - lo] + at
                nodes = [pa.array(signed(name(a, a + window - 1))) for a in (start, start + 1)]
                yield pa.RecordBatch.from_arrays([*nodes, batch.column(0).take(pa.array(row)), pa.array(at)], names=["source", "target", "uid", "at"])

    return run


def compacted(edges: DataFrame) -> DataFrame:
    """edges (source, target, n, single, first: uid, at) with `start`: where, in its first source, the edge's path begins."""
    # What comes into each context: how many edges, and where the only one ends.
    into = stash(edges.groupBy(F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("ins"), F.min(F.struct(F.col("first.uid").alias("uid"), (F.col("first.at") + F.col("n")).alias("at"), "single")).alias("end")), "contexts-in")
    out = stash(edges.groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("outs")), "contexts-out")
    met = edges.join(into, F.col("source") == into["node"], "left").drop("node").join(out, F.col("source") == out["node"]).drop("node")
    goes_on = (F.col("ins") == 1) & (F.col("outs") == 1) & (F.col("end") == F.struct(F.col("first.uid").alias("uid"), F.col("first.at").alias("at"), "single"))
    met = met.withColumn("begins", F.when(F.coalesce(goes_on, F.lit(False)), F.lit(None)).otherwise(F.col("first.at")))
    # A path's edges follow each other in one document: the last begin so far is theirs.
    along = Window.partitionBy("first.uid", "single").orderBy("first.at")
    return met.withColumn("start", F.last("begins", ignorenulls=True).over(along)).select(*edges.columns, "start")


def keep_words(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            lists, p = struct_columns(batch.column(2))
            for lo, hi, data, offsets in chunks(batch.column(1)):
                starts, ends, places = words(data, offsets)
                raw = data.tobytes()
                for r in range(lo, hi):
                    a, b = places[r - lo], places[r - lo + 1]
                    own = slice(lists[r], lists[r + 1])
                    gone = covered(np.stack([p["at"][own], p["n"][own]], axis=1), window, b - a) if lists[r + 1] > lists[r] else np.zeros(b - a, bool)
                    kept = b" ".join([raw[x:y] for x, y in zip(starts[a:b][~gone].tolist(), ends[a:b][~gone].tolist(), strict=True)])
                    out.append((int(b - a), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
            n, removed, digest = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space).

    Words are runs of other characters than ASCII white space; null text has none. A word goes if a window of `window`
    words that covers it also starts earlier: in a row of smaller doc_id (null ids are smallest; of rows that repeat an
    id, by the text's digest), or earlier in the same row. Rows equal in doc_id and text don't count as earlier than
    each other. Texts with fewer words than a window keep all. No rows in, no rows out; other columns are ignored.
    """
    rows = named(docs)
    found = found_pieces(rows, reader, window, gram, NODES)
    whole, branching = different(found, NODES)
    single = stash(looked_up(branching, rows.select("uid", "text"), single_windows(window), "source long, target long, uid long, at long"), "single-windows")
    discard(branching)
    ones = single.groupBy("source", "target").agg(F.min(F.struct("uid", "at")).alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    n = unpacked("shape")[1]
    runs = whole.filter("times > 1").select("anchor", "shape", "source", "target", n, "first", F.lit(False).alias("single"))
    none = F.lit(None).cast("long")
    edges = runs.unionByName(ones.select(none.alias("anchor"), none.alias("shape"), "source", "target", F.lit(1).alias("n"), "first", F.lit(True).alias("single")))
    edges = stash(edges, "edges")
    paths = stash(compacted(edges), "paths")
    discard(whole, edges)
    # Where an edge's path begins in a source of the edge, and in the path's first source.
    path = [F.col("first.uid").alias("path_uid"), F.col("start").alias("path_at"), (F.col("first.at") - F.col("start")).alias("along")]
    at, n, _ = unpacked()
    walked = found.join(paths.filter(~F.col("single")).select(*piece(NODES), *path), piece(NODES)).select("uid", at, n, "path_uid", "path_at", "along")
    alone = single.join(paths.filter("single").select("source", "target", *path), ["source", "target"]).select("uid", "at", F.lit(1).alias("n"), "path_uid", "path_at", "along")
    later = walked.unionByName(alone).filter((F.col("uid") != F.col("path_uid")) | (F.col("at") - F.col("along") != F.col("path_at"))).select("uid", "at", "n")
    return with_spans(rows, later).select("doc_id", "text", "spans").mapInArrow(keep_words(window), RESULT)
