"""What the operators on repeated strings share: finding the pieces of texts that may hold a repeated window of symbols.

Successive windows with one anchor (a content-chosen run of symbols inside each window) form a piece, so equal windows lie
in pieces of one anchor, at the same place to it. Pieces whose anchor occurs once in the corpus are left: none of their
windows repeats. What tells a piece from others of its anchor and shape (number of windows, and place of the anchor) is
either one name of all its symbols (`content`), or the names of its first and its last window - 1 symbols, its `source` and
`target`: as it has fewer windows than a window has symbols, these two cover all of it.

Rows are named by a number, `uid`, in the order that decides which of two equal strings is earlier.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import discard, partitions, stash
from graphloom.llm.symbols import Names, chunks, pieces, signed

#: Turns the bytes of some texts into quick hashes of their symbols, the texts' n + 1 symbol offsets, and a function that
#: gives a 64-bit name for each symbol.
Reader = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, Callable[[], np.ndarray]]]
#: The names that pieces have, and the columns that tell them apart.
CONTENT, NODES = ("content",), ("source", "target")


def piece(names: tuple[str, ...]) -> list[str]:
    return ["anchor", *names, "shape"]


def named(docs: DataFrame) -> DataFrame:
    """uid, doc_id, text (null: empty). uid is doc_id, or its rank in (doc_id, digest) if ids repeat or are null.

    Null ids come first. Rows equal in id and text share a uid, so that neither comes before the other.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null").isEmpty():
        return rows.withColumn("uid", F.col("doc_id"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    ids = stash(rows.select("doc_id", "digest").distinct().repartitionByRange(partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first(), "digest").withColumn("part", F.spark_partition_id()), "ids")
    sizes = ids.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each partition
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "digest"))
    ranks = ids.withColumn("nth", nth).join(F.broadcast(before), "part").select(F.col("doc_id").alias("id"), F.col("digest").alias("of"), (F.col("nth") + F.col("before")).alias("uid"))
    return stash(rows.join(ranks, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of"))).select("uid", "doc_id", "text"), "named")


def packed(at: np.ndarray, n: np.ndarray, lead: np.ndarray) -> np.ndarray:
    return at << 16 | n << 8 | lead


def unpacked(place: str = "place") -> tuple[Column, Column, Column]:
    c = F.col(place)
    return F.shiftright(c, 16).alias("at"), (F.shiftright(c, 8) % 256).cast("int").alias("n"), (c % 256).cast("int").alias("lead")


def scan(reader: Reader, window: int, gram: int, names: tuple[str, ...] = ()):
    """A function for mapInArrow over (uid, text) that gives the texts' pieces with these names; without, their anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _hi, data, offsets in chunks(batch.column(1)):
                symbols, places, named_by = reader(data, offsets)
                p = pieces(symbols, places, window, gram)
                if not len(p["row"]):
                    continue
                anchor = pa.array(signed(p["anchor"]))
                if not names:
                    yield pa.RecordBatch.from_arrays([anchor], names=["anchor"])
                else:
                    name, start, end = Names(named_by()), p["start"], p["start"] + p["n"]
                    ranges = [(start, end + window - 1)] if names == CONTENT else [(start, start + window - 1), (end, end + window - 1)]
                    uid = batch.column(0).take(pa.array(p["row"] + lo))
                    yield pa.RecordBatch.from_arrays([anchor, *[pa.array(signed(name(a, b))) for a, b in ranges], uid, pa.array(packed(p["at"], p["n"], p["lead"]))], names=["anchor", *names, "uid", "place"])

    return run


def found_pieces(rows: DataFrame, reader: Reader, window: int, gram: int, names: tuple[str, ...]) -> DataFrame:
    """anchor, names, shape, uid, place of the pieces of rows (uid, text) whose anchor occurs again."""
    texts = rows.select("uid", "text")
    anchors = texts.mapInArrow(scan(reader, window, gram), "anchor long")
    often = stash(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("anchor"), "anchors")
    found = texts.mapInArrow(scan(reader, window, gram, names), ", ".join(f"{c} long" for c in ("anchor", *names, "uid", "place")))
    out = stash(found.join(often, "anchor", "left_semi"), "pieces")
    discard(often)
    return out.withColumn("shape", F.col("place") % 65536)


def different(found: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Each different piece once: anchor, names, shape, first (uid, at), times; and as (anchor, uid, at, n, lead) those whose anchor
    stands in different pieces: where shared strings begin, end or branch.

    The first occurrence is a partial aggregate, so a passage or a text that a third of all rows share is a row per map
    task. Both are tables, so that Spark can split hot keys of joins with them.
    """
    spot = F.struct("uid", F.shiftright("place", 16).alias("at"))
    whole = stash(found.groupBy(*piece(names)).agg(F.min(spot).alias("first"), F.count(F.lit(1)).alias("times")), "whole-pieces")
    kinds = stash(whole.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("anchor"), "branching-anchors")
    _, n, lead = unpacked("shape")
    branching = stash(whole.join(kinds, "anchor", "left_semi").select("anchor", F.col("first.uid").alias("uid"), F.col("first.at").alias("at"), n, lead), "branching")
    discard(kinds)
    return whole, branching


def with_spans(rows: DataFrame, repeats: DataFrame) -> DataFrame:
    """rows (uid, doc_id, text) with spans: array of (at, n), the starts of windows that also start earlier (null: none)."""
    spans = repeats.groupBy("uid").agg(F.collect_list(F.struct("at", "n")).alias("spans"))  # a document's own, no more than its symbols
    return rows.join(spans.withColumnRenamed("uid", "of"), F.col("uid") == F.col("of"), "left").select("uid", "doc_id", "text", "spans")


def looked_up(pieces_: DataFrame, texts: DataFrame, read, schema: str) -> DataFrame:
    """read (for mapInArrow) over texts with the pieces to look into: uid, text, pieces: array of (anchor, at, n, lead)."""
    wanted = pieces_.groupBy("uid").agg(F.collect_list(F.struct("anchor", "at", "n", "lead")).alias("pieces"))
    # Rows that share a uid are equal; one of them is looked into.
    return texts.join(wanted.withColumnRenamed("uid", "of"), F.col("uid") == F.col("of")).select("uid", "text", "pieces").mapInArrow(read, schema)


def struct_columns(lists: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Offsets of a list column, and the fields of its structs as arrays; a null list is empty."""
    offsets = np.concatenate([[0], np.cumsum([len(x) if x.is_valid else 0 for x in lists])]).astype(np.int64)
    flat = lists.flatten()
    names = [f.name for f in flat.type]
    return offsets, {n: flat.field(i).to_numpy(zero_copy_only=False) for i, n in enumerate(names)}
