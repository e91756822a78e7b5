"""Document fingerprints by locally consistent parsing.

A text's UTF-8 bytes are parsed into phrases, these into longer ones, and so on. At each level runs of one symbol become
one symbol; then deterministic coin tossing (a symbol's colour is the lowest bit in which it differs from its left
neighbour, and that bit) is repeated until there are six colours at most, with neighbours always different; a phrase
begins at each least colour among neighbours. A boundary depends on a few symbols around it only, so equal substrings
have the same phrases inside, at any offset. A phrase's name is a hash of its symbols.

The fingerprint is the KEEP least hashed names of the phrases of LEVELS; two of them are alike in the share of the least
names of both together that they have in common, an estimate of the phrase sets' Jaccard similarity.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import partitions
from graphloom.llm.symbols import Names, U, mixed

#: Levels whose phrases are kept: about 10, 30 and 100 bytes long.
LEVELS = (2, 3, 4)
KEEP = 64
#: Hexadecimal digits of a name in a fingerprint.
DIGITS = 8
#: Bytes parsed at once.
CHUNK = 1 << 18


def _toss_table(size: int) -> np.ndarray:
    a, b = np.arange(size)[:, None], np.arange(size)[None, :]
    x = a ^ b
    low = np.log2(np.maximum(x & -x, 1)).astype(np.int64)
    return (2 * low + (a >> low & 1)).astype(np.uint8).ravel()


#: New colour of a symbol for (symbol, left neighbour) among 256, 128 and 16 symbols.
TOSS = {n: _toss_table(n) for n in (256, 128, 16)}


def tossed(colour: np.ndarray, head: np.ndarray, size: int) -> np.ndarray:
    """One round for colours under `size`; a text's first symbol, without left neighbour, shows its lowest bit."""
    out = np.empty(len(colour), np.uint8)
    out[1:] = TOSS[size][colour[1:].astype(np.intp) * size + colour[:-1]]
    out[head] = colour[head] & 1
    # A head must differ from its right neighbour as any other does.
    return out


def colours(symbols: np.ndarray, head: np.ndarray) -> np.ndarray:
    if symbols.dtype == np.uint8:
        c = tossed(symbols, head, 256)
    else:
        x = symbols[1:] ^ symbols[:-1]
        x[x == 0] = U(1)  # across texts only
        bit = ((x & (~x + U(1))).astype(np.float64).view(np.int64) >> 52) - 1023
        c = np.empty(len(symbols), np.uint8)
        c[1:] = 2 * bit + (symbols[1:] >> bit.astype(U) & U(1)).astype(np.int64)
        c[head] = (symbols[head] & U(1)).astype(np.uint8)
        c = tossed(c, head, 128)
    c = tossed(c, head, 16)
    return tossed(c, head, 16)


def level_up(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of some texts' symbols, and the texts' n + 1 phrase offsets."""
    filled = offsets[:-1][np.diff(offsets) > 0]
    first = np.zeros(len(symbols), bool)
    first[filled] = True
    new = first.copy()
    new[1:] |= symbols[1:] != symbols[:-1]
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, len(symbols)))
    one = symbols[at]
    head = np.flatnonzero(first[at])
    c = colours(one, head)
    begin = np.zeros(len(at), bool)
    begin[1:-1] = (c[1:-1] < c[:-2]) & (c[1:-1] < c[2:])
    last = np.append(head[1:], len(at)) - 1
    begin[last] = False
    # A phrase of its own isn't begun next to a text's first symbol, which was coloured without a neighbour.
    begin[np.minimum(head + 1, len(at) - 1)] = False
    begin[head] = True
    start = np.flatnonzero(begin)
    values = mixed(one.astype(U) + run.astype(U) * U(0x9E3779B97F4A7C15) + U(1))
    names = Names(values)(start, np.append(start[1:], len(at)))
    return names, np.searchsorted(at[start], offsets)


def fingerprints(texts: list[bytes], levels=LEVELS, keep: int = KEEP) -> list[str]:
    """A fingerprint for each text; equal texts have equal ones, an empty text the empty one."""
    out: list[str] = []
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= CHUNK):
            size += len(texts[hi])
            hi += 1
        part = texts[lo:hi]
        symbols = np.frombuffer(b"".join(part), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in part])]).astype(np.int64)
        sets: list[list[np.ndarray]] = [[] for _ in part]
        for level in range(1, max(levels) + 1):
            if not len(symbols):
                break
            symbols, offsets = level_up(symbols, offsets)
            if level in levels:
                salted = mixed(symbols + U(level)) >> U(64 - 4 * DIGITS)
                for i in range(len(part)):
                    sets[i].append(salted[offsets[i] : offsets[i + 1]])
        for own in sets:
            names = np.unique(np.concatenate(own))[:keep] if own else ()
            out.append("".join(f"{x:0{DIGITS}x}" for x in names))
        lo = hi
    return out


def likeness(a: str, b: str, keep: int = KEEP) -> float:
    """From 0 to 1; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    x, y = ({s[i : i + DIGITS] for i in range(0, len(s), DIGITS)} for s in (a, b))
    union = sorted(x | y)[:keep]
    return sum(u in x and u in y for u in union) / len(union)


def followed(docs: DataFrame) -> DataFrame:
    """Rows (target, guard, key, doc_id, text) whose partitions, sorted, hold each row before the one that follows it.

    Ranges of doc_id go to one partition each, by their number. The first row of a range goes to the range before it as well, as a guard
    after its last row (and the very first row to the last range). One number per range comes to the driver.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cut = rows.select("key").agg(F.percentile_approx("key", [k / n for k in range(1, n)] or [0.5], 100 * n).alias("cut")).first()["cut"] or []
    places = np.unique(np.array(cut, dtype=np.int64))
    bucket = F.pandas_udf(lambda k: _series(np.searchsorted(places, k.to_numpy(), side="left")), "int")
    rows = rows.withColumn("bucket", bucket("key"))
    firsts = {r["bucket"]: r["first"] for r in rows.groupBy("bucket").agg(F.min("key").alias("first")).collect()}
    order = sorted(firsts)
    before = {firsts[b]: order[i - 1] for i, b in enumerate(order)}
    guard = F.pandas_udf(lambda k: _series(np.array([before.get(x, -1) for x in k], dtype=np.int32)), "int")
    rows = rows.withColumn("before", guard("key"))
    targets = F.expr("if(before < 0, array(struct(bucket as target, false as guard)), array(struct(bucket as target, false as guard), struct(before as target, true as guard)))")
    rows = rows.withColumn("to", F.explode(targets)).select("to.target", "to.guard", "key", "doc_id", "text")
    return rows.repartitionById(n, F.col("target")).sortWithinPartitions("target", "guard", "key", "text")


def _series(values):
    import pandas as pd

    return pd.Series(values)


def edited(text: str, following: str) -> str:
    """text with its last half of code points (rounded down) replaced by the first as many, or all, of the following."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over followed(): a result for each row that isn't a guard."""
    held: list[tuple] = []  # (target, doc_id, text) still without all that follows

    def results(rows: list[tuple]) -> pa.RecordBatch:
        """rows[i + 1] follows rows[i] if both have one target; the last row is only followed."""
        prints = fingerprints([r[2].encode() for r in rows])
        work = [(a, b, p, q) for a, b, p, q in zip(rows, rows[1:], prints, prints[1:], strict=False) if a[0] == b[0] and not a[3]]
        texts = [edited(a[2], b[2]) for a, b, _, _ in work]
        after = fingerprints([t.encode() for t in texts])
        columns = [
            pa.array([a[1] for a, *_ in work], pa.int64()),
            pa.array([len(a[2]) for a, *_ in work], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
            pa.array([p for _, _, p, _ in work], pa.string()),
            pa.array(after, pa.string()),
            pa.array([likeness(p, e) for (_, _, p, _), e in zip(work, after, strict=True)], pa.float64()),
            pa.array([likeness(p, q) for _, _, p, q in work], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    size = 0
    for batch in batches:
        for target, guard, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
            if guard and held and held[-1][3] and held[-1][0] == target:
                continue  # rows that share the first id of a range: one guard is enough
            held.append((target, doc_id, text.as_py(), guard))
            size += len(held[-1][2])
            if size > 2 * CHUNK and len(held) > 1:
                yield results(held)
                held, size = held[-1:], len(held[-1][2])
    if len(held) > 1:
        yield results(held)


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Rows follow each other by doc_id, then text; the first follows the last, and a single row itself. Null ids come
    first. Null text is empty; its fingerprint is '' and like only itself. No rows in, no rows out; other columns are
    ignored.
    """
    return followed(docs).mapInArrow(compare, RESULT)
