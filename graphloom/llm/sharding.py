"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard has VNODES points on a ring of 2^32 places. A key belongs to the first point at or after its place. A shard
takes no more than its capacity; what an arc has over moves on clockwise, point by point, to the first shard with room.
Capacities add up to the number of rows and differ by one row at most (law "rows"), so every shard ends exactly full.

The ring is walked over counts of the arcs between points (shards * VNODES numbers, whatever the input), not over rows.
Rows then need only their rank in their arc: ranks come from windows over small cells of an arc (place on the ring,
writing task) plus running totals of the cells' counts, so that no arc or repeated key meets in one task. The rows' small
columns are written once before that: counts and ranks both read the written cells, however the input is dealt.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import partitions, stash, text_or_empty

VNODES = 64
#: Places of the ring.
RING = 1 << 32


def points(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """The ring's points in order: (place, shard). Adding a shard leaves the other shards' points where they are."""
    at = lambda s, v: int(hashlib.md5(f"{s}/{v}".encode()).hexdigest()[:8], 16)
    return sorted((at(s, v), s) for s in range(shards) for v in range(vnodes))


def place(doc_id: str = "doc_id") -> Column:
    """A key's place on the ring; null ids have the place of an empty key."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")


def walk(counts: dict[int, int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Runs (arc, first rank, rows, shard, first slot) that place all rows of the arcs within the shards' capacities.

    Round k offers what is left of every arc, in ring order, to the k-th point clockwise of its own.
    """
    n, used, runs = len(owners), [0] * len(capacity), []
    left = {arc: [0, c] for arc, c in sorted(counts.items()) if c}
    for k in range(n):
        for arc in sorted(left):
            first, rows = left[arc]
            shard = owners[(arc + k) % n]
            if take := min(rows, capacity[shard] - used[shard]):
                runs.append((arc, first, take, shard, used[shard]))
                used[shard] += take
                left[arc] = [first + take, rows - take]
                if take == rows:
                    del left[arc]
        if not left:
            break
    return runs


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def shard(docs: DataFrame, shards: int = 16, vnodes: int = VNODES) -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, law ("rows"), shard, slot, grown_shard (null), home_shard.

    size: UTF-8 bytes of the text (null: none) plus 1. home_shard: the shard that the ring alone would give. Rows that
    repeat a doc_id have one place and may part where a shard is full; a null doc_id counts as an empty key. No rows in,
    no rows out; columns other than doc_id and text are ignored. Equal texts are a group only in that they have one
    text_crc32 and size: this law places by doc_id, so copies part as their ids do, and no shard holds more than its
    share of a large group.
    """
    spark = docs.sparkSession
    ring = points(shards, vnodes)
    owners = [s for _, s in ring]
    places = [p for p, _ in ring]
    arc = F.pandas_udf(lambda at: pd.Series((np.searchsorted(places, at) % len(places)).astype("int32")), "int")
    cells = max(8, partitions(spark) // 4)
    text = text_or_empty()
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), place().alias("place"), (F.spark_partition_id() % 64).alias("task")
    ).withColumn("arc", arc("place"))
    rows = stash(rows.withColumn("cell", (F.col("place") % cells) * 64 + F.col("task")).drop("task"), "shard-rows")
    counted = rows.groupBy("arc", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    start = counted.select("arc", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    counts = {r["arc"]: r["n"] for r in rows.groupBy("arc").agg(F.count(F.lit(1)).alias("n")).collect()}  # a number for each arc
    runs = walk(counts, owners, capacities(sum(counts.values()), shards))
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy("arc", "cell").orderBy("place", "doc_id", "text_crc32")) - 1)
    ranked = ranked.join(start, ["arc", "cell"]).withColumn("rank", F.col("before") + F.col("nth"))
    # An arc is cut into few runs: their number is bounded by arcs times the points an arc's rows can visit, not by rows.
    table = spark.createDataFrame([(a, f, f + n, s, slot - f, owners[a]) for a, f, n, s, slot in runs] or [(-1, 0, 0, 0, 0, 0)], "arc int, lo long, hi long, shard int, shift long, home_shard int")
    placed = ranked.join(F.broadcast(table), (ranked["arc"] == table["arc"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") + F.col("shift")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "home_shard")

