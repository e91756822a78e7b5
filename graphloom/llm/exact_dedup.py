"""Exact dedup by skew-safe combining, with DataFrame functions only.

1. Each map task combines the equal texts it holds (the partial aggregate of step 2).
2. The tasks' winners meet per (digest, salt, text): a text held by every task is merged by SALTS reducers, not one.
3. The salts' winners meet per (digest, text).

Steps 1 to 3 have the full text among their grouping keys, so content is compared, never the digest alone.
The groups' results go back to the rows by digest, which step 3 has shown to stand for one text; digests found to
stand for several texts (a SHA-256 collision) go back by digest and text instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import HOT_ROWS, stash, text_or_empty

SALTS = 16
#: A name beside those of any documents.
FLAG = "graphloom: text is null"


def combined(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """Of rows (digest, body, doc_id): digest, body, keep_id, group_size for each different body."""
    salted = rows.withColumn("salt", F.spark_partition_id() % salts)
    by_salt = salted.groupBy("digest", "salt", "body").agg(F.max("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows"))
    return by_salt.groupBy("digest", "body").agg(F.max("doc_id").alias("keep_id"), F.sum("rows").alias("group_size"))


def exact_dedup(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. The row with the largest doc_id stays. Rows that repeat a
    doc_id and a text are all marked kept if that doc_id is the largest, and all count in group_size. A null doc_id is
    smaller than any other; a group of only null ids has a null keep_id and all its rows stay. No rows in, no rows out;
    columns other than doc_id and text are ignored.
    """
    rows = docs.select("doc_id", text_or_empty().alias("body")).withColumn("digest", F.unhex(F.sha2("body", 256)))
    by_text = combined(rows, salts)
    groups = stash(
        by_text.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")).filter("group_size > 1"),
        "exact-groups",
    )
    plain = groups.filter("texts = 1").drop("texts")
    # The largest groups are HOT_ROWS at most, whatever the input; their rows are matched without a shuffle.
    hot = plain.orderBy(F.desc("group_size"), "digest").limit(HOT_ROWS)
    found = rows.select("doc_id", "digest").join(F.broadcast(hot.withColumnsRenamed({"keep_id": "hot_id", "group_size": "hot_size"})), "digest", "left")
    # A row already matched goes to the second join under a key of its own that meets nothing, so that hot keys spread.
    found = found.withColumn("key", F.when(F.col("hot_size").isNull(), F.col("digest")).otherwise(F.unhex(F.md5(F.col("doc_id").cast("string")))))
    found = found.join(plain.withColumnRenamed("digest", "key"), "key", "left")
    size = F.coalesce("hot_size", "group_size", F.lit(1).cast("long"))
    keep = F.when(F.col("hot_size").isNotNull(), F.col("hot_id")).when(F.col("group_size").isNotNull(), F.col("keep_id")).otherwise(F.col("doc_id"))
    shared = groups.filter("texts > 1").select("digest")
    if not shared.isEmpty():
        exact = by_text.join(shared, "digest", "left_semi")
        apart = rows.join(shared, "digest", "left_semi").join(exact, ["digest", "body"]).select("doc_id", "digest", "keep_id", "group_size")
        rest = found.select("doc_id", "digest", keep.alias("keep_id"), size.alias("group_size")).join(shared, "digest", "left_anti")
        found = rest.unionByName(apart)
        keep, size = F.col("keep_id"), F.col("group_size")
    return found.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup keeps, one for each text, with their columns. Of rows that repeat doc_id and text, one stays."""
    columns = docs.columns
    body = text_or_empty()
    # The winner of each text brings its row along: salted first, then all, the text compared each time.
    row = F.struct("doc_id", F.struct(*[docs[c] for c in columns if c not in ("doc_id", "text")], F.col("text").isNull().alias(FLAG)).alias("rest"))
    salted = docs.select(F.unhex(F.sha2(body, 256)).alias("digest"), (F.spark_partition_id() % SALTS).alias("salt"), body.alias("body"), row.alias("row"))
    by_salt = salted.groupBy("digest", "salt", "body").agg(F.max("row").alias("row"))
    won = by_salt.groupBy("digest", "body").agg(F.max("row").alias("row"))
    text = F.when(F.col("row.rest").getField(FLAG), F.lit(None)).otherwise(F.col("body"))
    return won.select(*[text.alias(c) if c == "text" else F.col("row.doc_id") if c == "doc_id" else F.col("row.rest").getField(c).alias(c) for c in columns])


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
