"""A pipeline over documents; each stage calls one operator of graphloom.llm.

Stages get (spark, docs, sf_dir) and return a DataFrame. run() writes each stage's result to the shared folder and reads
it again as the next one's docs. All but the last return documents with their columns.

Odd rows, by stage: a null text or one without a letter goes in the first. Null ids are documents like others: exact dedup
keeps one row of a text, with a null id only if no other has it; near-dedup links them with nothing; mixing places them
by an empty id. Rows that repeat an id are documents of their own, except that near-dedup takes them as one node and keeps
all or none of them. Rows equal in id and text are one after exact dedup. No rows in, no rows out. Other columns pass
through whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import exact_dedup, language_id, mixing, neardup, packing
from graphloom.llm.common import read, stash

#: A name beside those of any documents.
COPIES = "graphloom copies"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents whose language can't be told (no letters, no text) go."""
    return language_id.known_documents(docs)


def one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the row with the largest doc_id stays."""
    return exact_dedup.kept_documents(docs)


def one_of_near_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup on five-word shingles at 0.8: one document of each group stays."""
    return neardup.without_near_copies(docs)


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: as many tokens as there are, dealt to sources by weight; a document is there once for each of its epochs."""
    mixed = mixing.mix(docs, copies_as=COPIES)
    return mixed.withColumn(COPIES, F.explode(F.sequence(F.lit(1), F.col(COPIES)))).select(*docs.columns)


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: pieces of documents in sequences of 4096 tokens at most."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", known_language),
    ("exact dedup", one_of_equal),
    ("MinHash near-dedup", one_of_near_equal),
    ("mixing to target weights", to_target_weights),
    ("best-fit packing", into_sequences),
]

#: Packing and language ID are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
