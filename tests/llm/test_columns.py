"""Columns beside the needed ones, with names that operators use themselves."""

import pytest
from pyspark.sql import functions as F

from graphloom.llm import exact_dedup, fingerprints, html_extraction, language_id, mixing, neardup, packing, sharding, substring_dedup, suffix_dedup
from tests.llm.test_packing import PATH

NAMES = "uid digest salt body row rest key hot size component content sketch rep value root node place cell arc lo hi n_tokens whole cut part score lang_pred held_out spans anchor bucket target guard before task rank piece domain copies block other word bit bits keep_id group_size no_text mix_domain".split()
ROWS = [(1, "a b c d e f g h", "en", "s"), (2, "a b c d e f g h", "en", "s"), (3, None, None, None), (None, "x", "de", "t"), (3, "", "de", "")]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return plain.select("*", *[F.lit(k).alias(n) for k, n in enumerate(NAMES)])


@pytest.mark.parametrize(
    "operator",
    [exact_dedup.exact_dedup, fingerprints.document_fingerprints, language_id.language_id, neardup.near_duplicates, lambda d: packing.pack(d, PATH), lambda d: sharding.shard(d, 3), substring_dedup.substring_dedup, suffix_dedup.suffix_dedup],
)
def test_extra_columns_change_nothing(docs, operator):
    few = docs.select("doc_id", "text", "lang", "source", "n_chars")
    assert sorted(map(str, operator(docs).collect())) == sorted(map(str, operator(few).collect()))


def test_rows_keep_their_extra_columns(docs):
    for operator in (exact_dedup.kept_documents, language_id.known_documents, neardup.without_near_copies, lambda d: mixing.mix(d, copies_as="mix copies").drop("mix copies")):
        found = operator(docs)
        assert found.columns == docs.columns
        assert all(r["rank"] == NAMES.index("rank") for r in found.collect())


def test_pages_with_extra_columns(spark):
    model = html_extraction.train(60, 1)
    pages = spark.createDataFrame([(1, "u", "<p>x</p>", "t", 5)], "page_id long, url string, html string, text string, n_chars long")
    assert html_extraction.extract_text(pages, model).columns == ["page_id", "url", "text", "n_chars", "n_blocks"]
