import corpus_pipeline
import pytest

from graphloom.llm import mixing
from tests.llm import brute
from tests.llm.test_dedup import SF


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, SF).cache()
        out.append((docs, result))
        docs = result
    return out


def test_stages_keep_the_columns_of_documents(stages):
    for docs, result in stages[:-1]:
        assert result.dtypes == docs.dtypes


def test_stages_against_plain_versions(stages):
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    (docs, known), (_, unequal), (_, apart), (_, mixed), (_, packed) = stages
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert ids(known) == sorted(d for d, t in rows if any(c.isalpha() for c in t or ""))
    rows = [(d, t) for d, t in rows if any(c.isalpha() for c in t or "")]
    assert ids(unequal) == sorted({t: d for d, t in sorted(rows)}.values())
    rows = [(d, t) for d, t in rows if d in set(ids(unequal))]
    assert ids(apart) == sorted(d for d, r in brute.near_duplicates(rows, 5, 80).items() if r[2])
    expected = {r["doc_id"]: r["copies"] for r in mixing.mixed(apart).collect()}
    found = ids(mixed)
    assert {d: found.count(d) for d in set(found)} == expected
    pieces = packed.filter("piece = 0").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in pieces) == found


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[-1][1].count()


def odd(spark, *more):
    text = "one of several texts that are long enough to have some shingles of five words each"
    rows = [(1, text, "en", "s"), (2, text, "en", "s"), (3, None, None, None), (4, "", "de", ""), (None, text + " more", "en", None), (5, "12 34 !?", None, "s"), (6, text + " and one more", "fr", "t"), (6, "quite another text of the same id", "fr", "t"), (7, "word " * 50_000, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return docs.selectExpr("*", "length(text) as n_chars", *[f"{k} as `{name}`" for k, name in enumerate(more)])


def test_odd_rows_and_clashing_names(spark):
    docs = odd(spark, "copies", "component_id", "kept", "digest", "sequence_id", "graphloom", "whole", "bits")
    for (name, stage), few in zip(corpus_pipeline.STAGES, [6, 5, None, None, None], strict=True):
        result = stage(spark, docs, SF).cache()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert result.dtypes == docs.dtypes
            assert all(r["kept"] == 2 and r["copies"] == 0 for r in result.collect())
        if few is not None:
            assert result.count() == few
        docs = result
    assert docs.count() > 0


def test_no_rows(spark):
    docs = odd(spark).filter("false")
    for _, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, SF)
        assert result.count() == 0
        docs = result if result.columns == docs.columns else docs
