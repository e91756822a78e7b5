"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Grams of 1 to 3 characters of the lowered text are hashed to DIM features; their weight is (1 + log tf) * idf, scaled to
length 1. Document frequencies count all training documents. Weights are learned by follow-the-regularised-leader with
elastic-net penalties on SAMPLE documents at most, spread evenly over the languages and chosen by a hash of doc_id; a
fifth of them is kept aside to fit the temperature that calibrates the scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 1 << 14
#: Documents that weights and temperature are learned from, at most about so many.
SAMPLE = 2000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
UND = "und"
LETTER = re.compile(r"[^\W\d_]")

_MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of the whole text and how often each occurs."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
    one = c * _MIX[0]
    found = [(one ^ one >> np.uint32(15)) % np.uint32(DIM)]
    if len(c) > 1:
        two = one[:-1] + c[1:] * _MIX[1]
        found.append((two ^ two >> np.uint32(13)) % np.uint32(DIM))
    if len(c) > 2:
        three = two[:-1] + c[2:] * _MIX[2]
        found.append((three ^ three >> np.uint32(14)) % np.uint32(DIM))
    counts = np.bincount(np.concatenate(found), minlength=DIM)
    at = np.flatnonzero(counts)
    return at, counts[at]


def weighted(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[at]
    norm = np.sqrt(x @ x)
    return x / norm if norm else x


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def learn(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, seed: int = 1) -> np.ndarray:
    """Weights (DIM, classes) from (features, values, class) rows."""
    z, n = np.zeros((DIM, classes)), np.zeros((DIM, classes))

    def weights(z, n):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i]
            za, na = z[at], n[at]
            w = weights(za, na)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            more = na + g * g
            z[at] = za + g - (np.sqrt(more) - np.sqrt(na)) / ALPHA * w
            n[at] = more
    return weights(z, n)


def temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """The divisor of logits that makes the kept-aside rows most likely."""
    if not len(logits):
        return 1.0
    grid = np.geomspace(0.02, 5, 120)
    # One more row of unknown class, so that rows that are all right don't make all scores 1.
    doubt = 1 / (len(classes) + 1)

    def loss_at(t: float) -> float:
        p = np.log(np.maximum(softmax(logits / t), 1e-300))
        return -((1 - doubt) * p[np.arange(len(classes)), classes] + doubt * p.mean(axis=1)).mean()

    loss = [loss_at(t) for t in grid]
    return float(grid[int(np.argmin(loss))])


def held_out() -> Column:
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, rows = np.zeros(DIM, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            at, _ = features(text.as_py())
            total[at] += 1
            rows += 1
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], rows))], names=["feature", "n"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t.as_py()) for t in batch.column(2)]
        lists = [pa.array([f[k].astype(np.int32) for f in found], pa.list_(pa.int32())) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["lang", "aside", "at", "counts"])


def fit(docs: DataFrame, sample: int = SAMPLE):
    """(languages, weights, idf, temperature) learned from docs that aren't held out and have text and lang."""
    rows = docs.filter(~held_out()).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang is not null and length(text) > 0")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not counts:
        return [], np.zeros((DIM, 0)), np.ones(DIM), 1.0
    languages = sorted(counts)
    seen = {r["feature"]: r["n"] for r in rows.select("text").mapInArrow(_count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()}  # DIM rows
    frequency = np.zeros(DIM)
    total = seen.pop(-1)
    frequency[list(seen)] = list(seen.values())
    idf = np.log((1 + total) / (1 + frequency)) + 1
    luck = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000))
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1_000_000, 1_000_000 * sample // (len(languages) * n))).otherwise(share)
    chosen = rows.filter(luck < share).select("lang", (F.pmod(F.xxhash64(F.lit("aside"), "doc_id"), F.lit(5)) == 0).alias("aside"), "text")
    # About `sample` rows by expectation; more only if one doc_id repeats, so a limit bounds what comes to the driver.
    found = chosen.limit(2 * sample).mapInArrow(_features, "lang string, aside boolean, at array<int>, counts array<int>").collect()
    data = sorted(((r["lang"], r["aside"], np.array(r["at"]), np.array(r["counts"])) for r in found), key=lambda r: (r[0], r[2].tobytes(), r[3].tobytes()))
    known = {lang: k for k, lang in enumerate(languages)}
    vectors = [(at, weighted(at, c, idf), known[lang], aside) for lang, aside, at, c in data]
    w = learn([v[:3] for v in vectors if not v[3]] or [v[:3] for v in vectors], len(languages))
    apart = [v for v in vectors if v[3]]
    t = temperature(np.array([x @ w[at] for at, x, _, _ in apart]).reshape(len(apart), len(languages)), np.array([v[2] for v in apart], dtype=int))
    return languages, w, idf, t


def predict(model, names_out=("lang_pred", "score")):
    languages, w, idf, t = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for value in batch.column(batch.num_columns - 1):
                text = value.as_py()
                if not languages or text is None or not LETTER.search(text):
                    names.append(UND)
                    scores.append(0.0)
                    continue
                at, counts = features(text)
                p = softmax(weighted(at, counts, idf) @ w[at] / t)
                k = int(p.argmax())
                names.append(languages[k])
                scores.append(float(p[k]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], *names_out])

    return run


def language_id(docs: DataFrame, model=None, sample: int = SAMPLE) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score.

    held_out: crc32 of doc_id as text (null: empty) is divisible by 5; such rows are never learned from. lang_pred is
    `und` with score 0 if the text is null or has no letter, or nothing was there to learn from. Only text decides.
    Repeated rows get the same result. No rows in, no rows out; other columns than doc_id, text, lang are ignored.
    """
    model = model or fit(docs, sample)
    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(predict(model), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def known_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose language can be told: not those of language_id's `und`.

    Where nothing was there to learn from, all rows with a letter.
    """
    model = fit(docs)
    if not model[0]:
        lettered = F.pandas_udf(lambda texts: pd.Series([t is not None and LETTER.search(t) is not None for t in texts], dtype=bool), "boolean")
        return docs.filter(lettered(F.col("text").cast("string")))
    text = docs.withColumn("graphloom text", F.col("text").cast("string"))
    names = ("graphloom lang", "graphloom score")
    fields = ", ".join(f"`{c}` {k}" for c, k in docs.dtypes)
    told = text.mapInArrow(predict(model, names), f"{fields}, `{names[0]}` string, `{names[1]}` double")
    return told.filter(F.col(names[0]) != UND).select(*docs.columns)
