"""The encoder against numpy on small tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.operators import encoder as enc

TOPICS = ("login password account locked", "invoice payment refund card", "slow timeout latency page")


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(2)
    said = []
    for _ in range(300):
        words = [rng.choice(rng.choice(TOPICS).split()) if rng.random() < 0.2 else w for w in rng.choices(rng.choice(TOPICS).split(), k=8)]
        said.append(" ".join(words))
    said += [None, "", " ... ", "neverseen before", "Login LOGIN é ü", "login " * 20_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "id long, text string")
    return df.repartition(5).withColumn("terms", F.lit(1))


def by_numpy(texts, min_df=2):
    docs = [re.findall(r"\w{2,}", (t or "").lower()) for t in texts]
    df = Counter(w for d in docs for w in set(d))
    terms = sorted(w for w in df if df[w] >= min_df)
    idf = np.array([math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in terms])
    rows = np.array([[d.count(t) for t in terms] for d in docs], float) * idf
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return terms, rows / np.where(length > 0, length, 1)


def test_vectors_equal_numpy(texts):
    rows = texts.orderBy("id").collect()
    terms, tfidf = by_numpy([r["text"] for r in rows])
    fitted = enc.fit_encoder(texts, dimensions=4, rounds=6)
    assert list(fitted.terms) == terms
    _, singular, right = np.linalg.svd(tfidf, full_matrices=False)
    assert np.allclose(fitted.singular, singular[:4], rtol=1e-6)
    assert np.allclose(np.abs(np.sum(fitted.matrix * right[:4].T, axis=0)), 1.0, atol=1e-6)
    want = tfidf @ fitted.matrix
    length = np.linalg.norm(want, axis=1, keepdims=True)
    want = want / np.where(length > 0, length, 1)
    got = {r["id"]: r["embedding"] for r in enc.encode(texts, fitted).collect()}
    assert len(got) == len(rows)
    for r, vector in zip(rows, want):
        assert np.allclose(got[r["id"]], vector, atol=1e-6)
        assert r["text"] and any(t in r["text"].lower() for t in terms) or not any(got[r["id"]])


def test_gram_product_equals_numpy(texts, monkeypatch):
    monkeypatch.setattr(enc, "SLICE_TERMS", 5)
    _, tfidf = by_numpy([r["text"] for r in texts.orderBy("id").collect()])
    fitted = enc.fit_encoder(texts, dimensions=2, rounds=0)
    terms = texts.select(enc.text_terms("text", (), False).alias("found"))
    rows = enc.tfidf_rows(terms, fitted.terms, fitted.idf, "found")
    block = np.random.default_rng(1).standard_normal((tfidf.shape[1], 3))
    assert np.allclose(enc.gram_times(rows, block), tfidf.T @ (tfidf @ block))


def test_a_fit_can_be_repeated_saved_and_loaded(spark, texts, tmp_path):
    one, two = (enc.fit_encoder(texts, dimensions=3, bigrams=True, stop_words=("page",)) for _ in range(2))
    assert "page" not in one.terms and any(" " in t for t in one.terms)
    assert np.allclose(one.matrix, two.matrix, atol=1e-12)
    enc.save_encoder(spark, one, str(tmp_path / "encoder"))
    back = enc.load_encoder(spark, str(tmp_path / "encoder"))
    said = [[r["embedding"] for r in enc.encode(texts, e).orderBy("id").collect()] for e in (one, back)]
    assert said[0] == said[1]


def test_nothing_to_learn(spark, texts):
    empty = enc.fit_encoder(texts.limit(0))
    assert empty.terms == () and enc.encode(texts, empty).filter(F.size("embedding") > 0).count() == 0
    fitted = enc.fit_encoder(texts, dimensions=2)
    assert enc.encode(texts.limit(0), fitted).count() == 0
