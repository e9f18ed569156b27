"""Embeddings from co-occurrence: the matrix by hand, singular values against dense ones, planted pairs."""

import collections
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array

from corpuslens.operators import embeddings as B
from corpuslens.operators import features, ml


def dense(texts, terms, window):
    place, n = {t: i for i, t in enumerate(terms)}, np.zeros((len(terms), len(terms)))
    for text in texts:
        w = text.split()
        for i, a in enumerate(w):
            for b in w[i + 1 : i + 1 + window]:
                if a in place and b in place:
                    n[place[a], place[b]] += 1
                    n[place[b], place[a]] += 1
    with np.errstate(divide="ignore", invalid="ignore"):
        pmi = np.log(n * n.sum() / np.outer(n.sum(1), n.sum(1)))
    return np.where(n > 0, np.maximum(pmi, 0), 0)


def corpus(seed=3, n=120):
    rng = random.Random(seed)
    return [" ".join(rng.choices([f"w{k}" for k in range(50)], weights=[1 / (k + 2) for k in range(50)], k=rng.randint(5, 40))) for _ in range(n)]


def test_singular_values_against_dense(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    model = B.fit(docs, size=6, window=3, rounds=40)
    m = dense(texts, sorted(model.places), 3)
    want = np.linalg.svd(m, compute_uv=False)
    assert model.singular == pytest.approx(want[:6], rel=1e-3)
    again = B.fit(docs.repartition(2), size=6, window=3, rounds=40)
    assert np.allclose(np.abs(model.vectors), np.abs(again.vectors), atol=1e-6)


def planted(seed=5):
    """Two topics; each text of a pair has its own half of the topic's words, which only meet in other texts."""
    rng, rows, pairs = random.Random(seed), [], []
    topics = [[f"{t}{k}x" for k in range(40)] for t in "abcdef"]
    for topic in topics:
        for _ in range(60):
            rows.append(" ".join(rng.sample(topic, 14)))
    for t, topic in enumerate(topics):
        a, b = " ".join(rng.sample(topic[:20], 10)), " ".join(rng.sample(topic[20:], 10))
        pairs.append((len(rows), len(rows) + 1, t))
        rows += [a, b]
    return rows, pairs


def found(vectors, pairs):
    """Pairs whose second text is nearer to the first than all texts of other pairs."""
    right = 0
    for a, b, _ in pairs:
        others = [x for c, d, _ in pairs for x in (c, d) if c != a]
        right += np.dot(vectors[a], vectors[b]) > max(np.dot(vectors[a], vectors[x]) for x in others) + 1e-9
    return right


def test_planted_pairs_beat_hashed_weights(spark):
    rows, pairs = planted()
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string").repartition(4)
    own = {r.doc_id: np.array(r.vector) for r in B.embed(docs, B.fit(docs, size=10)).collect()}
    hashed = {r.doc_id: np.array(r.v) for r in ml.document_vectors(docs).select("doc_id", vector_to_array("vector").alias("v")).collect()}
    assert found(own, pairs) == len(pairs) > found(hashed, pairs)


def test_edges(spark):
    odd = spark.createDataFrame([(1, None), (2, ""), (2, "unknown"), (None, "war peace"), (3, "war peace war"), (4, "peace war")], "doc_id long, text string")
    model = B.fit(odd, size=5, max_df=1.0)
    got = collections.Counter((r.doc_id, len(r.vector), round(float(np.linalg.norm(r.vector)), 6)) for r in B.embed(odd, model).collect())
    assert got == collections.Counter([(1, 5, 0.0), (2, 5, 0.0), (2, 5, 0.0), (None, 5, 1.0), (3, 5, 1.0), (4, 5, 1.0)])
    nothing = B.fit(odd.limit(0), size=5)
    assert [r.vector for r in B.embed(odd.where("doc_id = 3"), nothing).collect()] == [[0.0] * 5]
    assert features.content_words(odd.limit(0)).count() == 0
