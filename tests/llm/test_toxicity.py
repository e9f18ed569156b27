import numpy as np
from pyspark.sql import functions as F

from corpuslens.llm import toxicity as T
from corpuslens.llm.queries import op4_toxicity_chain

MIDDLE = "/root/testdata/sf0.1"


def test_unseen_documents(spark):
    docs, labels = spark.read.parquet(f"{MIDDLE}/documents.parquet"), spark.read.parquet(f"{MIDDLE}/labels.parquet")
    unseen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    chain = T.fit(docs, labels.where(~unseen), T.label_columns(labels))
    out = T.predict(docs, chain).join(labels.where(unseen).withColumnRenamed("toxic", "y"), "doc_id")
    row = out.agg(F.avg(F.when(F.col("y") == 1, F.col("toxic").cast("double"))).alias("recall"), F.avg(F.when(F.col("y") == 0, F.col("toxic").cast("double"))).alias("false")).first()
    assert row.recall >= 0.8 and row.false <= 0.01  # a tenth of the toxic rows is junk without a telling word


def test_query(spark, small):
    out = op4_toxicity_chain(spark, small)
    assert out.columns == ["doc_id", "toxic", "p_low_quality", "p_toxic", "p_toxic_low_quality"]
    assert out.count() == 200 and out.where("p_toxic < 0 or p_toxic > 1 or p_toxic is null").count() == 0


def test_later_links_use_earlier_probabilities():
    rng = np.random.default_rng(1)
    features = [np.unique(rng.integers(0, 50, 12)).astype(np.int64) for _ in range(600)]
    first = np.array([3 in f for f in features])
    labels = np.column_stack([first, first & (rng.random(600) < 0.95)])
    chain = T.train_chain(["a", "b"], features, labels, np.ones(600), np.arange(600) % T.FOLDS)
    assert chain.links[1].chain.shape == (1,) and chain.links[1].chain[0] > 0
    p = chain.predict(features)
    assert ((p[:, 0] > 0.5) == labels[:, 0]).mean() > 0.99 and ((p[:, 1] > 0.5) == labels[:, 1]).mean() > 0.95


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "you idiot idiot"), (3, "you idiot idiot"), (4, "fine words"), (None, "x"), (5, "fine " * 50_000)]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(3, 1, 1), (4, 1, 0), (5, 0, 0), (9, 0, 1), (1, None, 0)], "doc_id long, quality int, toxic int")
    out = T.predict(docs, T.fit(docs, labels, T.label_columns(labels)))
    assert out.count() == 7 and out.where("p_toxic is null or p_toxic < 0 or p_toxic > 1").count() == 0
    none = labels.limit(0)
    assert {r.p_toxic < 1e-5 for r in T.predict(docs, T.fit(docs, none, T.label_columns(none))).collect()} == {True}
    assert T.predict(docs.limit(0), T.fit(docs, labels, T.label_columns(labels))).count() == 0


def test_label_rows_that_disagree(spark):
    docs = spark.createDataFrame([(i, ("you idiot " if i % 3 == 0 else "fine words ") + f"w{i % 7}") for i in range(120)], "doc_id long, text string")
    rows = [(i, 1, int(i % 3 == 0)) for i in range(120)] + [(i, 1, 0) for i in range(0, 120, 3)] + [(3, None, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    one = [tuple(r) for r in T.predict(docs, T.fit(docs, labels, T.label_columns(labels))).orderBy("doc_id").collect()]
    two = labels.repartition(7).orderBy("toxic", F.desc("doc_id"))
    assert one == [tuple(r) for r in T.predict(docs, T.fit(docs, two, T.label_columns(two))).orderBy("doc_id").collect()]
    assert [r[1] for r in one] == [i % 3 == 0 for i in range(120)]


def test_chain_against_a_plain_one():
    """Prediction, link by link, as sums over a text's buckets."""
    rng = np.random.default_rng(4)
    features = [np.unique(rng.integers(0, 40, 9)).astype(np.int64) for _ in range(300)]
    labels = np.column_stack([[3 in f for f in features], [3 in f or 7 in f for f in features], [7 in f for f in features]])
    chain = T.train_chain(["a", "b", "c"], features, labels, np.ones(300), np.arange(300) % T.FOLDS)
    got = chain.predict(features)
    for f, row in zip(features, got, strict=True):
        odds = []
        for link in chain.links:
            weights = dict(zip(link.kept.tolist(), link.weights.tolist(), strict=True))
            z = link.intercept + sum(weights.get(int(x), 0.0) for x in f) + sum(w * o for w, o in zip(link.chain, odds, strict=True))
            odds.append(min(12.0, max(-12.0, z)))
        assert np.allclose(row, [1 / (1 + np.exp(-o)) for o in odds])


def test_training_odds_come_from_models_that_have_not_seen_the_row(monkeypatch):
    rng = np.random.default_rng(5)
    features = [np.unique(rng.integers(0, 30, 6)).astype(np.int64) for _ in range(200)]
    labels, fold, seen = rng.random((200, 2)) < 0.4, np.arange(200) % T.FOLDS, []
    train = T.train_link
    monkeypatch.setattr(T, "train_link", lambda rows, ids, y, w, earlier, **how: seen.append((len(y), earlier.copy())) or train(rows, ids, y, w, earlier, **how))
    T.train_chain(["a", "b"], features, labels, np.ones(200), fold)
    assert [n for n, _ in seen] == [200] + [160] * T.FOLDS + [200]
    later = seen[-1][1][:, 0]
    rows = np.repeat(np.arange(200), [len(f) for f in features])
    ids = np.concatenate(features)
    for f in range(T.FOLDS):
        keep = fold != f
        place = np.cumsum(keep) - 1
        own = train(place[rows[keep[rows]]], ids[keep[rows]], labels[keep, 0].astype(float), np.ones(keep.sum()), np.zeros((keep.sum(), 0)))
        for i in np.flatnonzero(fold == f)[:5]:
            weights = dict(zip(own.kept.tolist(), own.weights.tolist(), strict=True))
            assert np.isclose(later[i], np.clip(own.intercept + sum(weights.get(int(x), 0.0) for x in features[i]), -12, 12))
