from collections import Counter


from corpuslens.operators import ml as M


def test_vocabulary_ties_and_limits(spark):
    texts = ["b a a", "a b c", "c b z", "z z", "b y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    words = M._words(df, "doc_id", "text")
    df_of = Counter(w for t in texts for w in set(t.split()))
    total = Counter(w for t in texts for w in t.split())
    want = sorted((w for w in total if 2 <= df_of[w] <= 0.7 * 5), key=lambda w: (-total[w], w))
    assert M._vocabulary(words, 5, 10, 2, 0.7) == want == ["a", "z", "c"]
    assert M._vocabulary(words, 5, 2, 2, 0.7) == want[:2]


def test_rounds_read_bounded_parts_and_nothing_is_kept_in_memory(spark, monkeypatch):
    monkeypatch.setattr(M, "ROWS", 10)
    rows = spark.range(95).coalesce(1)
    sizes = [len(p) for p in M.dealt(rows, 95).rdd.glom().collect()]
    assert len(sizes) == 10 and max(sizes) < 20
    docs = spark.createDataFrame([(i, "x y z" if i % 2 else "u v w") for i in range(40)], "doc_id long, text string")
    parts = []
    monkeypatch.setattr(M, "dealt", lambda rows, n, f=M.dealt: (parts.append(rows.dtypes), f(rows, n))[1])
    top = {}
    for r in M.nmf(docs, topics=2, words=3).collect():
        top.setdefault(r.topic, set()).add(r.word)
    assert sorted(map(sorted, top.values())) == [["u", "v", "w"], ["x", "y", "z"]]
    assert parts == [[("term", "array<int>"), ("n", "array<int>")]]  # not dense rows
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_empty(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert M.nmf(docs).count() == 0
    top, shares = M.lda(docs)
    assert top.count() == 0 and [list(r.topics) for r in shares.collect()] == [[], []]
