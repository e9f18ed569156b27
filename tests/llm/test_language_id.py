import numpy as np
from pyspark.sql import functions as F

from corpuslens.llm import language_id as L
from corpuslens.llm.queries import op1_language_bitmask


def test_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = op1_language_bitmask(spark, small).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    row = out.agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right")).first()
    assert row.n > 40 and row.right >= 0.97


def test_filter_returns_all_languages_of_a_gram():
    h = L.grams(np.frombuffer(b" abcdef ", np.uint8), 3)
    rates = np.full(len(h), 1 / len(h))
    both = L.LanguageFilter({"a": (h, rates), "b": (h[:3], rates[:3])}, 0.1)
    counts, totals = both.hits([b" abcdef "])
    assert counts[0, 0] >= len(h) and counts[0, 1] >= 3 and totals[0] == len(h) + 4


def test_pieces_do_not_change_counts(monkeypatch):
    h = L.grams(np.frombuffer(b" abcdef ghi ", np.uint8), 3)
    made = L.LanguageFilter({"a": (h, np.full(len(h), 1 / len(h)))}, 0.1)
    texts = [b" abcdef ", b" x ", b" ghi abc ", b" a "]
    whole = made.hits(texts)
    monkeypatch.setattr(L, "PIECE", 4)
    for a, b in zip(whole, made.hits(texts), strict=True):
        assert (a == b).all()


def test_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 34 !! ½²_", None), (4, "the cat and the dog", "en"), (5, "le chat et le chien", "fr"), (5, "le chat et le chien", "fr"), (None, "x" * 200_000, "en")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    model = L.fit(docs.where("doc_id is not null"))
    out = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(docs, model).collect()}
    assert out[1] == out[2] == out[3] == ("und", 0.0)
    assert out[4][0] == "en" and out[5][0] == "fr" and all(0 <= s <= 1 for _, s in out.values())
    kept = L.known_language(docs, model)
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 5] and kept.columns == docs.columns  # x x x ... is no word of theirs
    assert sorted(str(r.doc_id) for r in L.known_language(docs, L.fit(docs.limit(0))).collect()) == ["4", "5", "5", "None"]
    assert L.known_language(docs.limit(0), model).count() == 0
    empty = docs.limit(0)
    assert L.predict(empty, L.fit(empty)).count() == 0
    assert [r.lang_pred for r in L.predict(docs, L.fit(empty)).collect()] == ["und"] * 7


def brute(model, text):
    """Scores, ratios and popcounts, n-gram by n-gram and bit by bit."""
    data = L.normalized(text)
    if data is None or not model.languages:
        return "und", 0.0
    counts, total = [0] * len(model.languages), 0
    for order in L.ORDERS:
        for i in range(len(data) - order + 1):
            value = (int.from_bytes(data[i : i + order], "big") + (order << 56)) * 0x9E3779B97F4A7C15 % (1 << 64)
            value = (value ^ value >> 29) * 0xBF58476D1CE4E5B9 % (1 << 64)
            total += 1
            for bit in range(len(counts)):
                counts[bit] += all(int(model.rows[bit // 64, value >> 44 - 20 * k & L.ROWS - 1]) >> bit % 64 & 1 for k in range(L.HASHES))
    ratios = [max(0.0, (c - total * f) / (1 - f)) / max(1, total) / cover for c, f, cover in zip(counts, model.false_rate.tolist(), model.coverage.tolist(), strict=True)]
    best = ratios.index(max(ratios))
    return model.languages[best], ratios[best] ** 4 / max(sum(r**4 for r in ratios), 1e-300)


def test_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = L.fit(docs)
    out = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(docs, model).collect()}
    for r in docs.where("length(text) < 6000").limit(60).collect():
        lang, score = brute(model, r.text)
        assert out[r.doc_id][0] == lang and abs(out[r.doc_id][1] - score) < 1e-9


def test_more_than_64_languages():
    rng = np.random.default_rng(2)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    texts = {f"l{i:03d}": b" " + bytes(rng.choice(letters, 4000)) + b" " for i in range(150)}
    made = L.LanguageFilter({k: (h := np.unique(np.concatenate([L.grams(np.frombuffer(t, np.uint8), o) for o in L.ORDERS])), np.full(len(h), 2 / len(h))) for k, t in texts.items()}, 0.1)
    assert made.rows.shape == (3, L.ROWS)
    assert made.predict([t[100:400].decode() for t in texts.values()])[0] == sorted(texts)


def test_texts_in_no_known_language_go(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    model = L.fit(docs)
    assert L.known_language(docs, model).count() == docs.count()
    rows = [(1, "Съешь же ещё этих мягких французских булок, да выпей чаю", None), (2, "これは日本語の文章です。" * 5, "ja"), (3, "xqz vbkw jjq zxv qqk wvz kxj zzq vwk jxq bqz xkv " * 4, "en"), (4, docs.first().text, None), (5, "ok", "en")]
    kept = {r.doc_id: r.lang for r in L.known_language(spark.createDataFrame(rows, docs.schema), model).collect()}
    assert kept == {4: docs.first().lang, 5: "en"}
