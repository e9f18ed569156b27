"""Learned sentence boundaries: planted abbreviations, the fixed ones, common words, and plain counts."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from corpuslens.functions import lexicons as L
from corpuslens.operators import boundaries as B

NONE = B.Boundaries([], [])


def corpus(seed=1, n=300):
    r = random.Random(seed)
    nouns = [f"word{'abcdefgh'[i]}" for i in range(8)]
    out = []
    for _ in range(n):
        s = [r.choice(["The", "Then", "A"]), r.choice(nouns), r.choice(["the", "then", "a"]), "old", "hist.", r.choice(["of", "and"]), r.choice(nouns), "saw", "Anna", "and", "Prov.", r.choice(["Anna", "Bert"]), "with", "Bert", "in", r.choice(nouns)]
        out.append(" ".join(s) + ". " + " ".join(r.choices(nouns, k=5)).capitalize() + " ended. The end.")
    return out


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")


def test_planted(spark):
    learned = B.learn(frame(spark, corpus()).repartition(3))
    # "ended." always stands before a period too, but what follows begins a sentence
    assert set(learned.abbreviations) == {"hist", "prov"}
    one = "It was the hist. of Rome. A prov. Anna saw. They met Dr. Bert, i.e. him. See hist. The end."
    row = frame(spark, [one]).select(B.sentences(F.col("text"), learned).alias("s"), B.sentences(F.col("text"), NONE).alias("plain")).first()
    assert row.s == ["It was the hist. of Rome.", "A prov. Anna saw.", "They met Dr. Bert, i.e. him.", "See hist. The end."]
    assert row.plain[0] == "It was the hist."


def test_starter_ends_after_abbreviation(spark):
    texts = corpus() + ["It was hist. Then the end came."] * 3
    learned = B.learn(frame(spark, texts))
    assert "then" in learned.starters and "anna" not in learned.starters
    got = frame(spark, ["See hist. Then go."]).select(B.sentences(F.col("text"), learned)).first()[0]
    assert got == ["See hist.", "Then go."]


def test_fixed_ones_stay(spark):
    texts = [f"we saw {a} him there. And it ended." for a in L.ABBREVIATIONS]
    got = [r[0] for r in frame(spark, texts).orderBy("doc_id").select(B.sentences(F.col("text"), NONE)).collect()]
    assert got == [[f"we saw {a} him there.", "And it ended."] for a in L.ABBREVIATIONS]


def test_scores_against_plain(spark):
    texts = corpus(n=40)
    n, dots = Counter(), Counter()
    for t in texts:
        for w in t.split():
            core = re.sub(r"^[\"'(\[]+|[,;:!?\"')\]]+$", "", w)
            kind = core.removesuffix(".").lower()
            n[kind] += 1
            dots[kind] += core.endswith(".")
    p = sum(dots.values()) / sum(n.values())
    words = B.tokens(frame(spark, texts))
    got = {r.type: r for r in B.scores(words, B.type_counts(words)).collect()}
    assert got.keys() == {k for k in n if dots[k]}
    for k, r in got.items():
        bare = n[k] - dots[k]
        ll = 2 * (dots[k] * math.log(0.99) + bare * math.log(0.01) - dots[k] * math.log(p) - bare * math.log(1 - p))
        assert abs(r.score - ll * math.exp(-len(k)) * len(k) ** -bare) <= 1e-9 * max(1.0, abs(ll))


def test_edges(spark):
    texts = [None, "", "   ", "no end", 'He said "go." Then (yes!) he went.']
    got = [r[0] for r in frame(spark, texts).orderBy("doc_id").select(B.sentences(F.col("text"), NONE)).collect()]
    assert got == [None, [], [], ["no end"], ['He said "go."', "Then (yes!)", "he went."]]
    assert B.learn(frame(spark, texts[:3])) == NONE
    only = B.learn(frame(spark, ["a. b. a."] * 9))
    assert isinstance(only.abbreviations, list)
