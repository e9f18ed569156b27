"""The learned lexicon: the graph and walks against plain versions, planted words, and held-out words of the built-in table."""

import math
import random
from collections import Counter

from corpuslens.functions import lexicons as L
from corpuslens.operators import valence as V
from corpuslens.plans import corpora as C


def plain_graph(sentences, window):
    n = Counter()
    for s in sentences:
        for i, a in enumerate(s):
            for b in s[i + 1 : i + 1 + window]:
                n[a, b] += 1
                n[b, a] += 1
    own, total = Counter(), sum(n.values())
    for (a, _), k in n.items():
        own[a] += k
    return {(a, b): math.log(k * total / (own[a] * own[b])) for (a, b), k in n.items() if a != b and k * total > own[a] * own[b]}


def plain_walk(graph, start, rounds, restart):
    out = Counter()
    for (a, _), w in graph.items():
        out[a] += w
    now = Counter(start)
    for _ in range(rounds):
        after = Counter({w: restart * x for w, x in start.items()})
        for (a, b), w in graph.items():
            after[b] += (1 - restart) * now[a] * w / out[a]
        now = after
    return now


def planted(seed=1):
    r = random.Random(seed)
    good, bad, plain = ([f"{k}{i}" for i in range(8)] for k in ("good", "bad", "mid"))
    return [r.choices(side, k=6) + r.choices(plain, k=3) for side in (good, bad) for _ in range(200)]


def test_against_plain(spark):
    texts = planted()
    docs = spark.createDataFrame([(" ".join(s) + ".",) for s in texts] + [(None,), ("",)], "text string").repartition(3)
    graph = V.word_graph(docs)
    got, want = {(r.a, r.b): r.weight for r in graph.collect()}, plain_graph(texts, 5)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    made = {r.word: r for r in V.learn(graph, {"good0": 2.0, "good1": 1.0, "bad0": -3.0, "absent": 4.0, "mid0": 0.0}, rounds=6).collect()}
    p, n = plain_walk(want, {"good0": 2 / 3, "good1": 1 / 3}, 6, 0.15), plain_walk(want, {"bad0": 1.0}, 6, 0.15)
    assert made.keys() == {w for w in p | n if p[w] + n[w] > 0}
    assert all(abs(r.valence - 4 * (p[w] - n[w]) / (p[w] + n[w])) < 1e-9 for w, r in made.items())
    assert all(r.valence > 0.5 and r.confidence == 1 for w, r in made.items() if w.startswith("good"))
    assert all(r.valence < -0.5 and r.confidence == 1 for w, r in made.items() if w.startswith("bad"))
    strength = lambda k: sum(abs(r.valence) for w, r in made.items() if w.startswith(k)) / 8
    assert strength("mid") < min(strength("good"), strength("bad")) and made["good0"].seed and not made["good5"].seed


def test_held_out_words_of_the_table(spark, small):
    graph = V.word_graph(C.history(spark, small))
    known = {r.a for r in graph.select("a").distinct().collect()} & {w for w, v in L.VALENCES.items() if v}
    right = 0
    for word in known:
        made = {r.word: r.valence for r in V.learn(graph, {w: v for w, v in L.VALENCES.items() if w != word}, resamples=0, rounds=6).collect()}
        right += made.get(word, 0.0) * L.VALENCES[word] > 0
    print("held-out signs", right, len(known))
    assert len(known) >= 6 and right >= 0.8 * len(known)


def test_nothing_to_learn_from(spark):
    empty = V.word_graph(spark.createDataFrame([], "text string"))
    assert empty.collect() == [] and V.learn(empty, rounds=1).collect() == []
    one = V.word_graph(spark.createDataFrame([("hope wins. hope wins again",), ("hope wins",)], "text string"), max_df=1.0)
    assert all(r.valence == 4 for r in V.learn(one, {"hope": 1.0}, rounds=2).collect())
