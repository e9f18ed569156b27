"""The statistical recogniser: decoding, learning, names it was never shown."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.operators import recognise as S
from corpuslens.plans import history


@pytest.mark.parametrize("seed", range(20))
def test_viterbi_against_all_paths(seed):
    rng = np.random.default_rng(seed)
    scores, moves = rng.normal(size=(rng.integers(1, 6), 4)), rng.normal(size=(4, 4))
    moves[0, 3] = -np.inf
    value = lambda p: sum(scores[i, t] for i, t in enumerate(p)) + sum(moves[a, b] for a, b in itertools.pairwise(p))
    best = max(itertools.product(range(4), repeat=len(scores)), key=value)
    assert value(S.viterbi(scores, moves)) == pytest.approx(value(best))


def test_paths_obey_the_tags():
    tags = S.tags_of(["LOC", "PER"])
    moves, rng = S.forbidden(tags), np.random.default_rng(1)
    for _ in range(50):
        path = [tags[t] for t in S.best_tags(rng.integers(0, 64, (7, 3)), rng.normal(size=(64, 5)), moves)]
        for a, b in zip(["O", *path], path):
            assert not b.startswith("I-") or a[2:] == b[2:]


def test_averages_of_a_pass():
    """The averages equal those kept step by step."""
    rng, tags = np.random.default_rng(4), S.tags_of(["X"])
    rows = [(rng.integers(0, 20, (5, 3)), [0, 1, 2, 0, 1]) for _ in range(12)]
    w, m = np.zeros((20, 3)), S.forbidden(tags)
    got = S.one_pass(rows, w, m)
    now_w, now_m, all_w, all_m = w.copy(), m.copy(), [w.copy()], [m.copy()]
    for row in rows:
        now_w, now_m, _, _ = S.one_pass([row], now_w, now_m)
        all_w.append(now_w)
        all_m.append(now_m)
    assert np.allclose(got[0], now_w) and np.allclose(got[2], np.mean(all_w, axis=0))
    known = ~np.isinf(m)
    assert np.allclose(got[1][known], now_m[known]) and np.allclose(got[3][known], np.mean(all_m, axis=0)[known])


def test_tokens_and_gold():
    found = S.sentences("Dr. O'Neil met him. İstanbul 1914-1918!")
    assert [[w for w, _ in s] for s in found] == [["Dr", "."], ["O'Neil", "met", "him", "."], ["İstanbul", "1914-1918", "!"]]
    assert found[2][0][1] == 20
    number = {t: i for i, t in enumerate(S.tags_of(["P"]))}
    assert S.gold_tags(found[1], {4: (14, "P"), 15: (17, "P")}, number) == [1, 2, 0, 0]  # the second doesn't end with a token


SCHEMA = "doc_id long, text string"
SPANS = "doc_id long, start int, end int, label string"


def corpus(spark, n=300):
    rng, rows, spans = random.Random(7), [], []
    names = [a + b for a in ("Bor", "Kal", "Mir", "Tas", "Ven") for b in ("dan", "ela", "ona", "ur")]
    for i in range(n):
        who, where = rng.choice(names), rng.choice(names)
        text = f"In {rng.randint(1500, 1900)} General {who} left the town of {where}. Nobody {rng.choice(['knew', 'saw'])} why."
        rows.append((i, text))
        a, b = text.index("General"), text.rindex(where)
        spans += [(i, a, a + 8 + len(who), "PERSON"), (i, b, b + len(where), "LOC")]
    return spark.createDataFrame(rows, SCHEMA).repartition(4), spark.createDataFrame(spans, SPANS)


def test_learns_and_is_deterministic(spark):
    docs, spans = corpus(spark)
    model = S.fit(S.labelled(docs, spans), ["PERSON", "LOC"], rounds=3, shards=3, size=1 << 12)
    again = S.fit(S.labelled(docs.repartition(7), spans.repartition(2)), ["LOC", "PERSON"], rounds=3, shards=3, size=1 << 12)
    assert np.allclose(model.weights, again.weights)
    for r in S.evaluation(S.recognise(docs, model), spans).collect():
        assert r.f1 > 0.98
    new = spark.createDataFrame([(1, "Later General Quorvath left the town of Ostbrück.")], SCHEMA)
    assert {(r.entity, r.label) for r in S.recognise(new, model).collect()} == {("General Quorvath", "PERSON"), ("Ostbrück", "LOC")}


def test_edges(spark):
    docs, spans = corpus(spark, 20)
    nothing = S.fit(S.labelled(docs, spans.limit(0)), ["LOC"], rounds=1, size=256)
    odd = spark.createDataFrame([(1, None), (2, ""), (2, "x"), (3, "w " * 20000), (None, "General Bor")], SCHEMA)
    assert S.recognise(odd, nothing).count() == 0
    model = S.fit(S.labelled(docs, spans), ["PERSON", "LOC"], rounds=1, size=256)
    assert all(r.entity == dict([(3, "w " * 20000), (None, "General Bor"), (2, "x")])[r.doc_id][r.start : r.end] for r in S.recognise(odd, model).collect())
    assert S.evaluation(S.recognise(odd.limit(0), model), spans.limit(0)).collect() == []
    bounded = S.labelled(docs, spans, max_docs=5)
    assert bounded.count() <= 15


def test_hidden_names_are_found(spark, small):
    h, gold, kept, model = history._recogniser(spark, small)
    names = {r.entity for r in kept.select("entity").distinct().collect()}
    assert len(names) >= 3
    unseen = kept.select("doc_id").distinct()
    found = {r.label: r for r in S.evaluation(S.recognise(h.join(unseen, "doc_id", "left_semi"), model), kept.join(unseen, "doc_id", "left_semi")).collect()}
    assert found["LOC"].recall >= 0.9
    full = {r.label: r for r in S.evaluation(S.recognise(h.join(unseen, "doc_id", "left_semi"), model), gold.join(unseen, "doc_id", "left_semi")).collect()}
    print({k: (v.n_gold, round(v.f1, 4)) for k, v in full.items()})
    assert full["LOC"].f1 >= 0.9 and all(full[k].f1 >= 0.9 for k in ("DATE", "EVENT", "REGION"))
