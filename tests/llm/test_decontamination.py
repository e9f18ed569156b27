import random
import re

import pytest

from corpuslens.llm import decontamination as D


def words(x):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in x or ""))


def brute(docs, items, window=10):
    places = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            places.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in places}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in places:
                    hit.update(range(i, i + n))
                    found |= places[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def run(spark, docs, items, **how):
    d = spark.createDataFrame([(*x, "clash", 1) for x in docs], "doc_id long, text string, item_id string, place int")
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted([(r.doc_id, r.n_words, r.n_hit, list(r.item_ids)) for r in D.decontaminate(d, b, **how).collect()], key=str)


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_against_brute_force(spark, broadcast_rows):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([12, 15, 30])))) for i in range(12)] + [(50, "The É, one!"), (51, "a a a a a a a a a a a a"), (52, ""), (53, None), (54, "the é one"), (55, "x y z q r s t u v")]
    docs = []
    for i in range(60):
        text = rng.choices(vocabulary, k=rng.randrange(0, 80))
        for _ in range(rng.randrange(0, 3)):
            item = words(rng.choice(items)[1])
            cut = rng.randrange(0, max(1, len(item) - 9))
            at = rng.randrange(0, len(text) + 1)
            text[at:at] = item[cut : cut + rng.randrange(8, 20)]
        docs.append((i, " ".join(text)))
    docs += [(100, None), (101, ""), (102, "THE é-one the É one"), (103, "a " * 40), (104, "A, a; a. " * 3), (104, "A, a; a. " * 3), (104, "other"), (None, items[0][1]), (105, items[1][1].upper() + " " + "tail " * 20_000)]
    assert run(spark, docs, items, broadcast_rows=broadcast_rows) == brute(docs, items)


def test_words_whose_lower_case_depends_on_neighbours(spark):
    rng = random.Random(6)
    pick = lambda n: ["".join(rng.choices("ΑΒΓΔΕΟΣ", k=4)) for _ in range(n)]
    items = [(i, " ".join([*pick(5), "Α.Σ", *pick(5)])) for i in range(200)]
    docs = [(i, ".".join([*pick(3), *text.split(" "), *pick(3)])) for i, text in items]
    got = run(spark, docs, items)
    assert got == brute(docs, items) and all(str(doc) in found for doc, _, _, found in got)


def test_only_short_or_no_items(spark):
    docs = [(1, "one two three four"), (2, "three"), (3, "")]
    for items in ([(1, "two three"), (2, "four")], [(1, "")], []):
        assert run(spark, docs, items) == brute(docs, items)


def test_items_that_repeat_an_id_or_have_none(spark):
    items = [(5, "one two"), (5, "one two"), (6, "two"), (6, "one"), (None, "one two"), (None, "nowhere"), (7, "three four five")]
    docs = [(1, "zero one two"), (2, "two"), (3, "none"), (1, "three four five"), (1, None)]
    got = run(spark, docs, items)
    assert got == brute(docs, items)
    assert ([r for r in got if r[0] == 1 and r[1] == 3 and "5" in r[3]][0]) == (1, 3, 2, ["", "5", "6"])


def test_clean_judges_rows_that_share_an_id(spark):
    d = spark.createDataFrame([(1, "a b c"), (1, "fine"), (1, None)], "doc_id long, text string")
    b = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    assert sorted(r.text or "" for r in D.clean(d, b).collect()) == ["", "fine"]
    assert D.clean(d, b.limit(0)).count() == 3


def test_repetition_stays_linear(spark):
    import time

    docs = [(1, "again " * 50_000), (2, "again and " * 25_000)]
    items = [(1, "again " * 500), (2, "and again " * 250), (3, "again")]
    began = time.time()
    assert run(spark, docs, items) == [(1, 50_000, 50_000, ["1", "3"]), (2, 50_000, 50_000, ["2", "3"])]
    assert time.time() - began < 60


def test_clean_keeps_columns(spark):
    d = spark.createDataFrame([(1, "a b c", 5), (2, "z", 6), (None, "q", 7)], "doc_id long, text string, n_hit int")
    b = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    out = D.clean(d, b)
    assert out.columns == d.columns and sorted(r.n_hit for r in out.collect()) == [6, 7]
    assert D.clean(d.limit(0), b).count() == 0
