import itertools
import re

import pytest

from corpuslens.llm import filter_audit as A

DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


def plain(docs, labels):
    """Every document through every order, one step after the other."""
    good, toxic = {r[0] for r in labels if r[1] == 1}, {r[0] for r in labels if r[2] == 1}
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    fails = []
    for i, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        flags = "".join(
            k for k, x in zip("ABCDE", (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)), i is not None and first[text] < i)) if x
        )
        fails.append((source or "", flags, i in good and i is not None, i in toxic and i is not None))
    rows = {}
    for part in {f[0] for f in fails}:
        own, shapley = [f for f in fails if f[0] == part], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            alive = own
            for step, k in enumerate(order, 1):
                out, alive = [f for f in alive if k in f[1]], [f for f in alive if k not in f[1]]
                shapley[k] += len(out)
                rows[part, "".join(order), step] = [len(alive), len(out), sum(k in f[1] for f in own) - len(out), sum(f[1] == k for f in own), sum(f[2] for f in out), sum(f[3] for f in out)]
        for (p, order, step), row in rows.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in rows.items()}


def got(spark, docs, labels, **how):
    rows = A.audit(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS), **how).collect()
    assert len({tuple(r[:3]) for r in rows}) == len(rows)
    return {tuple(r[:3]): tuple(r[3:]) for r in rows}


def test_against_every_order(spark):
    long = " ".join(f"w{k}" for k in range(60))
    texts = [long, long, "short", "same " * 80, "LOUD " + long, "LOUD WORDS " * 40, long + " $", None, "", "\t \n", "short", "é" * 5, long + " | A", " ".join(["A", *["b"] * 49])]
    docs = [(k, texts[k % len(texts)], ("a", "b", None, "")[k % 4]) for k in range(56)]
    docs += [(None, long, "a"), (None, "new text", "b"), (3, "same " * 80, "a"), (3, "short", "zz"), (3, "same " * 80, "a")]
    labels = [(k, k % 2, int(k % 3 == 0)) for k in range(0, 50, 2)] + [(4, 1, None), (4, None, 1), (None, 1, 1), (999, 1, 1)]
    assert got(spark, docs, labels) == plain(docs, labels)


def test_smallest_of_copies_in_another_part(spark):
    docs = [(5, "copy", "a"), (2, "copy", "b"), (9, "copy", "a"), (2, "copy", "b")]
    rows = got(spark, docs, [])
    assert rows == plain(docs, [])
    assert rows["a", "EABCD", 1][1] == 2 and rows["b", "EABCD", 1][1] == 0


def test_empty_tables_and_clashing_columns(spark):
    assert got(spark, [], []) == {}
    docs = spark.createDataFrame([(1, "x", "a", 7, "p", True)], DOCS + ", n int, part string, A boolean")
    rows = A.audit(docs, spark.createDataFrame([], LABELS)).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {"a"}


def test_subsets_are_the_cubes_rows(spark):
    counts = spark.createDataFrame([("a", True, False, False, False, False, 3, 1, 0), ("a", False, False, False, False, True, 2, 0, 2)], "part string, A boolean, B boolean, C boolean, D boolean, E boolean, n long, good long, toxic long")
    alive = {r.subset: (r.kept, r.good, r.toxic) for r in A.survivors(counts).collect()}
    assert alive[0] == (5, 1, 2) and alive[1] == (2, 0, 2) and alive[16] == (3, 1, 0)
    assert 17 not in alive and len(alive) == 24  # nothing survives both
    steps = {(r.subset, r.added): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in A.pairs(counts).collect()}
    assert len(steps) == 80 and steps[1, 4] == (0, 2, 0, 2, 240) and steps[17, 1] == (0, 0, 0, 0, 0)


@pytest.mark.parametrize("order, step", [("ABCDE", 5), ("EDCBA", 1)])
def test_last_step_keeps_what_fails_nothing(spark, order, step):
    docs = [(k, f"{k} " + " ".join(f"w{k}x{i}" for i in range(60)), "a") for k in range(4)]
    assert got(spark, docs, [])["a", order, step][:2] == (4, 0)
