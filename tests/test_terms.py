import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslens.functions.terms import Finder, term_counts, term_rates
from corpuslens.operators.neighbours import nearest
from corpuslens.operators import report as R

GROUPS = [["order", "disorder", "den"], ["nation", "national", "é"], ["rd", "order"]]


def plain(text, categories=GROUPS):
    return [sum(t in (text or "").lower() for t in set(ts)) for ts in categories]


def test_counts_against_substrings():
    rng = np.random.default_rng(3)
    parts = ["order", "dis", "nation", "al", "é", "den", " ", "rd", "ORDER", "or"]
    texts = [None, "", "o", "or", *["".join(rng.choice(parts, 6)) for _ in range(500)]]
    low = pa.array([t if t is None else t.lower() for t in texts])
    assert Finder(GROUPS).counts(low).tolist() == [plain(t) for t in texts]
    assert Finder(GROUPS).counts(low.slice(7, 90)).tolist() == [plain(t) for t in texts[7:97]]
    assert Finder(GROUPS).counts(pa.array([], pa.string())).shape == (0, 3)


def test_no_term_reaches_over_a_row():
    assert Finder([["order"]]).counts(pa.array(["or", "der", "xorder"])).tolist() == [[0], [0], [1]]


def test_columns(spark):
    df = spark.createDataFrame([("Disorder of NATIONS", 4), (None, 0), ("order", None)], "text string, n int")
    got = df.select(term_counts(F.col("text"), GROUPS).alias("c"), term_rates(F.col("text"), GROUPS, F.col("n")).alias("r")).collect()
    assert [list(r.c) for r in got] == [[2, 1, 2], [0, 0, 0], [1, 0, 2]]
    assert [list(r.r) for r in got] == [[500.0, 250.0, 500.0], [0.0] * 3, [0.0] * 3]


def test_texts_are_scored_once(spark):
    """One scan of the texts behind each report, and one for the neighbours' vectors."""
    df = spark.createDataFrame([(i, "Freedom and order", "a") for i in range(4)], "doc_id long, text string, grp string")
    for made in (R.ideology(R.judged(df)), R.clusters(R.judged(df, keep=("grp",)), "grp")):
        assert "ArrowEvalPython" not in made._jdf.queryExecution().executedPlan().toString()
        assert made.count() == 1


@pytest.mark.parametrize("k", [1, 3])
def test_equal_vectors_are_searched_once(spark, k):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(4, 3)).tolist() + [[0.0, 0.0, 0.0]]
    rows = [(i, base[int(rng.integers(5))]) for i in range(60)]
    got = nearest(spark.createDataFrame(rows, "id long, v array<double>"), spark.createDataFrame([(i,) for i in range(0, 60, 4)], "id long"), id_col="id", vector_col="v", k=k)
    m = np.array([v for _, v in rows])
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    near = np.round(m @ m.T, 9)
    want = {(q, r + 1, x) for q in range(0, 60, 4) for r, x in enumerate(sorted((x for x in range(60) if x != q), key=lambda x: (-near[q, x], x))[:k])}
    assert {(r["query"], r["rank"], r.neighbour) for r in got.collect()} == want
