"""What a text is searched for is searched for once: no filter makes the same array again before an explosion."""

import pytest

from corpuslens.functions import dates as D
from corpuslens.operators import entities as N
from corpuslens.operators import timeline as E

RULES = [(p, "DATE") for p in N.RULE_DATES]


def searches(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(")


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(1, "In 1848 it began, by 31/02/1945 and 1914-1918; the 19th century, circa 900."), (2, ""), (3, None)], "doc_id long, text string")


def test_mentions_are_made_once(docs):
    found = E.date_mentions(docs)
    assert searches(found) == len(D.PATTERNS)
    assert [(r.date_str, r.precision, r.year) for r in found.orderBy("seq").collect()] == [("31/02/1945", "unknown", None), ("1848", "year", 1848), ("1945", "year", 1945), ("1914", "year", 1914), ("1918", "year", 1918), ("19th century", "century", 1850), ("1914-1918", "year", 1914), ("circa 900", "approximate", 900)]


def test_rules_are_matched_once(docs):
    found = N.rule_entities(docs, [*[(*r, 0.8) for r in RULES[:3]], (N.TITLED, "PERSON", 0.9)])
    assert searches(found) == 4
    assert sorted((r.entity, r.start, r.confidence) for r in found.collect()) == [("1914-1918", 36, 0.8), ("19th century", 51, 0.8), ("circa 900", 65, 0.8)]
