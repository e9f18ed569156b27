"""Dates in words by the grammar, against a plain calendar and by hand."""

import datetime

from pyspark.sql import functions as F

from corpuslens.functions import dates as D
from corpuslens.operators import timeline as E


def read(spark, texts, f=D.parse_loose):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", f(F.col("s")).alias("p")).orderBy("i").collect()
    return [(str(r.p.date), r.p.precision) if r.p and r.p.date else None for r in rows]


def roman(n):
    out = ""
    for v, s in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        out += s * (n // v)
        n %= v
    return out


def test_by_hand(spark):
    cases = {
        "15 Aug 1947": ("1947-08-15", "day"), "Aug. 15th, 1947": ("1947-08-15", "day"), "the 3rd of Sept. 1850": ("1850-09-03", "day"), "Friday, 15 August 1947": ("1947-08-15", "day"),
        "1947 Aug 15": ("1947-08-15", "day"), "12/25/1947": ("1947-12-25", "day"), "MDCCCXLVIII": ("1848-01-01", "year"), "anno domini MDLXX": ("1570-01-01", "year"), "1 Aug 1947": ("1947-08-01", "month"),
        "August, 1947": ("1947-08-01", "month"), "4/5/1947": ("1947-05-04", "day"), "31 Feb 1945": None, "Maybe 1990": None, "Spring 1947": None, "": None, "MCMC": None, "IIII": None, "15 Augustus 1947": None, "99/99/1947": None, "the": None,
    }
    assert dict(zip(cases, read(spark, list(cases)), strict=True)) == cases
    assert read(spark, [None]) == [None]


def test_all_roman_years(spark):
    years = range(1001, 2100)
    assert read(spark, [roman(y) for y in years]) == [(f"{y}-01-01", "year") for y in years]


def test_every_day(spark):
    days = [datetime.date(1903, 1, 1) + datetime.timedelta(days=i) for i in range(365)]
    want = [(str(d), "day" if d.day > 1 else "month" if d.month > 1 else "year") for d in days]
    for form in ("%d %B %Y", "%b %d, %Y", "%A %d. %B, %Y"):
        assert read(spark, [d.strftime(form) for d in days]) == want


def test_patterns_come_first(spark):
    assert read(spark, ["04/05/1947", "1947", "1960s", "12/25/1947", "Spring 1947"], D.parse_any) == [("1947-05-04", "day"), ("1947-06-15", "year"), ("1965-06-15", "decade"), ("1947-12-25", "day"), None]


def test_mentions(spark):
    text = "On Aug. 15th, 1947 and the 3 of May, 1850; built MDCCCXLVIII by MMXQ Ltd, 31 Feb 1945."
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    found = {r.date_str: str(r.date) for r in E.date_mentions(docs, loose=True).collect()}
    assert found["Aug. 15th, 1947"] == "1947-08-15" and found["3 of May, 1850"] == "1850-05-03" and found["MDCCCXLVIII"] == "1848-01-01"
    assert "31 Feb 1945" not in found and not any("MMX" in x for x in found)
