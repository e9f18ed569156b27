"""The functions under SQL names, and a table function for spans."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as K

from ..functions import dates as D
from . import lexicons as L


@F.pandas_udf(K.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which has no built-in."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.udtf(returnType=K.StructType([K.StructField("entity", K.StringType()), K.StructField("label", K.StringType()), K.StructField("start", K.IntegerType()), K.StructField("end", K.IntegerType())]))
class DateSpans:
    """date_spans(text): every date mention with its place."""

    def eval(self, text: str):
        import re

        if text is not None:
            for pattern, precision in D.PATTERNS:
                for m in re.finditer(pattern, text, re.IGNORECASE):
                    yield m.group(), precision, m.start(), m.end()


def register(spark: SparkSession) -> None:
    spark.udf.register("nfkc", nfkc)
    spark.udtf.register("date_spans", DateSpans)
    sql = {
        "text_words(t STRING) RETURNS ARRAY<STRING>": r"regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+', 0)",
        "period_of(y INT) RETURNS STRING": "CASE WHEN y IS NULL THEN NULL " + " ".join(f"WHEN y < {limit} THEN '{name}'" for limit, name in L.PERIODS) + f" ELSE '{L.LAST_PERIOD}' END",
    }
    for head, body in sql.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
