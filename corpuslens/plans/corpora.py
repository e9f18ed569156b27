"""Derived corpora: the synthetic documents are invented words, so dated, named and political text is made from the
relational tables. The expressions are plain SQL that reads alike in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .registry import table

YEAR = "CAST(1400 + (o_orderkey * 37) % 620 AS INT)"
LATER = "CAST(1900 + o_custkey % 100 AS STRING)"
EVENT = "CASE o_orderkey % 5 WHEN 0 THEN 'Treaty' WHEN 1 THEN 'Battle' WHEN 2 THEN 'Congress' WHEN 3 THEN 'War' ELSE 'Revolution' END"
THEME = (
    "CASE o_orderkey % 9 WHEN 0 THEN 'Freedom, rights and equality of women brought reform and progress. ' WHEN 1 THEN 'The crown and the royal dynasty kept order, tradition and authority. '"
    " WHEN 2 THEN 'Workers asked for public welfare, redistribution and a union after the strike. ' WHEN 3 THEN 'The empire sent its navy to the colony for trade and expansion. '"
    " WHEN 4 THEN 'Poverty, disease and famine spread through the town while wealth grew. ' WHEN 5 THEN 'Parliament held an election and the vote made a republic. '"
    " WHEN 6 THEN 'New technology, industry and education led to growth and development. ' WHEN 7 THEN 'Conflict, violence and revolution brought death and disorder. ' ELSE 'Nothing happened. ' END"
)
DATED = (
    f"CASE o_custkey % 8 WHEN 0 THEN concat('It began in August ', {LATER}, '. ') WHEN 1 THEN concat('The treaty was signed on ', {LATER}, '-08-15. ')"
    f" WHEN 2 THEN concat('The war lasted from 1898-', {LATER}, '. ') WHEN 3 THEN 'It was the early 19th century. ' WHEN 4 THEN concat('Around ', {LATER}, ' a flood came. ')"
    f" WHEN 5 THEN concat('The ', CAST(1800 + 10 * (o_orderkey % 10) AS STRING), 's were hard. ') WHEN 6 THEN concat('The election was held in Spring ', {LATER}, '. ') ELSE 'It happened 500 BCE. ' END"
)
TEXT = f"concat('In ', CAST({YEAR} AS STRING), ' the ', {EVENT}, ' of ', n_name, ' ended. ', {THEME}, {DATED}, 'King ', r_name, ' spoke of the Battle of Waterloo.')"
#: doc_id, year, grp (nation), text: one short dated document for each order.
HISTORY = f"SELECT o_orderkey AS doc_id, {YEAR} AS year, n_name AS grp, {TEXT} AS text FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
WITH_HISTORY = f"WITH history AS ({HISTORY})"
SHARES = 4  # tasks a core


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nation and region tables have 25 and 5 rows at any scale; Spark broadcasts them by their size.

    Orders may be one file of one split, and a join's thin rows are put into few partitions; they (three longs) are dealt out before the text is made, so that all cores take part and no task holds more than a fraction of a core's share."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    thin = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "o_custkey", "c_nationkey")
    thin = thin.repartition(max(SHARES * spark.sparkContext.defaultParallelism, o.rdd.getNumPartitions()), "o_orderkey")
    joined = thin.join(n, thin.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.selectExpr("o_orderkey AS doc_id", f"{YEAR} AS year", "n_name AS grp", f"{TEXT} AS text")
