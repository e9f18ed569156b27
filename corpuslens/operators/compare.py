"""Comparative analysis: lexicon scores and what follows from them.

A lexicon score is the number of distinct terms that occur as substrings of the lower-case text, per 1000 tokens.
All categories' terms are looked for in one pass over a batch's bytes (``functions.terms``). All per-document work is narrow.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..functions.terms import term_counts, term_rates
from ..sources.scratch import stored
from .neighbours import nearest

DIMENSIONS = ["political_ideology", "socioeconomic", "governance", "social_impact"]
GROUPS = {
    "dim": (L.POLITICAL_DIMENSIONS, False),
    "mov": (L.MOVEMENTS, False),
    "soc": (L.SOCIOECONOMIC_INDICATORS, True),
    "sys": (L.ECONOMIC_SYSTEMS, False),
    "gov": (L.GOVERNANCE_INDICATORS, True),
    "gsy": (L.GOVERNANCE_SYSTEMS, False),
    "imp": (L.IMPACT_INDICATORS, True),
    "cat": (L.IMPACT_CATEGORIES, False),
}


def _spaced(terms: list[str], spaced: bool) -> list[str]:
    return [t.replace("_", " ") if spaced else t for t in terms]


def lexicon_scores(docs: DataFrame, groups: list[str], *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, kept columns, and <group>_<category> per 1000 tokens; 0 without tokens."""
    names = [(f"{g}_{c}", _spaced(ts, GROUPS[g][1])) for g in groups for c, ts in GROUPS[g][0].items()]
    n = F.size(T.tokens(F.coalesce(F.col(text_col), F.lit(""))))
    scores = docs.select(id_col, *keep, term_rates(F.col(text_col), [ts for _, ts in names], n).alias("_scores"))
    return scores.select(id_col, *keep, *[F.col("_scores")[i].alias(name) for i, (name, _) in enumerate(names)])


def columns(group: str) -> list[str]:
    return [f"{group}_{c}" for c in GROUPS[group][0]]


def dominant(group: str) -> Column:
    """The first category with the highest score; also where all are 0."""
    names = list(GROUPS[group][0])
    best = F.greatest(*columns(group)) if len(names) > 1 else F.col(columns(group)[0])
    out = None
    for name in names:
        out = (F if out is None else out).when(F.col(f"{group}_{name}") == best, F.lit(name))
    return out


def mentioned(group: str) -> Column:
    return sum((F.when(F.col(c) > 0, 1).otherwise(0) for c in columns(group)), F.lit(0))


def mean_of(group: str, names: list[str] | None = None) -> Column:
    own = [F.col(f"{group}_{n}") for n in names or GROUPS[group][0]]
    return sum(own[1:], own[0]) / len(own)


def net_impact() -> Column:
    return sum((F.col(f"imp_{n}") for n in L.POSITIVE_IMPACT), F.lit(0.0)) - sum((F.col(f"imp_{n}") for n in L.NEGATIVE_IMPACT), F.lit(0.0))


def magnitude() -> Column:
    return F.sqrt(sum((F.col(c) * F.col(c) for c in columns("imp")), F.lit(0.0)))


def power_shares() -> dict[str, Column]:
    total = sum((F.col(f"gov_{n}") for n in L.POWER), F.lit(0.0))
    return {n: F.when(total > 0, F.col(f"gov_{n}") / total) for n in L.POWER}


def themes(text: Column, table: list[tuple[str, list[str]]], most: int | None = 10) -> Column:
    """Distinct themes with any term in the text, sorted, at most ``most`` (part of the definition)."""
    names = F.array(*[F.lit(n) for n, _ in table])
    found = F.filter(F.arrays_zip(names.alias("name"), term_counts(text, [ts for _, ts in table]).alias("n")), lambda x: x["n"] > 0)
    found = F.array_sort(F.array_distinct(F.transform(found, lambda x: x["name"])))
    return F.slice(found, 1, most) if most else found


def dimension_scores(docs: DataFrame, *, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, kept columns, the four dimension scores, overall_score."""
    s = lexicon_scores(docs, ["dim", "soc", "gov", "imp"], id_col=id_col, keep=keep)
    four = [mean_of("dim"), mean_of("soc", L.DEVELOPMENT), mean_of("gov"), net_impact()]
    return with_overall(s.select(id_col, *keep, *[c.alias(n) for n, c in zip(DIMENSIONS, four, strict=True)]))


def with_overall(scores: DataFrame) -> DataFrame:
    return scores.withColumn("overall_score", sum((F.col(d) for d in DIMENSIONS), F.lit(0.0)) / len(DIMENSIONS))


def z_scores(df: DataFrame, names: list[str], *keep: str) -> DataFrame:
    """Columns scaled by the population deviation; 0 where it is 0. One row of statistics is joined to all."""
    stats = df.agg(*[x for n in names for x in (F.avg(n).alias(f"_m_{n}"), F.stddev_pop(n).alias(f"_s_{n}"))])
    return df.crossJoin(F.broadcast(stats)).select(*keep, *[F.coalesce((F.col(n) - F.col(f"_m_{n}")) / F.nullif(F.col(f"_s_{n}"), F.lit(0.0)), F.lit(0.0)).alias(n) for n in names])


def indicators() -> list[str]:
    """Names of the 36 indicators behind the four dimensions, in their order."""
    return [c for g in ("dim", "soc", "gov", "imp") for c in columns(g)]


def feature_vectors(docs: DataFrame, *, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, kept columns, features: the 36 indicators, scaled."""
    return scaled(stored(lexicon_scores(docs, ["dim", "soc", "gov", "imp"], id_col=id_col, keep=keep), "indicators"), id_col=id_col, keep=keep)


def scaled(scores: DataFrame, *, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, kept columns, features: the scores' 36 indicators, scaled. The scores are read twice."""
    return z_scores(scores, indicators(), id_col, *keep).select(id_col, *keep, F.array(*indicators()).alias("features"))


def correlations(df: DataFrame, names: list[str] = DIMENSIONS) -> DataFrame:
    """first, second, r for each pair, in one pass over the data; null where a column is constant."""
    pairs = list(combinations(names, 2))
    one = df.agg(*[F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("x")).select("x.first", "x.second", "x.r")


def correlation_label(r: Column) -> Column:
    strength = F.when(F.abs(r) > 0.7, "Strong").when(F.abs(r) > 0.3, "Moderate").otherwise("Weak")
    return F.concat(strength, F.when(r > 0, F.lit(" positive")).otherwise(F.lit(" negative")))


def evolution(df: DataFrame, names: list[str] = DIMENSIONS, year: str = "year") -> DataFrame:
    """Mean of each score per year; year 0 counts as missing."""
    return df.where((F.col(year).isNotNull()) & (F.col(year) != 0)).groupBy(year).agg(*[F.avg(n).alias(n) for n in names])


def trend(by_year: DataFrame, names: list[str] = DIMENSIONS, year: str = "year") -> DataFrame:
    """dimension, first, last, change in percent from the first to the last year; rows with a first value of 0 go."""
    one = by_year.agg(*[x for n in names for x in (F.min_by(n, year).alias(f"a_{n}"), F.max_by(n, year).alias(f"b_{n}"))])
    rows = F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(f"a_{n}").alias("first"), F.col(f"b_{n}").alias("last")) for n in names])
    t = one.select(F.explode(rows).alias("x")).select("x.*")
    return t.where("first != 0").withColumn("change", (F.col("last") - F.col("first")) / F.col("first") * 100)


def similar(vectors: DataFrame, queries: DataFrame, *, id_col: str = "doc_id", vector_col: str = "features", k: int = 3) -> DataFrame:
    """query, neighbour, cosine, rank over feature vectors: a stated query set (id) against all rows; 0 where a vector is zero."""
    return nearest(vectors, queries, id_col=id_col, vector_col=vector_col, k=k)


def unpivoted(df: DataFrame, *keep: str, names: list[str] = DIMENSIONS) -> DataFrame:
    return df.unpivot(list(keep), names, "dimension", "score")


def top_documents(df: DataFrame, k: int = 3, id_col: str = "doc_id") -> DataFrame:
    order = Window.partitionBy("dimension").orderBy(F.desc(F.round("score", 9)), id_col)
    return unpivoted(df, id_col).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def representatives(df: DataFrame, group: str, score: str = "overall_score", id_col: str = "doc_id") -> DataFrame:
    """The upper median document of each group by score (to nine digits), ties by id; null scores come first."""
    return order_statistic(df, group, [F.round(score, 9), F.col(id_col)], lambda n: F.floor(n / 2) + 1)


def order_statistic(df: DataFrame, group: str, keys: list[Column], rank: Callable[[Column], Column]) -> DataFrame:
    """Of each group the row whose rank by the keys (nulls first) is rank(number of its rows).

    No group is sorted, or even met, by one task: keys are dealt by range over (group, keys), ranges are counted for each
    group, and only the range that holds the wanted rank numbers its rows of that group. Null groups are a group; of rows
    alike in group and keys any may be taken, as they can't be told apart by them."""
    named = [c.alias(f"_k{i}") for i, c in enumerate(keys)]
    order = [F.col(f"_k{i}") for i in range(len(keys))]
    ranged = df.select("*", *named).repartitionByRange(F.col(group), *order).withColumn("_range", F.spark_partition_id())
    kept = stored(ranged, "ranges")
    counts = kept.groupBy(group, "_range").agg(F.count("*").alias("_n"))  # a row for each group and range
    upto = F.sum("_n").over(Window.partitionBy(group).orderBy("_range"))
    every = F.sum("_n").over(Window.partitionBy(group))
    wanted = counts.select(F.col(group).alias("_group"), "_range", (upto - F.col("_n")).alias("_before"), "_n", rank(every).alias("_rank"))
    wanted = wanted.where((F.col("_before") < F.col("_rank")) & (F.col("_rank") <= F.col("_before") + F.col("_n"))).select("_group", F.col("_range").alias("_r"), (F.col("_rank") - F.col("_before")).alias("_at"))
    near = kept.join(wanted, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_r")))
    place = F.row_number().over(Window.partitionBy("_range", group).orderBy(*order))
    return near.withColumn("_place", place).where("_place = _at").select(*df.columns)
