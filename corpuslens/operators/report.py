"""Cross-document report aggregates; ties between equally frequent values go to the alphabetically first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..sources.scratch import stored
from . import compare as K


def judged(docs: DataFrame, *, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """One wide row per document with everything the reports aggregate."""
    s = K.lexicon_scores(docs, list(K.GROUPS), id_col=id_col, keep=(*keep, "text"))
    shares = K.power_shares()
    return s.select(
        id_col, *keep, K.dominant("dim").alias("ideology"), K.dominant("sys").alias("economic_system"), K.dominant("gsy").alias("governance_system"), K.dominant("cat").alias("impact_category"),
        K.mean_of("dim").alias("political_ideology"), K.mean_of("soc", L.DEVELOPMENT).alias("socioeconomic"), K.mean_of("gov").alias("governance"), K.net_impact().alias("social_impact"),
        K.mean_of("soc", L.INEQUALITY).alias("inequality"), K.mentioned("gov").alias("complexity"), K.magnitude().alias("magnitude"), K.mentioned("dim").alias("ideology_count"),
        *[c.alias(f"share_{n}") for n, c in shares.items()], *K.indicators(),
        K.themes(F.col("text"), L.POLITICAL_THEMES).alias("political_themes"),
    )


def most_common(df: DataFrame, column: str, *by: str, weight: str | None = None) -> DataFrame:
    """by, value, n: the most frequent non-null value. weight: a column that says how many rows each row stands for."""
    n = F.count("*") if weight is None else F.sum(weight)
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("value")).agg(n.alias("n"))
    if by:
        order = Window.partitionBy(*by).orderBy(F.desc("n"), "value")
        return counts.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
    return counts.orderBy(F.desc("n"), "value").limit(1)


def executive(j: DataFrame) -> DataFrame:
    """aspect, value, n, percent: the mode of ideology, economic and governance system."""
    total = j.agg(F.count("*").alias("all"))
    long = j.unpivot([], ["ideology", "economic_system", "governance_system"], "aspect", "value")
    return most_common(long, "value", "aspect").crossJoin(F.broadcast(total)).select("aspect", "value", "n", (F.col("n") * 100.0 / F.col("all")).alias("percent"))


def ideology(j: DataFrame) -> DataFrame:
    """ideology, n, mean score, number of distinct themes, and the themes (a fixed table's, so few), sorted."""
    # documents alike in both count as one row, so that their texts are scored once
    alike = j.groupBy("ideology", "political_themes").agg(F.count("*").alias("n"), F.sum("political_ideology").alias("sum"), F.count("political_ideology").alias("known"))
    alike = stored(alike, "ideologies")
    counts = alike.groupBy("ideology").agg(F.sum("n").alias("n"), F.try_divide(F.sum("sum"), F.sum("known")).alias("avg_score"))
    t = alike.select("ideology", F.explode("political_themes").alias("theme")).groupBy("ideology").agg(F.array_sort(F.collect_set("theme")).alias("t"))
    found = t.select("ideology", F.size("t").cast("long").alias("n_themes"), F.array_join("t", "|").alias("themes"))
    return counts.join(found, "ideology", "left").fillna({"n_themes": 0, "themes": ""})


def _mean_where(value: Column, holds: Column) -> Column:
    return F.avg(F.when(holds, value))


def socioeconomic(j: DataFrame) -> DataFrame:
    """economic_system, n, means of the development and inequality indices over their positive values."""
    positive = lambda c: _mean_where(F.col(c), F.col(c) > 0)
    return j.groupBy("economic_system").agg(F.count("*").alias("n"), positive("socioeconomic").alias("avg_development"), positive("inequality").alias("avg_inequality"))


def governance(j: DataFrame) -> DataFrame:
    """One row: mean power shares over documents that have them, mean complexity over positive ones."""
    return j.agg(*[F.avg(f"share_{n}").alias(f"avg_{n}") for n in L.POWER], _mean_where(F.col("complexity"), F.col("complexity") > 0).alias("avg_complexity"))


def social_impact(j: DataFrame) -> DataFrame:
    """One row: mean net impact (not 0), means of positive and of negative indicator values above 0, mean magnitude above 0, and the sign in words."""

    def over(names: list[str]) -> Column:
        values = F.filter(F.array(*[F.col(f"imp_{n}") for n in names]), lambda x: x > 0)
        return F.sum(F.aggregate(values, F.lit(0.0), lambda a, x: a + x)) / F.nullif(F.sum(F.size(values)), F.lit(0))

    one = j.agg(_mean_where(F.col("social_impact"), F.col("social_impact") != 0).alias("avg_net"), over(L.POSITIVE_IMPACT).alias("avg_positive"), over(L.NEGATIVE_IMPACT).alias("avg_negative"), _mean_where(F.col("magnitude"), F.col("magnitude") > 0).alias("avg_magnitude"))
    return one.withColumn("direction", F.when(F.col("avg_net") > 0, "positive").when(F.col("avg_net") < 0, "negative").otherwise("neutral"))


def clusters(j: DataFrame, cluster: str) -> DataFrame:
    """Clusters of more than one document: size, mean overall score, mode of ideology and economic system, distinct ideologies."""
    overall = sum((F.col(d) for d in K.DIMENSIONS), F.lit(0.0)) / len(K.DIMENSIONS)
    # one row for each combination of the two modes' values, so that texts are scored once
    alike = j.groupBy(cluster, "ideology", "economic_system").agg(F.count("*").alias("n"), F.sum(overall).alias("sum"), F.count(overall).alias("known"))
    alike = stored(alike, "clusters")
    base = alike.groupBy(cluster).agg(F.sum("n").alias("n"), F.try_divide(F.sum("sum"), F.sum("known")).alias("avg_overall"), F.countDistinct("ideology").alias("n_ideologies")).where("n > 1")
    for column in ("ideology", "economic_system"):
        base = base.join(most_common(alike, column, cluster, weight="n").select(cluster, F.col("value").alias(f"top_{column}")), cluster, "left")
    return base


def key_indicators(most: int = 5) -> dict[str, list[str]]:
    """The first indicators of each dimension."""
    return {d: list(K.GROUPS[g][0])[:most] for d, g in zip(K.DIMENSIONS, ("dim", "soc", "gov", "imp"), strict=True)}


def evidence(scores: DataFrame, summaries: DataFrame, entities: DataFrame, *, id_col: str = "doc_id", excerpt: int = 200, most: int = 5) -> DataFrame:
    """id, dimension, score, key_indicators, excerpt, entities (the first ones in the text, repeats included): documents with or without a summary and entities, for each dimension."""
    order = Window.partitionBy(id_col).orderBy("start", "end", "entity")
    first = entities.select(id_col, "start", "end", "entity", F.row_number().over(order).alias("_r")).where(F.col("_r") <= most)
    named = first.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "entity"))), lambda x: x["entity"]).alias("entities"))
    rows = scores.select(id_col, *K.DIMENSIONS).join(summaries.select(id_col, F.substring("summary", 1, excerpt).alias("excerpt")), id_col, "left").join(named, id_col, "left")
    each = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("score"), F.lit("|".join(names)).alias("key_indicators")) for d, names in key_indicators(most).items()])
    return rows.select(id_col, F.explode(each).alias("x"), "excerpt", "entities").select(id_col, "x.*", F.coalesce("excerpt", F.lit("")).alias("excerpt"), F.coalesce(F.array_join("entities", "|"), F.lit("")).alias("entities"))


def time_period(df: DataFrame, year: str = "year") -> DataFrame:
    known = df.where((F.col(year).isNotNull()) & (F.col(year) != 0))
    return known.agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"), (F.max(year) - F.min(year)).alias("span"), F.count("*").alias("n"))


def step_performance(log: DataFrame) -> DataFrame:
    """step, count, average, least, most and total duration."""
    return log.groupBy("step").agg(F.count("*").alias("count"), F.avg("duration").alias("average"), F.min("duration").alias("least"), F.max("duration").alias("most"), F.sum("duration").alias("total"))


METHODOLOGY = (
    "Texts are cleaned by pattern rules with dates, numbers and names protected, then cut into words and sentences by rule.",
    "A lexicon score is the number of distinct terms of a category that occur in a text, per 1000 tokens.",
    "Entities come from rules and gazetteers; overlaps go to the more confident, then the longer. Events are sentences around dates.",
    "Events that are close in time and alike in words and entities are merged in time order.",
)
LIMITATIONS = (
    "Scores count words, not what is said of them: negation, irony and quotation count like assertion.",
    "Rules expect English; dates that are not written as one of the known patterns are not found.",
    "Means over few documents say little; correlations do not tell causes.",
)


def final_statistics(results: dict[str, DataFrame]) -> DataFrame:
    """One row: documents, words, entities, distinct entities, events, merged events, mean compression of summaries. What was not computed is null."""

    def one(name: str, column: Column, kind: str) -> Column:
        return F.lit(None).cast(kind) if name not in results else results[name].agg(column.cast(kind).alias("x")).scalar()

    spark = next(iter(results.values())).sparkSession
    return spark.range(1).select(
        one("cleaned", F.count("*"), "long").alias("documents"), one("basic_stats", F.sum("n_words"), "long").alias("words"),
        one("entities", F.count("*"), "long").alias("entities"), one("entities", F.countDistinct("entity", "label"), "long").alias("distinct_entities"),
        one("events", F.count("*"), "long").alias("events"), one("merged_events", F.count("*"), "long").alias("merged_events"),
        one("summaries", F.avg(F.try_divide("n_chosen", "n_sentences")), "double").alias("mean_compression"),
    )


def findings(results: dict[str, DataFrame]) -> DataFrame:
    """section, name, value: entities by label and events by century (most first), the most common ideology, systems and merge reduction. What was not computed has no rows."""
    parts = []
    if "entities" in results:
        parts.append(results["entities"].groupBy("label").agg(F.count("*").alias("n")).select(F.lit("entities by label").alias("section"), F.col("label").alias("name"), F.col("n").cast("double").alias("value")))
    if "events" in results:
        named = results["events"].where("century IS NOT NULL").groupBy("century").agg(F.count("*").alias("n"))
        parts.append(named.select(F.lit("events by century").alias("section"), F.col("century").cast("string").alias("name"), F.col("n").cast("double").alias("value")))
    if "report_executive" in results:
        parts.append(results["report_executive"].select(F.concat(F.lit("most common "), F.replace("aspect", F.lit("_"), F.lit(" "))).alias("section"), F.col("value").alias("name"), F.col("percent").alias("value")))
    if "report_trend" in results:
        parts.append(results["report_trend"].select(F.lit("change in percent").alias("section"), F.col("dimension").alias("name"), F.col("change").alias("value")))
    if {"events", "merged_events"} <= set(results):
        before, after = results["events"].agg(F.count("*").alias("b")), results["merged_events"].agg(F.count("*").alias("a"))
        parts.append(before.crossJoin(after).select(F.lit("merging").alias("section"), F.lit("reduction in percent").alias("name"), F.try_divide(100.0 * (F.col("b") - F.col("a")), "b").alias("value")))
    out = parts[0] if parts else next(iter(results.values())).sparkSession.createDataFrame([], "section string, name string, value double")
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy("section", F.desc("value"), "name")
