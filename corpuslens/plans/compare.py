"""Queries of the comparative analysis and its reports."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..operators import compare as K
from ..operators import entities as N
from ..operators import report as R
from ..sources.scratch import stored
from . import corpora as C
from .registry import query, table
from .text import q, sql_any


def sql_score(terms: list[str], text: str = "lower(text)", n: str = "n") -> str:
    hits = " + ".join(f"CAST(contains({text}, '{t}') AS INT)" for t in terms)
    return f"(CASE WHEN {n} > 0 THEN ({hits}) / CAST({n} AS DOUBLE) * 1000 ELSE 0 END)"


def sql_group(group: str) -> list[tuple[str, str]]:
    table_, spaced = K.GROUPS[group]
    return [(f"{group}_{c}", sql_score([t.replace("_", " ") if spaced else t for t in ts])) for c, ts in table_.items()]


def sql_scores(groups: list[str]) -> str:
    """CTEs history and s: doc_id, year, grp, text and all scores."""
    base = f"h AS (SELECT *, len(regexp_extract_all(text, {q(T.TOKEN)})) AS n FROM history)"
    return f"{C.WITH_HISTORY}, {base}, s AS (SELECT doc_id, year, grp, text, " + ", ".join(f"{e} AS {c}" for g in groups for c, e in sql_group(g)) + " FROM h)"


def sql_dominant(group: str) -> str:
    best = f"greatest({', '.join(K.columns(group))})"
    return "CASE " + " ".join(f"WHEN {group}_{n} = {best} THEN '{n}'" for n in K.GROUPS[group][0]) + " END"


def sql_mentioned(group: str) -> str:
    return "(" + " + ".join(f"CAST({c} > 0 AS INT)" for c in K.columns(group)) + ")"


def sql_mean(columns: list[str]) -> str:
    return f"(({' + '.join(columns)}) / {len(columns)})"


NET = "(" + " + ".join(f"imp_{n}" for n in L.POSITIVE_IMPACT) + " - " + " - ".join(f"imp_{n}" for n in L.NEGATIVE_IMPACT) + ")"
MAGNITUDE = "sqrt(" + " + ".join(f"{c} * {c}" for c in K.columns("imp")) + ")"
DEVELOPMENT, INEQUALITY = sql_mean([f"soc_{n}" for n in L.DEVELOPMENT]), sql_mean([f"soc_{n}" for n in L.INEQUALITY])
FOUR = dict(zip(K.DIMENSIONS, (sql_mean(K.columns("dim")), DEVELOPMENT, sql_mean(K.columns("gov")), NET), strict=True))
DIMENSION_SQL = sql_scores(["dim", "soc", "gov", "imp"]) + ", d AS (SELECT doc_id, year, grp, " + ", ".join(f"{e} AS {n}" for n, e in FOUR.items()) + "), e AS (SELECT *, (" + " + ".join(K.DIMENSIONS) + ") / 4 AS overall_score FROM d)"
DIMENSION_SQL = DIMENSION_SQL.replace("), e AS", " FROM s), e AS", 1)
POWER_SUM = "(" + " + ".join(f"gov_{n}" for n in L.POWER) + ")"


def rounded(names: list[str]) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def _rounded(df, *keep):
    doubles = {n for n, t in df.dtypes if t == "double"}
    return df.select(*[F.round(c, 6).alias(c) if c in doubles and c not in keep else F.col(c) for c in df.columns])


def _lexicon_sql(groups: list[str], extra: list[str]) -> str:
    names = [c for g in groups for c in K.columns(g)]
    return sql_scores(groups) + f" SELECT doc_id, {rounded(names)}, {', '.join(extra)} FROM s"


@query(_lexicon_sql(["dim", "mov"], [f"{sql_dominant('dim')} AS dominant", f"{sql_mentioned('dim')} AS ideology_count"]))
def lexicon_political(spark, sf_dir):
    s = K.lexicon_scores(C.history(spark, sf_dir), ["dim", "mov"])
    return _rounded(s.withColumn("dominant", K.dominant("dim")).withColumn("ideology_count", K.mentioned("dim")))


@query(_lexicon_sql(["soc", "sys"], [f"{sql_dominant('sys')} AS dominant", f"round({DEVELOPMENT}, 6) AS development", f"round({INEQUALITY}, 6) AS inequality"]))
def lexicon_socioeconomic(spark, sf_dir):
    s = K.lexicon_scores(C.history(spark, sf_dir), ["soc", "sys"])
    return _rounded(s.withColumn("dominant", K.dominant("sys")).withColumn("development", K.mean_of("soc", L.DEVELOPMENT)).withColumn("inequality", K.mean_of("soc", L.INEQUALITY)))


@query(_lexicon_sql(["gov", "gsy"], [f"{sql_dominant('gsy')} AS dominant", f"{sql_mentioned('gov')} AS complexity", *[f"round(CASE WHEN {POWER_SUM} > 0 THEN gov_{n} / {POWER_SUM} END, 6) AS share_{n}" for n in L.POWER]]))
def lexicon_governance(spark, sf_dir):
    s = K.lexicon_scores(C.history(spark, sf_dir), ["gov", "gsy"])
    return _rounded(s.withColumn("dominant", K.dominant("gsy")).withColumn("complexity", K.mentioned("gov")).withColumns({f"share_{n}": c for n, c in K.power_shares().items()}))


@query(_lexicon_sql(["imp", "cat"], [f"{sql_dominant('cat')} AS dominant", f"round({NET}, 6) AS net_impact", f"round({MAGNITUDE}, 6) AS magnitude"]))
def lexicon_social_impact(spark, sf_dir):
    s = K.lexicon_scores(C.history(spark, sf_dir), ["imp", "cat"])
    return _rounded(s.withColumn("dominant", K.dominant("cat")).withColumn("net_impact", K.net_impact()).withColumn("magnitude", K.magnitude()))


def sql_themes(table_: list[tuple[str, list[str]]], most: int | None) -> str:
    cases = ", ".join(f"CASE WHEN {sql_any('lower(text)', ts)} THEN '{n}' END" for n, ts in table_)
    cut = f"[1:{most}]" if most else ""
    return f"coalesce(array_to_string(list_sort(list_distinct(list_filter([{cases}], lambda x: x IS NOT NULL))){cut}, '|'), '')"


@query(f"{C.WITH_HISTORY} SELECT doc_id, {sql_themes(L.POLITICAL_THEMES, 10)} AS political, {sql_themes(L.SOCIOECONOMIC_THEMES, None)} AS socioeconomic FROM history")
def themes(spark, sf_dir):
    h = C.history(spark, sf_dir)
    return h.select("doc_id", F.array_join(K.themes(F.col("text"), L.POLITICAL_THEMES), "|").alias("political"), F.array_join(K.themes(F.col("text"), L.SOCIOECONOMIC_THEMES, None), "|").alias("socioeconomic"))


def _scores(spark, sf_dir):
    return K.dimension_scores(C.history(spark, sf_dir), keep=("year", "grp"))


@query(DIMENSION_SQL + f" SELECT doc_id, {rounded([*K.DIMENSIONS, 'overall_score'])} FROM e")
def dimension_scores(spark, sf_dir):
    return _rounded(_scores(spark, sf_dir).drop("year", "grp"))


@query("WITH d AS (SELECT doc_id, lang, text, len(regexp_extract_all(text, " + q(T.TOKEN) + ")) AS n FROM documents), s AS (SELECT doc_id, lang, " + ", ".join(f"{e} AS {c}" for g in ("dim", "soc", "gov", "imp") for c, e in sql_group(g)) + f" FROM d) SELECT lang, count(*) AS n, {', '.join(f'round(avg({e}), 6) AS {n}' for n, e in FOUR.items())} FROM s GROUP BY lang")
def lexicon_scores_by_lang(spark, sf_dir):
    s = K.dimension_scores(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), keep=("lang",))
    return s.groupBy("lang").agg(F.count("*").alias("n"), *[F.round(F.avg(d), 6).alias(d) for d in K.DIMENSIONS])


_INDICATORS = sql_scores(["dim", "soc", "gov", "imp"])


def _z(name: str) -> str:
    return f"coalesce(({name} - avg({name}) OVER ()) / nullif(stddev_pop({name}) OVER (), 0), 0)"


@query(_INDICATORS + " SELECT doc_id, " + ", ".join(f"round({_z(n)}, 5) AS {n}" for n in K.indicators()) + " FROM s")
def zscores(spark, sf_dir):
    """The 36 indicators, scaled."""
    z = K.z_scores(stored(K.lexicon_scores(C.history(spark, sf_dir), ["dim", "soc", "gov", "imp"]), "indicators"), K.indicators(), "doc_id")
    return z.select("doc_id", *[F.round(d, 5).alias(d) for d in K.indicators()])


_CORR = " UNION ALL ".join(f"SELECT '{a}' AS first, '{b}' AS second, corr({a}, {b}) AS r FROM e" for a, b in combinations(K.DIMENSIONS, 2))


@query(DIMENSION_SQL + f", c AS ({_CORR}) SELECT first, second, round(r, 6) AS r, concat(CASE WHEN abs(r) > 0.7 THEN 'Strong' WHEN abs(r) > 0.3 THEN 'Moderate' ELSE 'Weak' END, CASE WHEN r > 0 THEN ' positive' ELSE ' negative' END) AS label FROM c")
def dimension_correlation(spark, sf_dir):
    return _rounded(K.correlations(_scores(spark, sf_dir)).withColumn("label", K.correlation_label(F.col("r"))))


_EVOLUTION = DIMENSION_SQL + ", y AS (SELECT year, " + ", ".join(f"avg({n}) AS {n}" for n in K.DIMENSIONS) + " FROM e WHERE year <> 0 GROUP BY year)"


@query(_EVOLUTION + f" SELECT year, {rounded(K.DIMENSIONS)} FROM y")
def temporal_evolution(spark, sf_dir):
    return _rounded(K.evolution(_scores(spark, sf_dir)))


@query(_EVOLUTION + ", t AS (" + " UNION ALL ".join(f"SELECT '{n}' AS dimension, min_by({n}, year) AS first, max_by({n}, year) AS last FROM y" for n in K.DIMENSIONS) + ") SELECT dimension, round(first, 6) AS first, round(last, 6) AS last, round((last - first) / first * 100, 5) AS change FROM t WHERE first <> 0")
def trend_change(spark, sf_dir):
    t = K.trend(K.evolution(_scores(spark, sf_dir)))
    return t.select("dimension", F.round("first", 6).alias("first"), F.round("last", 6).alias("last"), F.round("change", 5).alias("change"))


_Z = _INDICATORS + ", z AS (SELECT doc_id, [" + ", ".join(_z(n) for n in K.indicators()) + "] AS v FROM s)"


@query(_Z + ", p AS (SELECT a.doc_id AS query, b.doc_id AS neighbour, coalesce(list_dot_product(a.v, b.v) / nullif(sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)), 0), 0) AS c FROM z a JOIN z b ON a.doc_id <> b.doc_id WHERE a.doc_id % 100 = 0) SELECT query, neighbour, round(c, 5) AS cosine, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(c, 9) DESC, neighbour) AS rank FROM p) WHERE rank <= 3")
def similar_docs_top3(spark, sf_dir):
    v = K.feature_vectors(C.history(spark, sf_dir))
    return K.similar(v, v.where("doc_id % 100 = 0")).withColumn("cosine", F.round("cosine", 5))


@query(DIMENSION_SQL + f" SELECT grp, count(*) AS n, {', '.join(f'round(avg({n}), 6) AS {n}' for n in K.DIMENSIONS)}, array_to_string(list_sort(list(doc_id))[1:3], ',') AS examples FROM e GROUP BY grp")
def cluster_means(spark, sf_dir):
    s = _scores(spark, sf_dir)
    means = s.groupBy("grp").agg(F.count("*").alias("n"), *[F.round(F.avg(d), 6).alias(d) for d in K.DIMENSIONS])
    w = F.row_number().over(K.Window.partitionBy("grp").orderBy("doc_id"))
    first = s.select("grp", "doc_id", w.alias("r")).where("r <= 3").groupBy("grp").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("examples"))
    return means.join(first, "grp")


@query(DIMENSION_SQL + f", u AS (UNPIVOT (SELECT doc_id, {', '.join(K.DIMENSIONS)} FROM e) ON {', '.join(K.DIMENSIONS)} INTO NAME dimension VALUE score) SELECT dimension, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY round(score, 9) DESC, doc_id) AS rank FROM u) WHERE rank <= 3")
def dimension_top3(spark, sf_dir):
    return _rounded(K.top_documents(_scores(spark, sf_dir)))


@query(DIMENSION_SQL + " SELECT grp, doc_id, round(overall_score, 6) AS overall_score FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(overall_score, 9), doc_id) AS r, count(*) OVER (PARTITION BY grp) AS n FROM e) WHERE r = floor(n / 2) + 1")
def representative_docs(spark, sf_dir):
    return _rounded(K.representatives(_scores(spark, sf_dir), "grp").select("grp", "doc_id", "overall_score"))


def _judged(spark, sf_dir):
    return R.judged(C.history(spark, sf_dir), keep=("year", "grp"))


_JUDGED = sql_scores(list(K.GROUPS)) + ", j AS (SELECT *, " + ", ".join(f"{sql_dominant(g)} AS {n}" for g, n in (("dim", "ideology"), ("sys", "economic_system"), ("gsy", "governance_system"), ("cat", "impact_category"))) + ", " + ", ".join(f"{e} AS {n}" for n, e in FOUR.items()) + f", {INEQUALITY} AS inequality, {sql_mentioned('gov')} AS complexity, {MAGNITUDE} AS magnitude, {sql_themes(L.POLITICAL_THEMES, 10)} AS political_themes FROM s)"


def _mode(column: str, by: str = "") -> str:
    return f"SELECT {by + ', ' if by else ''}value, n FROM (SELECT *, row_number() OVER ({f'PARTITION BY {by} ' if by else ''}ORDER BY n DESC, value) AS r FROM (SELECT {by + ', ' if by else ''}{column} AS value, count(*) AS n FROM j WHERE {column} IS NOT NULL GROUP BY ALL)) WHERE r = 1"


@query(_JUDGED + ", m AS (" + " UNION ALL ".join(f"SELECT '{a}' AS aspect, * FROM ({_mode(a)})" for a in ("ideology", "economic_system", "governance_system")) + ") SELECT aspect, value, n, round(n * 100.0 / (SELECT count(*) FROM j), 6) AS percent FROM m")
def report_executive(spark, sf_dir):
    return _rounded(R.executive(_judged(spark, sf_dir)))


@query(_JUDGED + ", t AS (SELECT ideology, count(DISTINCT theme) AS n_themes, string_agg(DISTINCT theme, '|' ORDER BY theme) AS themes FROM (SELECT ideology, unnest(string_split(political_themes, '|')) AS theme FROM j WHERE political_themes <> '') GROUP BY ideology) SELECT j.ideology, count(*) AS n, round(avg(political_ideology), 6) AS avg_score, coalesce(max(n_themes), 0) AS n_themes, coalesce(max(themes), '') AS themes FROM j LEFT JOIN t USING (ideology) GROUP BY j.ideology")
def report_ideology(spark, sf_dir):
    return _rounded(R.ideology(_judged(spark, sf_dir)))


@query(_JUDGED + " SELECT economic_system, count(*) AS n, round(avg(socioeconomic) FILTER (socioeconomic > 0), 6) AS avg_development, round(avg(inequality) FILTER (inequality > 0), 6) AS avg_inequality FROM j GROUP BY economic_system")
def report_socioeconomic(spark, sf_dir):
    return _rounded(R.socioeconomic(_judged(spark, sf_dir)))


@query(_JUDGED + " SELECT " + ", ".join(f"round(avg(CASE WHEN {POWER_SUM} > 0 THEN gov_{n} / {POWER_SUM} END), 6) AS avg_{n}" for n in L.POWER) + ", round(avg(complexity) FILTER (complexity > 0), 6) AS avg_complexity FROM j")
def report_governance(spark, sf_dir):
    return _rounded(R.governance(_judged(spark, sf_dir)))


def _over(names: list[str]) -> str:
    total = " + ".join(f"CASE WHEN imp_{n} > 0 THEN imp_{n} ELSE 0 END" for n in names)
    count = " + ".join(f"CAST(imp_{n} > 0 AS INT)" for n in names)
    return f"round(sum({total}) / nullif(sum({count}), 0), 6)"


@query(_JUDGED + f" SELECT round(avg(social_impact) FILTER (social_impact <> 0), 6) AS avg_net, {_over(L.POSITIVE_IMPACT)} AS avg_positive, {_over(L.NEGATIVE_IMPACT)} AS avg_negative, round(avg(magnitude) FILTER (magnitude > 0), 6) AS avg_magnitude, CASE WHEN avg(social_impact) FILTER (social_impact <> 0) > 0 THEN 'positive' WHEN avg(social_impact) FILTER (social_impact <> 0) < 0 THEN 'negative' ELSE 'neutral' END AS direction FROM j")
def report_social_impact(spark, sf_dir):
    return _rounded(R.social_impact(_judged(spark, sf_dir)))


@query(_JUDGED + f", a AS ({_mode('ideology', 'grp')}), b AS ({_mode('economic_system', 'grp')}) SELECT j.grp, count(*) AS n, round(avg(({' + '.join(K.DIMENSIONS)}) / 4), 6) AS avg_overall, count(DISTINCT ideology) AS n_ideologies, max(a.value) AS top_ideology, max(b.value) AS top_economic_system FROM j LEFT JOIN a ON a.grp = j.grp LEFT JOIN b ON b.grp = j.grp GROUP BY j.grp HAVING count(*) > 1")
def report_clusters(spark, sf_dir):
    return _rounded(R.clusters(_judged(spark, sf_dir), "grp"))


_KEYS = ", ".join(f"('{d}', '{'|'.join(names)}')" for d, names in R.key_indicators().items())


@query(DIMENSION_SQL + f", u AS (UNPIVOT (SELECT doc_id, {', '.join(K.DIMENSIONS)} FROM e) ON {', '.join(K.DIMENSIONS)} INTO NAME dimension VALUE score) SELECT u.doc_id, u.dimension, round(score, 6) AS score, key_indicators, substring(text, 1, 200) AS excerpt, array_to_string(regexp_extract_all(text, '[A-Z][a-z]+')[1:5], '|') AS entities FROM u JOIN (VALUES {_KEYS}) AS k(dimension, key_indicators) ON k.dimension = u.dimension JOIN history h ON h.doc_id = u.doc_id")
def report_evidence(spark, sf_dir):
    h = C.history(spark, sf_dir)
    found = h.select("doc_id", F.explode(N.spans(F.col("text"), "[A-Z][a-z]+")).alias("e")).select("doc_id", "e.*")
    return _rounded(R.evidence(K.dimension_scores(h), h.select("doc_id", F.col("text").alias("summary")), found))


@query(C.WITH_HISTORY + " SELECT min(year) AS first_year, max(year) AS last_year, max(year) - min(year) AS span, count(*) AS n FROM history WHERE year <> 0")
def report_time_period(spark, sf_dir):
    return R.time_period(C.history(spark, sf_dir))


@query("SELECT event_type AS step, count(*) AS count, round(avg(value), 6) AS average, min(value) AS least, max(value) AS most, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def step_performance(spark, sf_dir):
    out = R.step_performance(table(spark, sf_dir, "events").select(F.col("event_type").alias("step"), F.col("value").alias("duration")))
    return out.withColumn("average", F.round("average", 6)).withColumn("total", F.round("total", 4))
