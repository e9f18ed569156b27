"""Queries over dates, timelines and entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import lexicons as L
from ..functions import text as T
from ..operators import entities as N
from ..operators import pos as P
from ..operators import recognise as S
from ..operators import timeline as E
from ..sources.scratch import stored
from . import corpora as C
from .registry import query, table
from .text import q, sql_any, sql_period


def _date_sql(y: str, m: str, d: str) -> str:
    t = f"concat(lpad({y}, 4, '0'), '-', lpad({m}, 2, '0'), '-', lpad({d}, 2, '0'))"
    return f"CASE WHEN length({t}) = 10 AND length({y}) <= 4 THEN try_cast({t} AS DATE) END"


def _g(s: str, i: int, n: int) -> str:
    return f"nullif(regexp_extract({s}, {q(D.pattern(i, True))}, {n}), '')"


def sql_parse(s: str) -> list[tuple[str, str]]:
    month = "CASE substring(lower(%s), 1, 3) " + " ".join(f"WHEN '{m}' THEN '{i + 1}'" for i, m in enumerate(D.MONTH_NUMBERS)) + " ELSE '1' END"
    century = lambda c: f"CAST((CAST({c} AS INT) - 1) * 100 + 50 AS STRING)"
    return [
        (_date_sql(_g(s, 0, 1), _g(s, 0, 2), _g(s, 0, 3)), "day"),
        (_date_sql(_g(s, 1, 3), _g(s, 1, 2), _g(s, 1, 1)), "day"),
        (_date_sql(_g(s, 2, 2), month % _g(s, 2, 1), "'01'"), "month"),
        (_date_sql(_g(s, 3, 1), "'06'", "'15'"), "year"),
        (_date_sql(f"CAST(CAST({_g(s, 4, 1)} AS INT) + 5 AS STRING)", "'06'", "'15'"), "decade"),
        (_date_sql(century(_g(s, 5, 1)), "'06'", "'15'"), "century"),
        (_date_sql(_g(s, 7, 1), "'06'", "'15'"), "year"),
        (_date_sql(_g(s, 8, 1), "'06'", "'15'"), "approximate"),
        (_date_sql(century(_g(s, 10, 2)), "'06'", "'15'"), "century"),
    ]


def sql_parsed(source: str, keep: str) -> str:
    """CTE p over source (a CTE with date_str): keep, date_str, date, precision."""
    steps = sql_parse("date_str")
    cases = ", ".join(f"{e} AS d{i}" for i, (e, _) in enumerate(steps))
    date = f"coalesce({', '.join(f'd{i}' for i in range(len(steps)))})"
    precision = "CASE " + " ".join(f"WHEN d{i} IS NOT NULL THEN '{p}'" for i, (_, p) in enumerate(steps)) + " ELSE 'unknown' END"
    return f"u AS (SELECT {keep}, date_str, {cases} FROM {source}), p AS (SELECT {keep}, date_str, {date} AS date, {precision} AS precision, CAST(year({date}) AS INT) AS year FROM u)"


_FORMS = ["CAST(o_orderdate AS DATE)", "strftime(o_orderdate, '%d/%m/%Y')", "strftime(o_orderdate, '%B %Y')", "strftime(o_orderdate, '%Y')", "concat(strftime(o_orderdate, '%Y'), 's')", "'19th century'", "'early 20th century'", "'500 BCE'", "concat('circa ', strftime(o_orderdate, '%Y'))", "concat('Spring ', strftime(o_orderdate, '%Y'))", "'31/02/1945'", "'1914-1918'", "'Maybe 1990'"]
_STRINGS = "s AS (SELECT o_orderkey AS doc_id, CASE o_orderkey % 13 " + " ".join(f"WHEN {i} THEN CAST({f} AS STRING)" for i, f in enumerate(_FORMS)) + " END AS date_str FROM orders)"


@query(f"WITH {_STRINGS}, {sql_parsed('s', 'doc_id')} SELECT doc_id, date_str, CAST(date AS STRING) AS date, precision, year FROM p")
def date_parse(spark, sf_dir):
    d = "date_format(o_orderdate, '%s')"
    forms = [d % "yyyy-MM-dd", d % "dd/MM/yyyy", d % "MMMM yyyy", d % "yyyy", f"concat({d % 'yyyy'}, 's')", "'19th century'", "'early 20th century'", "'500 BCE'", f"concat('circa ', {d % 'yyyy'})", f"concat('Spring ', {d % 'yyyy'})", "'31/02/1945'", "'1914-1918'", "'Maybe 1990'"]
    s = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", "CASE o_orderkey % 13 " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms)) + " END AS date_str")
    p = s.withColumn("p", D.parse_date(F.col("date_str")))
    return p.select("doc_id", "date_str", F.col("p.date").cast("string").alias("date"), "p.precision", "p.year")


# The SQL derives each expected date from the order's, not from the string.
_WORDED = ["date_format(o_orderdate, 'd MMM yyyy')", "date_format(o_orderdate, 'MMM. d, yyyy')", "concat('the ', date_format(o_orderdate, 'd'), 'th of ', date_format(o_orderdate, 'MMMM, yyyy'))", "date_format(o_orderdate, 'EEEE, d MMMM yyyy')", "date_format(o_orderdate, 'MM/dd/yyyy')", "date_format(o_orderdate, 'yyyy MMM d')", "'MDCCCXLVIII'", "'Perhaps 1990'", "'31 Feb 1945'"]


@query("""WITH o AS (SELECT o_orderkey AS doc_id, o_orderkey % 9 AS k, CAST(o_orderdate AS DATE) AS d FROM orders),
x AS (SELECT doc_id, k, CASE WHEN k < 4 OR k = 4 AND day(d) > 12 THEN d WHEN k = 4 THEN make_date(year(d), day(d), month(d)) WHEN k = 5 THEN make_date(year(d), 6, 15) WHEN k = 6 THEN DATE '1848-01-01' END AS d FROM o)
SELECT doc_id, CAST(d AS STRING) AS date, CASE WHEN d IS NULL THEN 'unknown' WHEN k = 5 THEN 'year' WHEN k = 4 OR day(d) <> 1 THEN 'day' WHEN month(d) <> 1 THEN 'month' ELSE 'year' END AS precision, CAST(year(d) AS INT) AS year FROM x""")
def date_parse_loose(spark, sf_dir):
    """Dates in words, month-first dates and Roman years, which the patterns leave unknown."""
    s = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", "CASE o_orderkey % 9 " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(_WORDED)) + " END AS date_str")
    p = s.withColumn("p", D.parse_any(F.col("date_str")))
    return p.select("doc_id", F.col("p.date").cast("string").alias("date"), "p.precision", "p.year")


_ALL = " || ".join(f"list_transform(regexp_extract_all(text, {q(D.pattern(i))}), lambda x: {{'k': {i}, 'date_str': x}})" for i in range(len(D.PATTERNS)))
_MENTIONS = f"{C.WITH_HISTORY}, a AS (SELECT doc_id, text, {_ALL} AS a FROM history), b AS (SELECT doc_id, text, unnest(list_transform(a, lambda x: x.date_str)) AS date_str, unnest(range(len(a))) AS pos FROM a), c AS (SELECT doc_id, text, date_str, min(pos) AS pos FROM b GROUP BY ALL), m AS (SELECT doc_id, text, date_str, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS seq FROM c), {sql_parsed('m', 'doc_id, seq, text')}"


@query(_MENTIONS + " SELECT doc_id, CAST(seq AS INT) AS seq, date_str, CAST(date AS STRING) AS date, precision, year FROM p")
def dates_extract(spark, sf_dir):
    return E.date_mentions(C.history(spark, sf_dir)).withColumn("date", F.col("date").cast("string"))


_CONTEXT = "substring(text, greatest(instr(text, date_str) - 1 - 200, 0) + 1, instr(text, date_str) - 1 + length(date_str) + 200 - greatest(instr(text, date_str) - 1 - 200, 0))"
_PIECES = "list_transform(regexp_split_to_array(context, '[.!?]+'), lambda s: regexp_replace(trim(s), '\\s+', ' ', 'g'))"
_EVENTS = _MENTIONS + f", x AS (SELECT *, {_CONTEXT} AS context FROM p), e AS (SELECT *, coalesce(list_filter({_PIECES}, lambda s: contains(s, date_str) AND {sql_any('lower(s)', L.EVENT_KEYWORDS)})[1], concat(trim(substring(context, 1, 200)), '...')) AS description, CASE WHEN year <> 0 THEN CAST(floor(year / 10) * 10 AS INT) END AS decade, CASE WHEN year <> 0 THEN CAST(floor((year - 1) / 100) + 1 AS INT) END AS century, concat(doc_id, '_', seq) AS event_id FROM x)"


def _events(spark, sf_dir):
    return E.events(C.history(spark, sf_dir))


@query(_EVENTS + " SELECT event_id, date_str, description, md5(context) AS context, decade, century FROM e")
def event_context(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", "date_str", "description", F.md5("context").alias("context"), "decade", "century")


_GAZETTEER = "g AS (SELECT n_name AS term, 'historical_locations' AS category FROM nation UNION ALL SELECT r_name, 'region' FROM region)"
_HITS = "t AS (SELECT doc_id, text, lower(text) AS low FROM history), h AS (SELECT doc_id, text, low, lower(term) AS term, CASE category WHEN 'historical_figures' THEN 'PERSON' WHEN 'historical_events' THEN 'EVENT' WHEN 'historical_organizations' THEN 'ORG' WHEN 'historical_locations' THEN 'LOC' ELSE upper(category) END AS label FROM t JOIN g ON contains(low, lower(term))), o AS (SELECT doc_id, substring(text, pos, length(term)) AS entity, label, pos - 1 AS start, pos - 1 + length(term) AS \"end\" FROM (SELECT *, unnest(list_filter(range(1, length(low) - length(term) + 2), lambda i: substring(low, i, length(term)) = term)) AS pos FROM h))"
# spans of these terms overlap only where one name begins another, so the longest at a start is what the greedy choice keeps
_FOUND = f"{_GAZETTEER}, {_HITS}, ge AS (SELECT doc_id, entity, label, start, \"end\" FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, start ORDER BY \"end\" DESC, label) AS r FROM o) WHERE r = 1)"


def _gazetteer(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("term"), F.lit("historical_locations").alias("category"))
    return n.union(table(spark, sf_dir, "region").select("r_name", F.lit("region")))


def _places(spark, sf_dir):
    return N.gazetteer_entities(C.history(spark, sf_dir), _gazetteer(spark, sf_dir))


@query(f"{C.WITH_HISTORY}, {_FOUND} SELECT doc_id, entity, label, CAST(start AS INT) AS start, CAST(\"end\" AS INT) AS \"end\" FROM ge")
def gazetteer_matches(spark, sf_dir):
    return _places(spark, sf_dir).drop("confidence", "source")


def sql_spans(patterns: list[tuple[str, str]]) -> str:
    """Matches with offsets, found by splitting at each match in turn."""
    one = lambda p, label: f"SELECT doc_id, unnest(m) AS entity, '{label}' AS label, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))) AS start FROM (SELECT doc_id, regexp_extract_all(text, {q(p)}) AS m, regexp_split_to_array(text, {q(p)}) AS s FROM history)"
    return " UNION ALL ".join(one(p, label) for p, label in patterns)


_RULES = [(p, "DATE") for p in N.RULE_DATES]


@query(f"{C.WITH_HISTORY} SELECT doc_id, entity, label, CAST(start AS INT) AS start, CAST(start + length(entity) AS INT) AS \"end\" FROM ({sql_spans(_RULES)})")
def rule_dates(spark, sf_dir):
    return N.rule_entities(C.history(spark, sf_dir), _RULES, 0.8).drop("confidence", "source")


@query(f"{C.WITH_HISTORY} SELECT doc_id, entity, label, CAST(start AS INT) AS start, CAST(start + length(entity) AS INT) AS \"end\" FROM ({sql_spans(N.RULE_EVENTS)})")
def rule_events(spark, sf_dir):
    return N.rule_entities(C.history(spark, sf_dir), N.RULE_EVENTS, 0.7).drop("confidence", "source")


@query(f"{C.WITH_HISTORY} SELECT doc_id, entity, label, CAST(start AS INT) AS start, CAST(start + length(entity) AS INT) AS \"end\" FROM ({sql_spans([(N.TITLED, 'PERSON')])})")
def titled_persons(spark, sf_dir):
    return N.rule_entities(C.history(spark, sf_dir), [(N.TITLED, "PERSON")], 0.9).drop("confidence", "source")


def _entities(spark, sf_dir):
    h = C.history(spark, sf_dir)
    rules = N.rule_entities(h, [*[(*r, 0.8) for r in _RULES], *[(*r, 0.7) for r in N.RULE_EVENTS], (N.TITLED, "PERSON", 0.9)])
    return N.valid(rules.unionByName(_places(spark, sf_dir)))


@query()
def entity_resolve(spark, sf_dir):
    return N.resolve(_entities(spark, sf_dir))


@query()
def entity_resolve_compat(spark, sf_dir):
    return N.resolve(_entities(spark, sf_dir), compat=True)


def _recogniser(spark, sf_dir):
    """History, its labelled spans, which of them are places whose names are kept from training, and the model."""
    # every use below would match and resolve all texts again
    h, gold = C.history(spark, sf_dir), stored(N.resolve(_entities(spark, sf_dir)).select("doc_id", "entity", "label", "start", "end"), "spans")
    kept = gold.where((F.col("label") == "LOC") & S.hidden(F.col("entity")))
    known = gold.join(kept.select("doc_id").distinct(), "doc_id", "left_anti")
    return h, gold, kept, S.fit(S.labelled(h, known), ["DATE", "DOCUMENT", "EVENT", "LOC", "PERSON", "REGION"])


@query()
def entity_statistical(spark, sf_dir):
    """What a recogniser finds that learned from gazetteer and rules, but not from documents with hidden names."""
    h, _, _, model = _recogniser(spark, sf_dir)
    return S.recognise(h, model)


@query()
def entity_statistical_evaluation(spark, sf_dir):
    """Exact spans found in the documents with hidden names, by label."""
    h, gold, kept, model = _recogniser(spark, sf_dir)
    unseen = kept.select("doc_id").distinct()
    return S.evaluation(S.recognise(h.join(unseen, "doc_id", "left_semi"), model), gold.join(unseen, "doc_id", "left_semi"))


@query()
def pos_tags(spark, sf_dir):
    """Words with their part of speech; the model is learned from the same texts, without labels."""
    h = C.history(spark, sf_dir)
    return P.tag(h, P.fit(h)).select("doc_id", F.array_join(F.transform("tokens", lambda t: F.concat(t["text"], F.lit("/"), t["pos"])), " ").alias("tagged"))


@query()
def pos_entities(spark, sf_dir):
    """Titles, events and periods by patterns over parts of speech."""
    h = C.history(spark, sf_dir)
    return P.proper_noun_entities(P.tag(h, P.fit(h)))


_EVERY = f"{C.WITH_HISTORY}, {_FOUND}, r AS ({sql_spans([*_RULES, *N.RULE_EVENTS, (N.TITLED, 'PERSON')])}), al AS (SELECT doc_id, entity, label, CAST(start AS INT) AS start, CAST(start + length(entity) AS INT) AS \"end\" FROM r UNION ALL SELECT * FROM ge), en AS (SELECT * FROM al WHERE length(entity) >= 2 AND length(regexp_replace(entity, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 0.5 * length(entity))"


@query(_EVERY + " SELECT doc_id, label, count(*) AS n FROM en GROUP BY ALL")
def entity_counts(spark, sf_dir):
    return _entities(spark, sf_dir).groupBy("doc_id", "label").agg(F.count("*").alias("n"))


@query(_EVERY + ", w AS (SELECT * FROM en) SELECT least(a.label, b.label) AS label_a, greatest(a.label, b.label) AS label_b, count(*) AS n FROM w a JOIN w b ON a.doc_id = b.doc_id AND (b.start > a.start OR (b.start = a.start AND (b.\"end\", b.label, b.entity) > (a.\"end\", a.label, a.entity))) AND b.start - a.\"end\" <= 100 GROUP BY ALL")
def entity_cooccurrence(spark, sf_dir):
    return N.cooccurrence(_entities(spark, sf_dir))


_TOTALS = "n AS (SELECT count(*) AS n, count(DISTINCT entity) AS texts, count(DISTINCT doc_id) AS documents FROM en)"


@query(_EVERY + f", {_TOTALS}, z AS (SELECT concat(entity, ' (', label, ')') AS name, count(*) AS value FROM en GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50) SELECT 'total' AS section, name, round(CAST(value AS DOUBLE), 6) AS value FROM n, (VALUES ('entities', n), ('distinct texts', texts), ('documents', documents), ('entities a document', n / documents)) AS t(name, value) UNION ALL SELECT 'label', label, CAST(count(*) AS DOUBLE) FROM en GROUP BY label UNION ALL SELECT 'node', name, CAST(value AS DOUBLE) FROM z".replace("FROM n, (VALUES ('entities', n), ('distinct texts', texts), ('documents', documents), ('entities a document', n / documents)) AS t(name, value)", "FROM (SELECT unnest(['entities', 'distinct texts', 'documents', 'entities a document']) AS name, unnest([n, texts, documents, n / documents]) AS value FROM n)"))
def entity_network_summary(spark, sf_dir):
    return N.network_summary(_entities(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query(_EVERY + f", o2 AS (SELECT doc_id, count(*) AS n FROM en GROUP BY doc_id) SELECT {sql_period('year')} AS period, count(*) AS documents, CAST(sum(n) AS BIGINT) AS entities FROM o2 JOIN history USING (doc_id) GROUP BY 1")
def entities_by_period(spark, sf_dir):
    periods = C.history(spark, sf_dir).select("doc_id", T.period(F.col("year")).alias("period"))
    return N.by_period(_entities(spark, sf_dir), periods)


@query(_EVERY + ", nd AS (SELECT doc_id, concat(entity, ' (', label, ')') AS node, row_number() OVER (PARTITION BY doc_id ORDER BY start, \"end\", label, entity) AS i FROM en) SELECT least(a.node, b.node) AS node_a, greatest(a.node, b.node) AS node_b, count(*) AS weight FROM nd a JOIN nd b ON a.doc_id = b.doc_id AND a.i < b.i GROUP BY ALL")
def entity_network_edges(spark, sf_dir):
    return N.network_edges(_entities(spark, sf_dir))


@query(_EVERY + " SELECT label, entity, n, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, entity) AS rank FROM (SELECT label, entity, count(*) AS n FROM en GROUP BY ALL)) WHERE rank <= 10")
def entity_top10_by_label(spark, sf_dir):
    return N.top_by_label(_entities(spark, sf_dir))


_CONFIDENCE = "greatest(0.1, least(1.0, 0.5 + CASE WHEN len(regexp_split_to_array(trim(description), '\\s+')) >= 5 THEN 0.2 ELSE 0 END + least(0.3, 0.05 * k) + CASE WHEN contains(lower(date_str), 'century') OR contains(lower(date_str), 'decade') OR contains(lower(date_str), 'circa') THEN -0.1 WHEN regexp_matches(date_str, '[0-9]{4}') THEN 0.1 ELSE 0 END))"


@query(_EVENTS + f", {_FOUND}, kk AS (SELECT event_id, count(*) AS k FROM e JOIN ge USING (doc_id) WHERE contains(lower(context), lower(entity)) GROUP BY event_id), f AS (SELECT e.event_id, description, date_str, least(coalesce(k, 0), 10) AS k FROM e LEFT JOIN kk USING (event_id)) SELECT event_id, CAST(k AS INT) AS n_entities, round(CAST({_CONFIDENCE} AS DOUBLE), 6) AS confidence FROM f")
def event_confidence(spark, sf_dir):
    e = E.events(C.history(spark, sf_dir), _places(spark, sf_dir))
    return e.select("event_id", F.size("entities").alias("n_entities"), F.round("confidence", 6).alias("confidence"))


@query(_EVENTS + " SELECT event_id, date_str, CAST(date AS STRING) AS date, row_number() OVER (ORDER BY date NULLS LAST, doc_id, seq) AS place FROM e ORDER BY place LIMIT 100")
def timeline_first_100(spark, sf_dir):
    """The first hundred events of the timeline: a top-k report."""
    top = E.sorted_events(_events(spark, sf_dir)).limit(100)
    order = E.Window.orderBy(F.col("date").asc_nulls_last(), "doc_id", "seq")
    return top.select("event_id", "date_str", F.col("date").cast("string").alias("date"), F.row_number().over(order).cast("long").alias("place"))


@query(_EVENTS + " SELECT event_id, date_str, CAST(date AS STRING) AS date, precision, year FROM e")
def timeline_sorted(spark, sf_dir):
    # the sort looks at its input twice, to find its ranges and to deal: the texts are read once
    e = stored(_events(spark, sf_dir).select("doc_id", "seq", "event_id", "date_str", "date", "precision", "year"), "events")
    return E.sorted_events(e).select("event_id", "date_str", F.col("date").cast("string").alias("date"), "precision", "year")


@query(_MENTIONS + " SELECT year, CAST(count(*) AS DOUBLE) AS density FROM p WHERE year <> 0 GROUP BY year")
def timeline_density(spark, sf_dir):
    return E.density(E.date_mentions(C.history(spark, sf_dir)))


@query(_MENTIONS + " SELECT coalesce(min(year) FILTER (year <> 0), 1900) AS first_year, coalesce(max(year) FILTER (year <> 0), 2000) AS last_year FROM p")
def timeline_range(spark, sf_dir):
    return E.year_range(E.date_mentions(C.history(spark, sf_dir)))


@query(_MENTIONS + " SELECT CAST(floor((year - 1) / 100) + 1 AS INT) AS century, count(*) AS n FROM p WHERE year <> 0 GROUP BY 1")
def events_by_century(spark, sf_dir):
    return E.date_mentions(C.history(spark, sf_dir)).where("year != 0").groupBy(D.century(F.col("year")).alias("century")).agg(F.count("*").alias("n"))


_SMALL = "b AS (SELECT o_orderkey AS event_id, CAST(1800 + (o_orderkey * 13) % 200 AS INT) AS year, concat('The war of ', c_mktsegment, ' began in ', o_orderpriority) AS description FROM orders JOIN customer ON o_custkey = c_custkey), w AS (SELECT year, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(description), '\\s+'), lambda x: x <> ''))) AS words, min(CAST(event_id AS STRING)) AS event_id FROM b GROUP BY ALL)"
_YEARS = "CASE WHEN abs(a.year - b.year) <= 1 THEN 0.4 WHEN abs(a.year - b.year) <= 5 THEN 0.2 WHEN abs(a.year - b.year) <= 10 THEN 0.1 ELSE 0 END"


def _short_events(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    e = o.join(c, o.o_custkey == c.c_custkey).selectExpr("CAST(o_orderkey AS STRING) AS event_id", "o_orderkey AS doc_id", "CAST(1800 + (o_orderkey * 13) % 200 AS INT) AS year", "concat('The war of ', c_mktsegment, ' began in ', o_orderpriority) AS description")
    return e.withColumn("entities", F.array().cast("array<struct<entity:string,label:string>>"))


@query(f"WITH {_SMALL}, s AS (SELECT a.event_id AS a, b.event_id AS b, {_YEARS} + 0.4 * len(list_intersect(a.words, b.words)) / len(list_distinct(a.words || b.words)) AS similarity FROM w a JOIN w b ON a.event_id < b.event_id AND abs(a.year - b.year) <= 10) SELECT a, b, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.65")
def event_similarity_pairs(spark, sf_dir):
    return E.similarity_pairs(_short_events(spark, sf_dir), threshold=0.65).withColumn("similarity", F.round("similarity", 6))


@query()
def timeline_merged(spark, sf_dir):
    e = _short_events(spark, sf_dir).withColumn("date", F.lit(None).cast("date")).withColumn("precision", F.lit("year")).withColumn("confidence", F.lit(0.7))
    return E.merged(e)
