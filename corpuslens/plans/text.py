"""Queries over metadata, cleaning, tokens and feature families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..operators import boundaries as B
from ..operators import cleaning
from ..operators import features as X
from ..operators import ml as M
from ..operators import similar as S
from . import corpora as C
from .registry import query, table


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sub(expr: str, pattern: str, to: str) -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(to.replace('$', chr(92)))}, 'g')"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def sql_clean_patterns(expr: str) -> str:
    for p, to in T.UNWANTED:
        expr = _sub(expr, p, to) if to != "\n" else f"regexp_replace({expr}, {q(p)}, chr(10), 'g')"
    return expr


def sql_ocr(expr: str) -> str:
    for p, to, times in T.OCR:
        for _ in range(times):
            expr = _sub(expr, p, to)
    return expr


def sql_whitespace(expr: str) -> str:
    line = _sub("x", T.SPACE + "+", " ")
    return f"coalesce(array_to_string(list_filter(list_transform(string_split({expr}, chr(10)), lambda x: trim({line})), lambda x: x <> ''), chr(10)), '')"


def sql_words(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), {q(T.WORD)})"


def sql_sentences(expr: str) -> str:
    for a in L.ABBREVIATIONS:
        expr = f"replace({expr}, {q(f' {a} ')}, replace({q(f' {a} ')}, '.', chr(2)))"
    marked = f"regexp_replace({expr}, {q(r'([.!?]+[\"' + chr(39) + r')]*)' + T.SPACE + '+')}, '\\1' || chr(31), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(31)), lambda s: replace(trim({_sub('s', T.SPACE + '+', ' ')}), chr(2), '.')), lambda s: s <> '')"


@query("SELECT doc_id, length(text) AS character_count, CAST(len(regexp_extract_all(text, " + q(T.NOT_SPACE + "+") + ")) AS INT) AS word_count, md5(text) AS text_hash, substring(md5(concat(source, '_', CAST(n_chars AS STRING))), 1, 12) AS document_id FROM documents")
def doc_metadata(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.length("text").alias("character_count"), F.size(F.regexp_extract_all("text", F.lit(T.NOT_SPACE + "+"), F.lit(0))).alias("word_count"), F.md5("text").alias("text_hash"), F.substring(F.md5(F.concat("source", F.lit("_"), F.col("n_chars").cast("string"))), 1, 12).alias("document_id"))


@query(C.WITH_HISTORY + f" SELECT doc_id, CAST(nullif(regexp_extract(substring(text, 1, 2000), {q(T.YEAR)}, 1), '') AS INT) AS found_year FROM history")
def doc_year(spark, sf_dir):
    return C.history(spark, sf_dir).select("doc_id", T.first_year(F.col("text")).alias("found_year"))


def sql_period(year: str) -> str:
    return f"CASE WHEN {year} IS NULL THEN NULL " + " ".join(f"WHEN {year} < {y} THEN '{n}'" for y, n in L.PERIODS) + f" ELSE '{L.LAST_PERIOD}' END"


@query(C.WITH_HISTORY + f" SELECT doc_id, year, {sql_period('year')} AS period FROM history")
def doc_period_case(spark, sf_dir):
    return C.history(spark, sf_dir).select("doc_id", "year", T.period(F.col("year")).alias("period"))


def sql_any(text: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"


def sql_source_type(text: str) -> str:
    return "CASE " + " ".join(f"WHEN {sql_any(f'lower({text})', terms)} THEN '{name}'" for name, terms in L.SOURCE_TYPES) + f" ELSE '{L.OTHER_SOURCE}' END"


@query(C.WITH_HISTORY + f" SELECT doc_id, {sql_source_type('text')} AS source_type FROM history")
def doc_source_type(spark, sf_dir):
    return C.history(spark, sf_dir).select("doc_id", T.source_type(F.col("text")).alias("source_type"))


AUTHOR = [r"by[ \n\t]+([A-Z][a-z]+(?:[ \n\t]+[A-Z][a-z]+)+)", r"Author:[ \n\t]*([^\n]+)", r"Written by[ \n\t]*([^\n]+)"]


@query("WITH t AS (SELECT o_orderkey AS doc_id, concat('A report. Written by John Smith', CASE WHEN o_orderkey % 2 = 0 THEN chr(10) ELSE ' ' END, 'Author: ', o_orderpriority, chr(10)) AS text FROM orders) SELECT doc_id, trim(coalesce(" + ", ".join(f"nullif(regexp_extract(substring(text, 1, 2000), {q(p)}, 1), '')" for p in AUTHOR) + ")) AS author FROM t")
def doc_author(spark, sf_dir):
    t = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", "concat('A report. Written by John Smith', CASE WHEN o_orderkey % 2 = 0 THEN chr(10) ELSE ' ' END, 'Author: ', o_orderpriority, chr(10)) AS text")
    found = [F.nullif(F.regexp_extract(F.substring("text", 1, 2000), p, 1), F.lit("")) for p in AUTHOR]
    return t.select("doc_id", F.trim(F.coalesce(*found)).alias("author"))


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{{4,}}') AS a FROM documents),
e AS (SELECT doc_id, unnest(a) AS word, unnest(range(len(a))) AS pos FROM w),
c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first FROM e WHERE word NOT IN ({', '.join(q(w) for w in L.KEYWORD_STOP_WORDS)}) GROUP BY ALL)
SELECT doc_id, word, n, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM c) WHERE rank <= 10""")
def doc_keywords_top10(spark, sf_dir):
    return keywords(_docs(spark, sf_dir), 10)


def keywords(docs: DataFrame, k: int) -> DataFrame:
    e = docs.select("doc_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("pos", "word")).where(~F.col("word").isin(L.KEYWORD_STOP_WORDS))
    c = e.groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "first"))).where(F.col("rank") <= k).select("doc_id", "word", "n", "rank")


@query(f"SELECT doc_id, md5({sql_clean_patterns('text')}) AS cleaned, CAST(length({sql_clean_patterns('text')}) AS INT) AS n FROM documents")
def clean_patterns(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.remove_unwanted(F.col("text")).alias("t")).select("doc_id", F.md5("t").alias("cleaned"), F.length("t").alias("n"))


@query(f"SELECT doc_id, md5({sql_ocr('text')}) AS fixed FROM documents")
def clean_ocr(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.fix_ocr(F.col("text"))).alias("fixed"))


@query(f"SELECT doc_id, md5({sql_whitespace('text')}) AS normalized FROM documents")
def clean_whitespace(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.normalize_whitespace(F.col("text"))).alias("normalized"))


@query("SELECT doc_id, md5(replace(translate(replace(replace(text, '.', '…'), '\"', '“'), '“”«»‘’–—―', '\"\"\"\"''''---'), '…', '...')) AS plain FROM documents")
def clean_typography(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.replace(F.replace("text", F.lit("."), F.lit("…")), F.lit('"'), F.lit("“")).alias("t"))
    return d.select("doc_id", F.md5(T.typography(F.col("t"))).alias("plain"))


_FULL = sql_whitespace(sql_ocr(sql_clean_patterns("text")))


@query(f"WITH c AS (SELECT doc_id, text, trim({_FULL}) AS t FROM documents) SELECT doc_id, CAST(length(text) AS INT) AS original_length, CAST(length(t) AS INT) AS cleaned_length, CASE WHEN length(text) > 0 THEN round((length(text) - length(t)) * 100.0 / length(text), 6) END AS reduction FROM c")
def clean_stats(spark, sf_dir):
    c = _docs(spark, sf_dir).select("doc_id", F.length("text").alias("original_length"), F.length(F.trim(T.normalize_whitespace(T.fix_ocr(T.remove_unwanted(F.col("text")))))).alias("cleaned_length"))
    return c.select("doc_id", "original_length", "cleaned_length", F.round(F.try_divide((F.col("original_length") - F.col("cleaned_length")) * 100.0, "original_length"), 6).alias("reduction"))


@query(r"SELECT doc_id, coalesce(length(trim(text)) >= 100 AND length(text) - length(regexp_replace(text, '[^\x00-\x08\x0e-\x1b\x7f-\x{84}\x{86}-\x{9f}]', '', 'g')) > 0.9 * length(text), false) AS valid FROM documents")
def valid_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.coalesce(T.valid_text(F.col("text")), F.lit(False)).alias("valid"))


HTML_DROPS = [r"(?is)<(script|style|header|footer|nav)[^>]*>.*?</(script|style|header|footer|nav)[ \t\n\r]*>", r"(?s)<!--.*?-->", r"<[^>]*>"]


@query("WITH t AS (SELECT page_id, " + _sub(_sub(_sub("html", HTML_DROPS[0], chr(10)), HTML_DROPS[1], chr(10)), HTML_DROPS[2], chr(10)).replace("'\n'", "chr(10)") + f" AS t FROM pages) SELECT page_id, md5({sql_whitespace('t')}) AS body FROM t")
def html_to_text(spark, sf_dir):
    t = F.col("html")
    for p in HTML_DROPS:
        t = F.regexp_replace(t, p, "\n")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.normalize_whitespace(t)).alias("body"))


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(text, {q(T.TOKEN)})) AS INT) AS n_tokens, md5(coalesce(array_to_string(regexp_extract_all(text, {q(T.TOKEN)}), ' '), '')) AS tokens FROM documents")
def tokens_regex(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens"))


@query(C.WITH_HISTORY + f", s AS (SELECT doc_id, {sql_sentences('text')} AS s FROM history) SELECT doc_id, unnest(s) AS sentence, CAST(unnest(range(len(s))) AS INT) AS pos FROM s")
def sentences_split(spark, sf_dir):
    return C.history(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


@query(f"WITH t AS (SELECT doc_id, regexp_extract_all(text, {q(T.TOKEN)}) AS t, {sql_sentences('text')} AS s FROM documents) SELECT doc_id, CAST(len(t) AS INT) AS n_tokens, CAST(len(s) AS INT) AS n_sentences, CAST(len(list_distinct(t)) AS INT) AS n_unique, CASE WHEN len(s) > 0 THEN round(len(t) / len(s), 6) END AS avg_sentence FROM t")
def token_stats(spark, sf_dir):
    t = _docs(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("t"), F.size(T.sentences(F.col("text"))).alias("n_sentences"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), "n_sentences", F.size(F.array_distinct("t")).alias("n_unique"), F.round(F.try_divide(F.size("t"), "n_sentences"), 6).alias("avg_sentence"))


def sql_map(table_: dict[str, str], x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table_.items()) + f" ELSE {x} END"


@query("""WITH t AS (SELECT o_orderkey AS doc_id, concat('We don''t analyse the colour I''ve seen; he''s here, ', lower(o_orderpriority), ' centre programme') AS text FROM orders),
n AS (SELECT doc_id, regexp_extract_all(text, """ + q(T.TOKEN) + """) AS a FROM t),
m AS (SELECT doc_id, len(a) AS before, list_filter(list_transform(list_transform(list_transform(a, lambda x: lower(x)), lambda x: """ + sql_map(L.CONTRACTIONS, "x") + "), lambda x: " + sql_map(L.SPELLINGS, "x") + """), lambda x: length(trim(x)) >= 2) AS k FROM n)
SELECT doc_id, array_to_string(k, '|') AS normalized, round((before - len(k)) * 100.0 / before, 6) AS reduction FROM m""")
def normalize_tokens(spark, sf_dir):
    t = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", "concat(\"We don't analyse the colour I've seen; he's here, \", lower(o_orderpriority), ' centre programme') AS text")
    n = t.select("doc_id", T.tokens(F.col("text")).alias("a")).withColumn("k", T.normalized_tokens(F.col("a"), lemmatize=False))
    return n.select("doc_id", F.array_join("k", "|").alias("normalized"), F.round(F.try_divide((F.size("a") - F.size("k")) * F.lit(100.0), F.size("a")), 6).alias("reduction"))


@query(f"""WITH w AS (SELECT doc_id, {sql_words('text')} AS w, len({sql_sentences('text')}) AS s FROM documents)
SELECT doc_id, CAST(len(w) AS INT) AS n_words, CAST(s AS INT) AS n_sentences, round(CASE WHEN s > 0 THEN len(w) / s ELSE 0 END, 6) AS avg_sentence_length,
round(CASE WHEN len(w) > 0 THEN length(array_to_string(w, '')) / len(w) ELSE 0 END, 6) AS avg_word_length, CAST(len(list_distinct(w)) AS INT) AS vocabulary, round(CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) ELSE 0 END, 6) AS ttr FROM w""")
def doc_basic_stats(spark, sf_dir):
    s = X.basic_stats(_docs(spark, sf_dir))
    return s.select("doc_id", "n_words", "n_sentences", F.round("avg_sentence_length", 6).alias("avg_sentence_length"), F.round("avg_word_length", 6).alias("avg_word_length"), "vocabulary", F.round("ttr", 6).alias("ttr"))


def sql_content_words(text: str) -> str:
    return f"[w FOR w IN {sql_words(text)} IF w NOT IN ({', '.join(q(w) for w in L.STOP_WORDS)})]"


def _counts_sql(max_n: int) -> str:
    grams = ["w"] + [f"list_transform(range(1, greatest(len(w) - {n - 2}, 1)), lambda i: array_to_string(w[i:i + {n - 1}], ' '))" for n in range(2, max_n + 1)]
    return f"d AS (SELECT doc_id, {sql_content_words('text')} AS w FROM documents), e AS (SELECT doc_id, unnest({' || '.join(grams)}) AS term FROM d), tf AS (SELECT doc_id, term, count(*) AS tf FROM e GROUP BY ALL)"


def _vocabulary_sql(features: int, max_df: float) -> str:
    return f"v AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term HAVING count(*) >= 2 AND count(*) <= {max_df} * (SELECT count(*) FROM documents) ORDER BY total DESC, term LIMIT {features})"


@query(f"WITH {_counts_sql(2)}, {_vocabulary_sql(3000, 0.98)} SELECT doc_id, term, tf FROM tf JOIN v USING (term)")
def bow_doc_term(spark, sf_dir):
    return X.bag_of_words(_docs(spark, sf_dir))


_TFIDF = f"WITH {_counts_sql(3)}, {_vocabulary_sql(5000, 0.95)}, r AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS raw FROM tf JOIN v USING (term)), x AS (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM r)"


@query(_TFIDF + " SELECT doc_id, term, round(weight, 6) AS weight FROM x")
def tfidf_weights(spark, sf_dir):
    return X.tfidf(_docs(spark, sf_dir), max_n=3).withColumn("weight", F.round("weight", 6))


@query(_TFIDF + " SELECT doc_id, term, round(weight, 6) AS weight, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term) AS rank FROM x) WHERE rank <= 20")
def tfidf_top20(spark, sf_dir):
    return X.tfidf(_docs(spark, sf_dir), max_n=3, top=20).withColumn("weight", F.round("weight", 6))


_SIMILAR = f"""WITH {_counts_sql(1)}, {_vocabulary_sql(5000, 0.95)}, r AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS raw FROM tf JOIN v USING (term)),
x AS (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM r)
SELECT q.doc_id AS a, x.doc_id AS b, round(sum(q.weight * x.weight), 5) AS cosine FROM x q JOIN x USING (term) WHERE q.doc_id % 100 = 0 AND x.doc_id <> q.doc_id GROUP BY ALL"""


@query(_SIMILAR)
def tfidf_similarity(spark, sf_dir):
    """Documents whose id is divisible by 100 against all, over all shared terms."""
    d = _docs(spark, sf_dir)
    return X.cosine_pairs(X.tfidf_vectors(d), d.where("doc_id % 100 = 0"), digits=5)


_LINKED = f"""{_SIMILAR[: _SIMILAR.index("SELECT q.doc_id AS a")].rstrip()}, m AS (SELECT doc_id, md5(string_agg(concat(term, ' ', CAST(round(weight * 1e9) AS BIGINT)), '|' ORDER BY term)) AS mark FROM x GROUP BY doc_id),
k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY mark) AS class_id FROM m), l AS (SELECT q.doc_id, x.doc_id AS other FROM x q JOIN x USING (term) WHERE x.doc_id <> q.doc_id GROUP BY ALL HAVING round(sum(q.weight * x.weight), 9) >= 0.8),
n AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id) SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(n, 0) AS n_links FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)"""


@query(_LINKED)
def tfidf_similar_all(spark, sf_dir):
    """All documents against all: how many others have a cosine of 0.8 or more."""
    d = _docs(spark, sf_dir)
    return S.links(S.similar(X.tfidf_vectors(d), pairs=False), d)


@query(C.WITH_HISTORY + f""", r AS (SELECT doc_id, regexp_extract_all(text, {q(X.TEMPORAL[0][0])}, 1) || regexp_extract_all(text, {q(X.TEMPORAL[1][0])}, 1) || regexp_extract_all(text, {q(X.TEMPORAL[2][0])}, 0) AS r, len({sql_words('text')}) AS n FROM history)
SELECT doc_id, CAST(len(r) AS INT) AS n_references, coalesce(array_to_string(list_sort(list_distinct(r))[1:20], '|'), '') AS terms, round(len(r) / n, 6) AS density FROM r""")
def temporal_features(spark, sf_dir):
    return X.temporal(C.history(spark, sf_dir)).withColumn("density", F.round("density", 6))


@query(f"""WITH t AS (SELECT doc_id, substring(text, 1, 10000) AS t FROM documents),
w AS (SELECT doc_id, {sql_words('t')} AS w, greatest(len({sql_sentences('t')}), 1) AS s FROM t),
y AS (SELECT doc_id, s, len(w) AS n, length(array_to_string(w, '')) AS letters, list_transform(w, lambda x: greatest(len(regexp_extract_all(x, '[aeiouyáéíóúàèêëïôûüöä]+')), 1)) AS syl FROM w),
c AS (SELECT doc_id, s, n, letters, list_sum(syl) AS syllables, len(list_filter(syl, lambda x: x >= 3)) AS hard, list_sum(list_transform(syl[1:100], lambda x: CASE WHEN x < 3 THEN 1 ELSE 3 END)) / greatest(1.0, s * (least(n, 100) / n)) AS li FROM y),
g AS (SELECT doc_id,  round(206.835 - 1.015 * n / s - 84.6 * syllables / n + 1e-9, 5) AS flesch, round(0.39 * n / s + 11.8 * syllables / n - 15.59 + 1e-9, 5) AS kincaid, round(0.4 * (n / s + 100 * (hard / n)) + 1e-9, 5) AS fog,
round(CASE WHEN n > 0 THEN 1.043 * sqrt(30.0 * (hard / s)) + 3.1291 END + 1e-9, 5) AS smog, round(4.71 * (letters / n) + 0.5 * (n / s) - 21.43 + 1e-9, 5) AS ari, round(5.89 * (letters / n) - 29.6 * (s / n) - 15.8 + 1e-9, 5) AS coleman_liau, round(CASE WHEN n > 0 THEN CASE WHEN li > 20 THEN li / 2 ELSE (li - 2) / 2 END END + 1e-9, 5) AS linsear_write, round(0.1579 * (hard / n * 100) + 0.0496 * n / s + CASE WHEN hard / n * 100 > 5 THEN 3.6365 ELSE 0 END + 1e-9, 5) AS dale_chall FROM c),
m AS (SELECT doc_id, min(grade) AS consensus FROM (SELECT *, rank() OVER (PARTITION BY doc_id ORDER BY n DESC) AS r FROM (SELECT doc_id, grade, count(*) AS n FROM (SELECT doc_id, unnest([CAST(round(x) AS INT) FOR x IN [kincaid, fog, smog, ari, coleman_liau, linsear_write, dale_chall]]) AS grade FROM g) WHERE grade IS NOT NULL GROUP BY ALL)) WHERE r = 1 GROUP BY doc_id)
SELECT g.*, consensus FROM g LEFT JOIN m USING (doc_id)""")
def readability_scores(spark, sf_dir):
    s = X.readability(_docs(spark, sf_dir))
    return s.select("doc_id", *[F.round(F.col(c) + 1e-9, 5).alias(c) for c in s.columns if c not in ("doc_id", "consensus")], "consensus")


_VALENCE = "CASE w " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in L.VALENCES.items()) + " ELSE 0.0 END"


def sql_valences(words: str) -> str:
    """The rule word by word: each of the three words before, nearest first, adds to the strength, then may negate it."""
    among = lambda xs: "(" + ", ".join(q(x) for x in xs) + ")"
    v = f"CAST({_VALENCE} AS DOUBLE)"
    for back, damping in enumerate(L.DAMPING, 1):
        before = f"CASE WHEN i > {back} THEN {words}[i - {back}] ELSE '' END"
        v = f"list_transform([{v}], lambda v: (v + sign(v) * CASE WHEN {before} IN {among(L.BOOSTERS)} THEN {L.BOOST * damping} WHEN {before} IN {among(L.DAMPENERS)} THEN {-L.BOOST * damping} ELSE 0 END) * CASE WHEN {before} IN {among(L.NEGATIONS)} THEN {L.NEGATION} ELSE 1 END)[1]"
    return f"list_transform({words}, lambda w, i: {v})"


def sql_sum(x: str) -> str:
    return f"CAST(coalesce(list_sum({x}), 0) AS DOUBLE)"


@query(C.WITH_HISTORY + f""", w AS (SELECT doc_id, {sql_words('text')} AS w, list_transform({sql_sentences('text')}[1:100], lambda x: {sql_words('x')}) AS s FROM history),
v AS (SELECT doc_id, {sql_valences('w.w')} AS v FROM w),
d AS (SELECT doc_id, {sql_sum('v')} AS total FROM v),
u AS (SELECT doc_id, unnest(s) AS ws FROM w),
z AS (SELECT doc_id, {sql_valences('ws')} AS v FROM u),
y AS (SELECT doc_id, {sql_sum('v')} AS total, {sql_sum('[x + 1 FOR x IN v IF x > 0]')} AS p, {sql_sum('[1 - x FOR x IN v IF x < 0]')} AS n, len([x FOR x IN v IF x = 0]) AS neutral FROM z),
g AS (SELECT doc_id, avg(total / sqrt(total * total + 15)) AS mean_compound, var_pop(total / sqrt(total * total + 15)) AS variance, avg(coalesce(p / nullif(p + n + neutral, 0), 0)) AS pos, avg(coalesce(n / nullif(p + n + neutral, 0), 0)) AS neg FROM y GROUP BY doc_id)
SELECT doc_id, round(total / sqrt(total * total + 15), 6) AS compound, CASE WHEN total / sqrt(total * total + 15) > 0.05 THEN 'positive' WHEN total / sqrt(total * total + 15) < -0.05 THEN 'negative' ELSE 'neutral' END AS label,
round(mean_compound, 6) AS mean_compound, round(sqrt(variance), 6) AS std_compound, round(variance, 6) AS sentiment_variance, round(pos, 6) AS mean_pos, round(neg, 6) AS mean_neg FROM d LEFT JOIN g USING (doc_id)""")
def sentiment_label(spark, sf_dir):
    s = X.sentiment(C.history(spark, sf_dir)).drop("pos_neg_ratio")  # up to 1e10, so it doesn't round alike
    return s.select("doc_id", "label", *[F.round(c, 6).alias(c) for c in s.columns if c not in ("doc_id", "label")])


@query(f"WITH w AS (SELECT {sql_words('text')} AS w, len({sql_sentences('text')}) AS s FROM documents) SELECT count(*) AS document_count, CAST(sum(len(w)) AS BIGINT) AS total_words, CAST(sum(s) AS BIGINT) AS total_sentences, round(avg(len(w)), 6) AS average_document_length, (SELECT count(DISTINCT x) FROM (SELECT unnest(w) AS x FROM w)) AS vocabulary_size FROM w")
def corpus_metrics(spark, sf_dir):
    w = _docs(spark, sf_dir).select(T.words(F.col("text")).alias("w"), F.size(T.sentences(F.col("text"))).alias("s"))
    totals = w.agg(F.count("*").alias("document_count"), F.sum(F.size("w")).alias("total_words"), F.sum("s").alias("total_sentences"), F.round(F.avg(F.size("w")), 6).alias("average_document_length"))
    return totals.crossJoin(w.select(F.explode("w").alias("x")).agg(F.countDistinct("x").alias("vocabulary_size")))


@query(C.WITH_HISTORY + f" SELECT {sql_period('year')} AS period, count(*) AS n FROM history GROUP BY 1")
def period_distribution(spark, sf_dir):
    return C.history(spark, sf_dir).groupBy(T.period(F.col("year")).alias("period")).agg(F.count("*").alias("n"))


@query(C.WITH_HISTORY + f", t AS (SELECT {sql_source_type('text')} AS source_type, {sql_period('year')} AS period FROM history) SELECT source_type, period, count(*) AS n FROM t GROUP BY ROLLUP (source_type, period)")
def source_distribution(spark, sf_dir):
    t = C.history(spark, sf_dir).select(T.source_type(F.col("text")).alias("source_type"), T.period(F.col("year")).alias("period"))
    return t.rollup("source_type", "period").agg(F.count("*").alias("n"))


@query("WITH p AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS c FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) SELECT query, neighbour, round(c, 6) AS cosine, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(c, 9) DESC, neighbour) AS rank FROM p) WHERE rank <= 3")
def embedding_cosine_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return X.cosine_topk(v, v.where("vec_id % 100 = 0")).withColumn("cosine", F.round("cosine", 6))


@query("WITH d AS (SELECT a.vec_id AS i, a.label AS l, b.label AS m, avg(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY ALL), p AS (SELECT i, l, min(d) FILTER (l = m) AS a, min(d) FILTER (l <> m) AS b FROM d GROUP BY ALL) SELECT l AS label, count(*) AS n, round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM p GROUP BY l")
def silhouette_by_label(spark, sf_dir):
    return X.silhouette(table(spark, sf_dir, "embeddings")).withColumn("silhouette", F.round("silhouette", 6))


@query("WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), c AS (SELECT label, p, avg(c) AS m FROM (SELECT label, unnest(x) AS c, unnest(range(len(x))) AS p FROM v) GROUP BY ALL), m AS (SELECT label, list(m ORDER BY p) AS m FROM c GROUP BY label), d AS (SELECT vec_id, v.label, m.label AS other, list_distance(x, m) AS d FROM v CROSS JOIN m), s AS (SELECT vec_id, label, min(d) FILTER (label = other) AS a, min(d) FILTER (label <> other) AS b FROM d GROUP BY ALL) SELECT label, count(*) AS n, round(avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)), 6) AS silhouette FROM s GROUP BY label")
def silhouette_simplified(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector")
    return M.simplified_silhouette(v, id_col="vec_id", label_col="label").withColumn("silhouette", F.round("silhouette", 6))


@query()
def clean_protected(spark, sf_dir):
    return cleaning.cleaned(C.history(spark, sf_dir))


#: The dated texts with three words cut short, which the fixed list doesn't have.
_SHORT = "replace(replace(replace(text, 'Battle of', 'Batt. of'), 'Congress of', 'Congr. of'), 'Parliament held', 'Parl. held')"
_TOKENS = (
    f"{C.WITH_HISTORY}, d AS (SELECT doc_id, regexp_extract_all({_SHORT}, {q(T.NOT_SPACE + '+')}) AS own FROM history), e AS (SELECT doc_id, unnest(own) AS token, unnest(range(len(own))) AS p, unnest(list_concat([NULL], own[:len(own) - 1])) AS last, unnest(list_concat(own[2:], [NULL])) AS next FROM d),"
    f" f AS (SELECT {_sub('token', B.EDGES, '')} AS core, last, {_sub('next', B.EDGES, '')} AS next FROM e),"
    f" w AS (SELECT lower(regexp_replace(core, '\\.$', '')) AS type, core LIKE '%.' AS period, regexp_matches(core, '^\\p{{Ll}}') AS low, coalesce(regexp_matches(core, '^\\p{{Lu}}') AND NOT regexp_matches(last, {q(B.END)}), false) AS inside, lower(regexp_replace(next, '\\.$', '')) AS next_type, regexp_matches(next, '^[\\p{{Ll}}0-9]') AS goes FROM f WHERE regexp_matches(core, {q(B.WORD)})),"
    " c AS (SELECT type, count(*) AS n, count(*) FILTER (period) AS n_period, count(*) FILTER (inside) AS n_inside FROM w GROUP BY type), p AS (SELECT sum(n_period) / sum(n) AS p FROM c),"
    " g AS (SELECT w.type, count(*) FILTER (goes OR coalesce(n_inside, 0) > 0) AS n_continued FROM w LEFT JOIN c ON next_type = c.type WHERE period AND next_type IS NOT NULL GROUP BY w.type),"
    " z AS (SELECT c.*, coalesce(n_continued, 0) AS n_continued, n - n_period AS bare, length(replace(c.type, '.', '')) AS letters, p FROM c LEFT JOIN g USING (type), p WHERE n_period > 0)"
)


@query(_TOKENS + f" SELECT type, n, n_period, n_continued, round(2 * (n_period * ln({B.CERTAIN}) + bare * ln(1 - {B.CERTAIN}) - n_period * ln(p) - bare * ln(1 - p)) * exp(-letters) * (length(type) - letters + 1) * pow(letters, -CAST(bare AS DOUBLE)), 6) AS score FROM z")
def abbreviation_scores(spark, sf_dir):
    """Words with a period: how surely it is theirs, and how often a sentence goes on behind it."""
    words = B.tokens(C.history(spark, sf_dir).selectExpr(f"{_SHORT} AS text"))
    return B.scores(words, B.type_counts(words)).select("type", "n", "n_period", "n_continued", F.round("score", 6).alias("score"))


@query()
def sentences_learned(spark, sf_dir):
    """Sentences of the shortened texts by boundaries learned from them."""
    d = C.history(spark, sf_dir).selectExpr("doc_id", f"{_SHORT} AS text")
    s = B.sentences(F.col("text"), B.learn(d))
    return d.select("doc_id", F.size(s).alias("n_sentences"), F.array_join(s, "\n").alias("sentences"))
