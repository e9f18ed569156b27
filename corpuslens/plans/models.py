"""Queries over summaries and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..operators import compare as K
from ..operators import embeddings as B
from ..operators import manifold as N
from ..operators import ml as M
from ..operators import summaries as Z
from ..operators import valence as V
from . import corpora as C
from .registry import query, table
from .text import sql_content_words, sql_sentences, sql_words

_ROWS = f"{C.WITH_HISTORY}, s AS (SELECT doc_id, {sql_sentences('text')} AS s FROM history), r AS (SELECT doc_id, unnest(s) AS sentence, unnest(range(len(s))) AS pos, len(s) AS n FROM s)"
_TFIDF = (
    _ROWS + f", w AS (SELECT doc_id, pos, n, {sql_content_words('sentence')} AS w FROM r), g AS (SELECT doc_id, pos, n, unnest(w || list_transform(range(1, greatest(len(w), 1)), lambda i: array_to_string(w[i:i + 1], ' '))) AS term FROM w),"
    " tf AS (SELECT doc_id, pos, n, term, count(*) AS tf FROM g GROUP BY ALL), df AS (SELECT *, count(*) OVER (PARTITION BY doc_id, term) AS df FROM tf), raw AS (SELECT doc_id, pos, tf * (ln((1 + n) / (1 + df)) + 1) AS raw FROM df),"
    " sc AS (SELECT doc_id, pos, sum(raw) / sqrt(sum(raw * raw)) AS score FROM raw GROUP BY ALL), x AS (SELECT r.*, coalesce(score, 0) AS score FROM r LEFT JOIN sc USING (doc_id, pos)),"
    " ch AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, pos) <= CASE WHEN n <= 3 THEN n ELSE greatest(3, least(10, CAST(floor(n * 0.3) AS INT))) END AS chosen FROM x)"
)


@query(_TFIDF + " SELECT doc_id, string_agg(sentence, ' ' ORDER BY pos) FILTER (chosen) AS summary, max(n) AS n_sentences, count(*) FILTER (chosen) AS n_chosen, round(count(*) FILTER (chosen) / max(n), 6) AS ratio FROM ch GROUP BY doc_id")
def summary_tfidf(spark, sf_dir):
    return Z.tfidf_summaries(C.history(spark, sf_dir)).withColumn("ratio", F.round("ratio", 6))


@query(_TFIDF + " SELECT doc_id, CAST(pos AS INT) AS pos, CASE WHEN list_contains((SELECT list(c.sentence) FROM ch c WHERE c.doc_id = ch.doc_id AND c.chosen), sentence) THEN 1.0 ELSE 0.0 END AS score FROM ch".replace("(SELECT list(c.sentence) FROM ch c WHERE c.doc_id = ch.doc_id AND c.chosen)", "list(sentence) FILTER (chosen) OVER (PARTITION BY doc_id)").replace("1.0 ELSE 0.0", "CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE)"))
def summary_scores(spark, sf_dir):
    """1 for every sentence whose text is in the summary, copies of a chosen one included."""
    c = Z.tfidf_scores(C.history(spark, sf_dir))
    own = F.collect_set(F.when(F.col("chosen"), F.col("sentence"))).over(K.Window.partitionBy("doc_id"))
    return c.select("doc_id", "pos", F.when(F.array_contains(own, F.col("sentence")), 1.0).otherwise(0.0).alias("score"))


_PAIRS = "p AS (SELECT a.conv_id, a.turn, a.text AS candidate, b.text AS reference FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"
_KEY = ("conv_id", "turn")


def _pairs(spark, sf_dir):
    """Each turn beside the next one of its conversation, known by (conv_id, turn)."""
    c = table(spark, sf_dir, "conversations")
    a, b = c.select("conv_id", "turn", F.col("text").alias("candidate")), c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference"))
    return a.join(b, ["conv_id", "turn"])


def _rouge(n: int) -> str:
    gram = lambda c: sql_words(c) if n == 1 else f"list_transform(range(1, greatest(len({sql_words(c)}), 1)), lambda i: array_to_string({sql_words(c)}[i:i + 1], ' '))"
    side = lambda c, name: f"{name} AS (SELECT conv_id, turn, g, count(*) AS n FROM (SELECT conv_id, turn, unnest({gram(c)}) AS g FROM p) GROUP BY ALL)"
    return f"WITH {_PAIRS}, {side('candidate', 'c')}, {side('reference', 'r')}, sh AS (SELECT conv_id, turn, sum(least(c.n, r.n)) AS shared FROM c JOIN r USING (conv_id, turn, g) GROUP BY ALL), z AS (SELECT conv_id, turn, coalesce(shared, 0) / nullif(len({gram('candidate')}), 0) AS p, coalesce(shared, 0) / nullif(len({gram('reference')}), 0) AS r FROM p LEFT JOIN sh USING (conv_id, turn)) SELECT conv_id, turn, round(coalesce(p, 0), 6) AS precision, round(coalesce(r, 0), 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f FROM z"


def _rounded(df):
    return df.select(*_KEY, *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f")])


@query(_rouge(1))
def rouge_1(spark, sf_dir):
    return _rounded(Z.rouge_n(_pairs(spark, sf_dir), 1, keys=_KEY))


@query(_rouge(2))
def rouge_2(spark, sf_dir):
    return _rounded(Z.rouge_n(_pairs(spark, sf_dir), 2, keys=_KEY))


@query()
def rouge_l(spark, sf_dir):
    return Z.rouge_l(_pairs(spark, sf_dir), keys=_KEY)


@query()
def rouge_stemmed(spark, sf_dir):
    """All three measures on stems."""
    return Z.rouge(_pairs(spark, sf_dir), keys=_KEY)


@query()
def summary_evaluation(spark, sf_dir):
    """TextRank summaries held against TF-IDF summaries of the same documents."""
    docs = table(spark, sf_dir, "documents")
    return Z.evaluate(Z.ranked(docs, "textrank"), Z.tfidf_summaries(docs).withColumnRenamed("summary", "reference"))


def _summary(method):
    @query(name=f"summary_{method}")
    def run(spark, sf_dir):
        return Z.ranked(table(spark, sf_dir, "documents"), method)

    return run


for _method in Z.METHODS:
    _summary(_method)


@query()
def kmeans_vectors(spark, sf_dir):
    v = M.as_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    made, score = M.kmeans(v, id_col="vec_id", k=5)
    return made.withColumn("silhouette", F.lit(score).cast("double"))


@query()
def kmeans_docs(spark, sf_dir):
    """Clusters of the 36 scaled indicators."""
    made, score = M.kmeans(M.as_vectors(K.feature_vectors(C.history(spark, sf_dir)), "doc_id", "features"), id_col="doc_id", k=5)
    return made.withColumn("silhouette", F.lit(score).cast("double"))


@query()
def pca_2d(spark, sf_dir):
    return M.pca(M.as_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), id_col="vec_id")


@query()
def neighbour_graph(spark, sf_dir):
    """The 15 nearest vectors of each, by neighbour descent."""
    points = N.distinct_vectors(table(spark, sf_dir, "embeddings"), id_col="vec_id", vector_col="embedding")
    return N.neighbour_graph(points.where("v IS NOT NULL").select("id", "v"))


@query()
def manifold_2d(spark, sf_dir):
    return N.reduce(table(spark, sf_dir, "embeddings"), id_col="vec_id", vector_col="embedding")


@query()
def pca_dimensions(spark, sf_dir):
    s = K.dimension_scores(C.history(spark, sf_dir)).select("doc_id", F.array(*K.DIMENSIONS).alias("a"))
    return M.pca(M.as_vectors(s, "doc_id", "a"), id_col="doc_id")


@query()
def document_vectors(spark, sf_dir):
    return M.document_vectors(table(spark, sf_dir, "documents")).select("doc_id", M.vector_to_array("vector").alias("vector"))


@query()
def document_embeddings(spark, sf_dir):
    """Vectors by the words' company in the same corpus."""
    d = table(spark, sf_dir, "documents")
    return B.embed(d, B.fit(d))


def _walk_sql(name: str, sign: int) -> str:
    """Ten rounds of a walk from the seeds of one sign."""
    seeds = ", ".join(f"('{w}', CAST({abs(v)} AS DOUBLE))" for w, v in L.VALENCES.items() if v * sign > 0)
    start = f"{name}s AS (SELECT word, v / sum(v) OVER () AS m FROM (VALUES {seeds}) z(word, v) WHERE word IN (SELECT a FROM g)), {name}0 AS (SELECT * FROM {name}s)"
    one = "{n}{i} AS (SELECT word, sum(m) AS m FROM (SELECT b AS word, 0.85 * step * m AS m FROM t JOIN {n}{j} ON a = word UNION ALL SELECT word, 0.15 * m FROM {n}s) GROUP BY word)"
    return ", ".join([start, *[one.format(n=name, i=i + 1, j=i) for i in range(10)]])


_LEXICON = (
    f"{C.WITH_HISTORY}, s AS (SELECT row_number() OVER () AS id, s FROM (SELECT unnest({sql_sentences('text')}) AS s FROM history)), w AS (SELECT id, {sql_content_words('s')} AS w FROM s), e AS (SELECT id, unnest(w) AS word, unnest(range(len(w))) AS p FROM w),"
    " v AS (SELECT word FROM e GROUP BY word HAVING count(DISTINCT id) BETWEEN 2 AND 0.95 * (SELECT count(*) FROM s) ORDER BY count(*) DESC, word LIMIT 5000), k AS (SELECT * FROM e WHERE word IN (SELECT word FROM v)),"
    " o AS (SELECT x.word AS a, y.word AS b FROM k x JOIN k y ON x.id = y.id AND y.p BETWEEN x.p + 1 AND x.p + 5), n AS (SELECT a, b, count(*) AS n FROM (SELECT a, b FROM o UNION ALL SELECT b, a FROM o) GROUP BY ALL), m AS (SELECT a, sum(n) AS own FROM n GROUP BY a),"
    " g AS (SELECT n.a, n.b, ln(n * (SELECT sum(n) FROM n) / (x.own * y.own)) AS weight FROM n JOIN m x ON n.a = x.a JOIN m y ON n.b = y.a WHERE n.a <> n.b AND ln(n * (SELECT sum(n) FROM n) / (x.own * y.own)) > 0), t AS MATERIALIZED (SELECT a, b, weight / sum(weight) OVER (PARTITION BY a) AS step FROM g), "
    f"{_walk_sql('p', 1)}, {_walk_sql('q', -1)} SELECT word, round(4 * (coalesce(p.m, 0) - coalesce(q.m, 0)) / (coalesce(p.m, 0) + coalesce(q.m, 0)), 6) AS valence FROM p10 p FULL JOIN q10 q USING (word)"
)


@query(_LEXICON)
def sentiment_lexicon(spark, sf_dir):
    """Valences spread from the built-in table's words."""
    return V.learn(V.word_graph(C.history(spark, sf_dir))).select("word", F.round("valence", 6).alias("valence"))


@query()
def lda_topics(spark, sf_dir):
    return M.lda(table(spark, sf_dir, "documents"))[0]


@query()
def nmf_topics(spark, sf_dir):
    return M.nmf(table(spark, sf_dir, "documents"))


@query()
def topic_coherence(spark, sf_dir):
    h = C.history(spark, sf_dir)
    return M.coherence(h, M.nmf(h, topics=5, features=500))
