"""Models: document vectors, clusters, reduction, topics. Spark ML where it has the method; topics by NMF are own."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import IDF, PCA, CountVectorizerModel, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import stored
from .features import ngrams, spread

SEED = 42


def _words(docs: DataFrame, id_col: str, text_col: str, max_n: int = 1) -> DataFrame:
    w = docs.select(id_col, T.words(F.coalesce(F.col(text_col), F.lit(""))).alias("_w"))
    return w.select(id_col, F.concat(*[ngrams(F.col("_w"), n) for n in range(1, max_n + 1)]).alias("words"))


def document_vectors(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 384) -> DataFrame:
    """id, vector: hashed TF-IDF of length 1; stands in for a neural sentence encoder, which is not available offline."""
    tf = HashingTF(numFeatures=size, inputCol="words", outputCol="tf").transform(_words(docs, id_col, text_col))
    weighted = IDF(inputCol="tf", outputCol="raw").fit(tf).transform(tf)
    return Normalizer(inputCol="raw", outputCol="vector").transform(weighted).select(id_col, "vector")


def as_vectors(df: DataFrame, id_col: str, array_col: str) -> DataFrame:
    return df.select(id_col, array_to_vector(F.col(array_col).cast("array<double>")).alias("vector"))


def kmeans(vectors: DataFrame, *, id_col: str, k: int = 5) -> tuple[DataFrame, float | None]:
    """(id, cluster), silhouette with squared Euclidean distances; one cluster or as many as rows have none."""
    vectors = stored(vectors, "vectors")  # read by every round
    n = vectors.count()
    vectors = dealt(vectors, n)
    # with fewer distinct vectors than clusters there are fewer clusters, which the library's rounds don't expect
    k = max(1, vectors.select(vector_to_array("vector").alias("v")).distinct().limit(k).count())
    if k == 1:
        return vectors.select(id_col, F.lit(0).alias("cluster")), None
    made = KMeans(k=k, seed=SEED, featuresCol="vector", predictionCol="cluster").fit(vectors).transform(vectors)
    used = made.select("cluster").distinct().count()
    score = ClusteringEvaluator(featuresCol="vector", predictionCol="cluster").evaluate(made) if 1 < used < n else None
    return made.select(id_col, "cluster"), score


def pca(vectors: DataFrame, *, id_col: str, k: int = 2) -> DataFrame:
    """id, x0 ... : principal components; also stands in for the manifold reduction that only feeds plots."""
    vectors = stored(vectors, "vectors")  # the fit reads them more than once
    made = PCA(k=k, inputCol="vector", outputCol="p").fit(vectors).transform(vectors).select(id_col, vector_to_array("p").alias("p"))
    return made.select(id_col, *[F.col("p")[i].alias(f"x{i}") for i in range(k)])


SLICE = 256  # rows that are Python or dense at a time
ROWS = 1 << 17  # vectors that a task should read


def _vocabulary(words: DataFrame, n: int, features: int, min_df: int, max_df: float) -> list[str]:
    """The most frequent words in at least min_df of n texts and at most the share max_df of them, ties by word; only they reach the driver."""

    def tally(batches):
        for batch in batches:
            total, df = Counter(), Counter()
            for at in range(0, batch.num_rows, SLICE):
                for own in batch.column(0).slice(at, SLICE).to_pylist():
                    total.update(own)
                    df.update(set(own))
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64()), pa.array([df[w] for w in total], pa.int64())], names=["word", "n", "df"])

    sums = words.select("words").mapInArrow(tally, "word string, n long, df long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    return [r.word for r in sums.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n)).orderBy(F.desc("n"), "word").limit(features).collect()]


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """n rows in so many partitions that none holds many more than ROWS: compressed, many rows are few bytes and so few splits."""
    wanted = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS))
    return rows if rows.rdd.getNumPartitions() >= wanted else rows.repartition(wanted)


def lda(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", topics: int = 10, words: int = 10, rounds: int = 10, features: int = 5000) -> tuple[DataFrame, DataFrame]:
    """(topic, rank, word, weight), (id, topics: array of shares)."""
    words_of, n = _words(spread(docs.select(id_col, text_col)), id_col, text_col), docs.count()
    vocabulary = _vocabulary(words_of, n, features, 2, 0.95)
    if not vocabulary:
        return docs.sparkSession.createDataFrame([], "topic int, rank int, word string, weight double"), docs.select(id_col, F.array().cast("array<double>").alias("topics"))
    # every round reads the counts, not the texts
    bag = dealt(stored(CountVectorizerModel.from_vocabulary(vocabulary, inputCol="words", outputCol="counts").transform(words_of).select(id_col, "counts"), "counts"), n)
    fitted = LDA(k=topics, maxIter=rounds, seed=SEED, optimizer="online", optimizeDocConcentration=True, featuresCol="counts").fit(bag)
    names = F.array(*[F.lit(w) for w in vocabulary])
    top = fitted.describeTopics(words).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "x"))
    top = top.select("topic", (F.col("rank") + 1).alias("rank"), F.get(names, F.col("x.termIndices")).alias("word"), F.col("x.termWeights").alias("weight"))
    return top, fitted.transform(bag).select(id_col, vector_to_array("topicDistribution").alias("topics"))


def nmf(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", topics: int = 10, words: int = 10, rounds: int = 10, features: int = 3000, inner: int = 5) -> DataFrame:
    """topic, rank, word, weight. Multiplicative updates: document weights are solved where the rows are; only the topics x features sums, whose size does not depend on the input, reach the driver."""
    spark = docs.sparkSession
    words_of, n = _words(spread(docs.select(id_col, text_col)), id_col, text_col), docs.count()
    vocabulary = _vocabulary(words_of, n, features, 2, 0.98)
    v = len(vocabulary)
    if not v:
        return spark.createDataFrame([], "topic int, rank int, word string, weight double")

    def numbered(batches):
        place = {w: i for i, w in enumerate(vocabulary)}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = [Counter(place[w] for w in own if w in place) for own in batch.column(0).slice(at, SLICE).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([list(c) for c in rows], pa.list_(pa.int32())), pa.array([list(c.values()) for c in rows], pa.list_(pa.int32()))], names=["term", "n"])

    # every round reads the words' numbers and counts: as dense rows they would be many times the texts
    cells = dealt(stored(words_of.select("words").mapInArrow(numbered, "term array<int>, n array<int>"), "counts"), n)
    rng = np.random.default_rng(SEED)
    h = rng.random((topics, v)) + 0.1
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(h)

        def run(batches, now=now):
            basis = now.value
            gram = basis @ basis.T
            top, square = np.zeros((topics, v)), np.zeros((topics, topics))
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    part = batch.slice(at, SLICE)
                    x = np.zeros((part.num_rows, v))
                    row = np.repeat(np.arange(part.num_rows), np.asarray(pc.list_value_length(part.column(0))))
                    x[row, np.asarray(part.column(0).flatten())] = np.asarray(part.column(1).flatten())
                    cross = x @ basis.T
                    w = np.full((part.num_rows, topics), 1.0 / topics)
                    for _ in range(inner):
                        w *= cross / (w @ gram + 1e-9)
                    top += w.T @ x
                    square += w.T @ w
            flat = np.concatenate([top.ravel(), square.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["i", "x"])

        rows = cells.mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
        flat = np.zeros(topics * v + topics * topics)
        flat[np.asarray(rows.column("i"))] = np.asarray(rows.column("x"))
        top, square = flat[: topics * v].reshape(topics, v), flat[topics * v :].reshape(topics, topics)
        h = h * top / (square @ h + 1e-9)
        now.destroy()
    out = [(t, r + 1, vocabulary[i], float(h[t, i])) for t in range(topics) for r, i in enumerate(np.argsort(-h[t], kind="stable")[:words].tolist())]
    return spark.createDataFrame(out, "topic int, rank int, word string, weight double")


def coherence(docs: DataFrame, topics: DataFrame, *, text_col: str = "text", window: int = 110) -> DataFrame:
    """topic, npmi, c_v of topics (topic, word; a few words each, which the driver holds).

    Words co-occur in a sliding window of so many words (a shorter text is one window). npmi is the mean over a topic's
    pairs; c_v the mean cosine of each word's vector of npmi with its topic's words to the sum of those vectors. Windows
    are counted where the texts are: only sums over pairs of topic words leave a task. Words that never occur have an
    npmi of 0 with any other; a topic of one word has a c_v of 1 if it occurs, and no npmi."""
    own: dict[int, list[str]] = {}
    for r in topics.select("topic", "word").distinct().orderBy("topic", "word").collect():
        own.setdefault(r["topic"], []).append(r["word"])
    place = {w: i for i, w in enumerate(sorted({w for ws in own.values() for w in ws}))}
    v = len(place)

    def run(batches):
        total, pairs = 0, np.zeros((v, v))
        for batch in batches:
            for words in (w for at in range(0, batch.num_rows, SLICE) for w in batch.column(0).slice(at, SLICE).to_pylist()):
                n = len(words)
                if not n:
                    continue
                seen = np.zeros((n + 1, v), np.int32)
                at = [(i + 1, place[w]) for i, w in enumerate(words) if w in place]
                windows = max(1, n - window + 1)
                total += windows
                if at:
                    rows, columns = zip(*at, strict=True)
                    np.add.at(seen, (np.array(rows), np.array(columns)), 1)
                    seen = np.cumsum(seen, 0)
                    inside = (seen[np.minimum(np.arange(windows) + window, n)] > seen[:windows]).astype(np.float64)
                    pairs += inside.T @ inside
        flat = np.concatenate([[float(total)], pairs.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["i", "x"])

    rows = docs.select(T.words(F.coalesce(F.col(text_col), F.lit(""))).alias("w")).mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    flat = np.zeros(1 + v * v)
    flat[np.asarray(rows.column("i"))] = np.asarray(rows.column("x"))
    total, both = max(flat[0], 1.0), flat[1:].reshape(v, v) / max(flat[0], 1.0)
    alone = np.diag(both)
    with np.errstate(divide="ignore", invalid="ignore"):
        npmi = np.where(np.outer(alone, alone) > 0, np.log((both + 1e-12) / np.outer(alone, alone)) / -np.log(both + 1e-12), 0.0)
    out = []
    for topic, words in own.items():
        at = [place[w] for w in words]
        m = npmi[np.ix_(at, at)]
        whole = m.sum(0)
        size = np.linalg.norm(m, axis=1) * np.linalg.norm(whole)
        pair = m[np.triu_indices(len(at), 1)]
        out.append((topic, float(pair.mean()) if len(pair) else None, float(np.mean(np.divide(m @ whole, size, out=np.zeros(len(at)), where=size > 0)))))
    return docs.sparkSession.createDataFrame(out, f"topic {topics.schema['topic'].dataType.simpleString()}, npmi double, c_v double")


def simplified_silhouette(vectors: DataFrame, *, id_col: str, label_col: str) -> DataFrame:
    """label, n, silhouette by distances to the clusters' centres: linear in rows times clusters. vectors: id, label, vector (array of numbers). A single cluster scores 0."""
    v = vectors.select(F.col(id_col).alias("_i"), F.col(label_col).alias("label"), F.col("vector").cast("array<double>").alias("x"))
    size = v.select("label", F.posexplode("x").alias("p", "c")).groupBy("label", "p").agg(F.avg("c").alias("m"))
    centres = size.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda s: s["m"]).alias("m"))
    every = centres.agg(F.collect_list(F.struct("label", "m")).alias("all"))  # one row: as many centres as there are clusters
    gap = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, e: s + e))
    far = v.crossJoin(F.broadcast(every)).select("label", F.transform("all", lambda c: F.struct(c["label"].alias("l"), gap(F.col("x"), c["m"]).alias("d"))).alias("d"))
    a = F.array_min(F.transform(F.filter("d", lambda c: c["l"].eqNullSafe(F.col("label"))), lambda c: c["d"]))
    b = F.array_min(F.transform(F.filter("d", lambda c: ~c["l"].eqNullSafe(F.col("label"))), lambda c: c["d"]))
    return far.select("label", F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0)).alias("s")).groupBy("label").agg(F.count("*").alias("n"), F.avg("s").alias("silhouette"))
