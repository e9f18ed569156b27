"""A sentiment lexicon learned from the corpus: valences of a few seed words spread over a graph of words that keep company.

Two random walks with restart, one from the positive and one from the negative seeds, run over positive mutual
information; a word's valence is the balance of what reaches it. Resampled seeds go along in the same rounds and say how
far the sign depends on single seeds."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..sources.scratch import stored
from .embeddings import cooccurrence
from .features import _vocabulary, content_words

SEED = 42
STRONGEST = 4.0


def word_graph(docs: DataFrame, *, text_col: str = "text", window: int = 5, vocabulary: int = 5000, min_df: int = 2, max_df: float = 0.95) -> DataFrame:
    """a, b, weight: for words at most ``window`` content words apart in a sentence, their positive mutual information, in both directions.

    All sentences count; ``vocabulary`` bounds the words, so the graph has at most its square of edges. Null texts have none."""
    sentences = docs.select(F.explode(T.sentences(F.coalesce(F.col(text_col), F.lit("")))).alias("text")).select(F.lit(0).alias("id"), "text")
    words = stored(content_words(sentences, id_col="id"), "words")
    known = sorted(r.term for r in _vocabulary(words, 1, min_df, max_df, vocabulary).collect())
    pairs = stored(cooccurrence(words, {w: i for i, w in enumerate(known)}, window), "pairs")
    names = docs.sparkSession.createDataFrame(list(enumerate(known)), "i int, word string")
    sums = pairs.groupBy("i").agg(F.sum("n").alias("own")).join(names, "i")
    total = pairs.agg(F.sum("n").alias("total"))  # one row
    a, b = sums.select("i", F.col("own").alias("na"), F.col("word").alias("a")), sums.select(F.col("i").alias("j"), F.col("own").alias("nb"), F.col("word").alias("b"))
    value = F.log(F.col("n").cast("double") * F.col("total") / (F.col("na").cast("double") * F.col("nb")))
    joined = pairs.where("i <> j").join(a, "i").join(b, "j").crossJoin(F.broadcast(total))
    return joined.select("a", "b", value.alias("weight")).where("weight > 0")


def _restarts(seeds: Mapping[str, float], resamples: int) -> dict[str, list[float]]:
    """Of each seed its share of every walk's restarts: positive and negative for all seeds, then for each resample of either side."""
    rng = np.random.default_rng(SEED)
    sides = [sorted((w, abs(v)) for w, v in seeds.items() if v * sign > 0) for sign in (1, -1)]
    out: dict[str, list[float]] = {w: [0.0] * (2 * (resamples + 1)) for side in sides for w, _ in side}
    for walk in range(resamples + 1):
        for s, side in enumerate(sides):
            drawn = Counter(range(len(side)) if walk == 0 else rng.integers(0, max(len(side), 1), len(side)).tolist())
            mass = sum(side[i][1] * n for i, n in drawn.items())
            for i, n in drawn.items():
                out[side[i][0]][2 * walk + s] = side[i][1] * n / mass
    return out


def learn(graph: DataFrame, seeds: Mapping[str, float] | None = None, *, rounds: int = 10, restart: float = 0.15, resamples: int = 10) -> DataFrame:
    """word, valence (-4 to 4), confidence (share of the resampled seed sets that give its sign), seed: every word that a walk reaches.

    Seeds are the built-in table unless others are given; those that the graph doesn't have are left out, and so are
    seeds of valence 0. With seeds of one sign all words have that sign; without any there are none."""
    seeds = {w: v for w, v in (L.VALENCES if seeds is None else seeds).items() if v}
    graph = stored(graph, "graph")
    spark, known = graph.sparkSession, graph.select(F.col("a").alias("word")).distinct()
    present = {r.word for r in known.where(F.col("word").isin(list(seeds))).collect()}  # no more than the seeds
    starts = _restarts({w: v for w, v in seeds.items() if w in present}, resamples)
    walks = [f"s{i}" for i in range(2 * (resamples + 1))]
    origin = spark.createDataFrame([(w, *v) for w, v in starts.items()], "word string, " + ", ".join(f"{c} double" for c in walks))
    steps = stored(graph.join(graph.groupBy("a").agg(F.sum("weight").alias("all")), "a").select("a", "b", (F.col("weight") / F.col("all")).alias("step")), "steps")
    now = origin
    for _ in range(rounds):
        moved = steps.join(now.withColumnRenamed("word", "a"), "a").groupBy(F.col("b").alias("word")).agg(*[((1 - restart) * F.sum(F.col("step") * F.col(c))).alias(c) for c in walks])
        again = origin.select("word", *[(restart * F.col(c)).alias(c) for c in walks])
        now = stored(moved.union(again).groupBy("word").agg(*[F.sum(c).alias(c) for c in walks]), "walks")
    balance = lambda i: F.try_divide(F.col(f"s{2 * i}") - F.col(f"s{2 * i + 1}"), F.col(f"s{2 * i}") + F.col(f"s{2 * i + 1}"))
    agree = [F.when(F.signum(balance(i)) == F.signum(balance(0)), 1.0).otherwise(0.0) for i in range(1, resamples + 1)]
    share = sum(agree, F.lit(0.0)) / resamples if resamples else F.lit(None).cast("double")
    return now.where("s0 + s1 > 0").select("word", (STRONGEST * balance(0)).alias("valence"), share.alias("confidence"), F.col("word").isin(list(starts)).alias("seed"))
