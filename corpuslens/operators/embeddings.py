"""Document embeddings from the corpus: positive pointwise mutual information of words, reduced by a randomised SVD.

1. Co-occurrence (narrow, then one sum): each text counts pairs of vocabulary words at most ``window`` content words
   apart; counts are combined per batch, so what is shuffled is a row for each pair and batch at most. All texts count.
2. The matrix of PPMI values is a table of sparse rows, one a word. Subspace iteration: the driver holds an orthonormal
   basis of vocabulary x (size + spare), both parameters; each round multiplies it with the rows where they are, and takes
   the QR of the product. The small matrix of the last basis gives the singular values and word vectors.
3. A document's vector is the mean of its words' vectors weighted by tf-idf, scaled to length 1.

Words outside the vocabulary have no vector. Texts without known words, null texts and an empty table's have a zero
vector or no row. Repeated ids are judged each by its own text. Signs of vectors are fixed, so runs agree.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .features import _vocabulary, content_words

SEED = 42


@dataclass
class Model:
    places: dict[str, int]
    idf: np.ndarray
    vectors: np.ndarray  # words x size
    singular: np.ndarray


def cooccurrence(words: DataFrame, places: dict[str, int], window: int) -> DataFrame:
    """i, j, n: both orders of every pair of places; a word beside itself counts too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                pairs: Counter[tuple[int, int]] = Counter()
                for w in batch.column(0).slice(at, 512).to_pylist():
                    known = [places.get(x, -1) for x in w]
                    for k, a in enumerate(known):
                        if a >= 0:
                            for b in known[k + 1 : k + 1 + window]:
                                if b >= 0:
                                    pairs[a, b] += 1
                both: Counter[tuple[int, int]] = Counter()
                for (a, b), n in pairs.items():
                    both[a, b] += n
                    both[b, a] += n
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in both], pa.int32()), pa.array([p[1] for p in both], pa.int32()), pa.array(list(both.values()), pa.int64())], names=["i", "j", "n"])

    return words.select("w").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))


def ppmi_rows(pairs: DataFrame) -> DataFrame:
    """i, js, values: the positive mutual information of each word with others; a row has no more than the vocabulary's number."""
    counts = stored(pairs, "pairs")
    sums = counts.groupBy("i").agg(F.sum("n").alias("own"))
    total = counts.agg(F.sum("n").alias("total"))
    value = F.log(F.col("n").cast("double") * F.col("total") / (F.col("own").cast("double") * F.col("other")))
    joined = counts.join(sums, "i").join(sums.select(F.col("i").alias("j"), F.col("own").alias("other")), "j").crossJoin(F.broadcast(total))  # one row
    kept = joined.select("i", "j", value.alias("value")).where("value > 0")
    rows = kept.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "value"))).alias("x"))
    return rows.select("i", F.col("x.j").alias("js"), F.col("x.value").alias("values"))


def product(rows: DataFrame, basis: np.ndarray) -> np.ndarray:
    """The sparse rows times a basis; only the product, of the basis's size, reaches the driver."""
    shared = rows.sparkSession.sparkContext.broadcast(basis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for batch in batches:
            out = [(np.asarray(v) @ q[j]).tolist() for j, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=["i", "y"])

    y = np.zeros_like(basis)
    for r in rows.mapInArrow(run, "i int, y array<double>").collect():
        y[r.i] = r.y
    shared.unpersist()
    return y


def leading(rows: DataFrame, n: int, size: int, *, spare: int = 10, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The ``size`` largest singular values of a symmetric n x n matrix of sparse rows, and their vectors as columns."""
    k = min(n, size + spare)
    q = np.linalg.qr(np.random.default_rng(SEED).normal(size=(n, k)))[0]
    for _ in range(rounds):
        q = np.linalg.qr(product(rows, q))[0]
    small = q.T @ product(rows, q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-np.abs(values), kind="stable")[:size]
    u = q @ vectors[:, order]
    u *= np.where(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])] < 0, -1.0, 1.0)
    return np.abs(values[order]), u


def fit(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", size: int = 100, vocabulary: int = 5000, window: int = 5, min_df: int = 2, max_df: float = 0.95, rounds: int = 8, stop_words: Iterable[str] | None = None) -> Model:
    words = stored(content_words(docs, id_col=id_col, text_col=text_col, stop_words=stop_words), "words")
    known = sorted(_vocabulary(words, 1, min_df, max_df, vocabulary).collect(), key=lambda r: r.term)
    places = {r.term: i for i, r in enumerate(known)}
    idf = np.array([math.log((1 + r.n) / (1 + r.df)) + 1 for r in known])
    if not known:
        return Model({}, idf, np.zeros((0, size)), np.zeros(0))
    rows = stored(ppmi_rows(cooccurrence(words, places, window)), "ppmi")
    singular, u = leading(rows, len(known), size, rounds=rounds)
    vectors = np.zeros((len(known), size))
    vectors[:, : u.shape[1]] = u * np.sqrt(singular)
    return Model(places, idf, vectors, singular)


def embed(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", stop_words: Iterable[str] | None = None) -> DataFrame:
    """id, vector (array<double>); row by row."""
    words = content_words(docs, id_col=id_col, text_col=text_col, stop_words=stop_words)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((model.places, model.idf, model.vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, idf, vectors = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out = []
                for w in batch.column(1).slice(at, 512).to_pylist():
                    counts = Counter(places[x] for x in w if x in places)
                    v = np.zeros(vectors.shape[1])
                    if counts:
                        found = np.fromiter(counts, np.int64, len(counts))
                        v = ((1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))) * idf[found]) @ vectors[found]
                        norm = np.linalg.norm(v)
                        v = v / norm if norm > 0 else v
                    out.append(v.tolist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 512), pa.array(out, pa.list_(pa.float64()))], names=[id_col, "vector"])

    return words.select(id_col, "w").mapInArrow(run, f"`{id_col}` {kind}, vector array<double>")
