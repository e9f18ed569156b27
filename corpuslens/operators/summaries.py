"""Extractive summaries and their evaluation.

A summary has max(3, min(10, 30 % of the sentences)) sentences, the best by score, ties to the earlier, in text order;
three sentences or fewer are all taken. Sentences of a document are an array in its row, so ranking methods that need
linear algebra run row by row without a shuffle. Empty texts give empty summaries.
"""

from __future__ import annotations

import ctypes
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..functions.stemming import stem
from .features import ngrams

LEAST, MOST, RATIO = 3, 10, 0.3
SLICE = 64  # documents that are Python objects at a time; a batch of long texts would be many times its bytes
METHODS = ("textrank", "lexrank", "lsa", "kl")


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most SLICE rows; after each batch the memory that the allocators still hold goes back."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)
        if trim:
            trim(0)
        pa.default_memory_pool().release_unused()


def _tfidf(sentences: list[list[str]], features: int) -> list[float]:
    """Of each sentence (its words), the sum of its normalised weights over 1- and 2-grams."""
    counts = [Counter([*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]) for w in sentences]
    total: Counter[str] = Counter()
    df: Counter[str] = Counter()
    for c in counts:
        total.update(c)
        df.update(c.keys())
    if len(total) > features:
        kept = set(sorted(total, key=lambda t: (-total[t], t))[:features])
        counts = [{t: n for t, n in c.items() if t in kept} for c in counts]
    n = len(sentences)
    idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items()}
    out = []
    for c in counts:
        raw = [k * idf[t] for t, k in c.items()]
        out.append(sum(raw) / math.sqrt(sum(x * x for x in raw)) if raw else 0.0)
    return out


def _chosen(scores: list[float]) -> list[int]:
    """The places of the best sentences, in text order."""
    n = len(scores)
    size = n if n <= LEAST else max(LEAST, min(MOST, int(n * RATIO)))
    return sorted(sorted(range(n), key=lambda i: (-round(float(scores[i]), 9), i))[:size])


def _scored(docs: DataFrame, id_col: str, text_col: str, features: int) -> DataFrame:
    """id, s (sentences), scores, picks; a document's sentences stay in its row."""
    kind = docs.schema[id_col].dataType.simpleString()
    s = docs.select(id_col, T.sentences(F.coalesce(F.col(text_col), F.lit(""))).alias("s"))

    def run(batches):
        for batch in _slices(batches):
            scores = [_tfidf(w, features) for w in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.list_(pa.float64())), pa.array([_chosen(x) for x in scores], pa.list_(pa.int32()))], names=[id_col, "s", "scores", "picks"])

    return s.withColumn("w", F.transform("s", lambda x: F.filter(T.words(x), lambda w: ~w.isin(L.STOP_WORDS)))).mapInArrow(run, f"`{id_col}` {kind}, s array<string>, scores array<double>, picks array<int>")


def tfidf_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", features: int = 1000) -> DataFrame:
    """id, pos, sentence, n, score, chosen: the sum of a sentence's normalised weights, with idf over the document's sentences and its ``features`` most frequent 1- and 2-grams without stop words; whether it is in the summary."""
    rows = _scored(docs, id_col, text_col, features)
    each = rows.select(id_col, F.size("s").alias("n"), "picks", F.posexplode(F.arrays_zip(F.col("s").alias("sentence"), F.col("scores").alias("score"))).alias("pos", "x"))
    return each.select(id_col, "pos", "x.sentence", "n", "x.score", F.array_contains("picks", F.col("pos")).alias("chosen"))


def tfidf_summaries(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", features: int = 1000) -> DataFrame:
    """id, summary, n_sentences, n_chosen, ratio; row by row, without a shuffle. Texts without a sentence have no row."""
    rows = _scored(docs, id_col, text_col, features).where(F.size("s") > 0)
    text = F.array_join(F.transform("picks", lambda i: F.get("s", i)), " ")
    return rows.select(id_col, text.alias("summary"), F.size("s").alias("n_sentences"), F.size("picks").cast("long").alias("n_chosen"), (F.size("picks") / F.size("s")).alias("ratio"))


_WORD = re.compile(r"[^\W_]+")


def _tokens(sentences: list[str], stops: frozenset[str]) -> list[list[str]]:
    return [[w for w in _WORD.findall(s.lower()) if w not in stops] for s in sentences]


def _matrix(sentences: list[str], stops: frozenset[str] = frozenset()) -> np.ndarray:
    """Sentences x words, tf-idf, rows of length 1."""
    tokens = _tokens(sentences, stops)
    place = {w: i for i, w in enumerate(sorted({w for t in tokens for w in t}))}
    m = np.zeros((len(sentences), max(1, len(place))))
    for i, t in enumerate(tokens):
        for w in t:
            m[i, place[w]] += 1
    df = (m > 0).sum(0)
    m *= np.log((1 + len(sentences)) / (1 + df)) + 1
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm > 0, norm, 1)


def textrank(sentences: list[str], damping: float = 0.85, tolerance: float = 1e-6, rounds: int = 100) -> np.ndarray:
    m = _matrix(sentences)
    sim = m @ m.T
    np.fill_diagonal(sim, 0)
    n, total = len(sentences), sim.sum(1)
    step = np.divide(sim, total[:, None], out=np.full_like(sim, 1 / n), where=total[:, None] > 0)
    rank = np.full(n, 1 / n)
    for _ in range(rounds):
        new = (1 - damping) / n + damping * (rank @ step)
        done = np.abs(new - rank).sum() < n * tolerance
        rank = new
        if done:
            break
    return rank


def lexrank(sentences: list[str], threshold: float = 0.1, rounds: int = 50) -> np.ndarray:
    m = _matrix(sentences)
    sim = m @ m.T
    sim[sim < threshold] = 0
    total = sim.sum(1, keepdims=True)
    step = sim / np.where(total > 0, total, 1)
    rank = np.full(len(sentences), 1 / len(sentences))
    for _ in range(rounds):
        rank = step.T @ rank
    return rank


def lsa(sentences: list[str], components: int = 10, stops: frozenset[str] = frozenset()) -> np.ndarray:
    """Row lengths in the leading singular directions, from the smaller Gram matrix."""
    m = _matrix(sentences, stops)
    values, vectors = np.linalg.eigh(m @ m.T)
    k = min(components, max(1, len(sentences) - 1))
    return np.sqrt(np.maximum((vectors[:, -k:] ** 2) @ np.maximum(values[-k:], 0), 0))


def kl(sentences: list[str], stops: frozenset[str] = frozenset()) -> np.ndarray:
    """Greedy: each round takes the sentence that brings the summary's word distribution closest to the document's. Earlier picks score higher."""
    tokens = _tokens(sentences, stops)
    place = {w: i for i, w in enumerate(sorted({w for t in tokens for w in t}))}
    counts = np.zeros((len(sentences), max(1, len(place))))
    for i, t in enumerate(tokens):
        np.add.at(counts[i], [place[w] for w in t], 1)
    n = len(sentences)
    size = n if n <= LEAST else max(LEAST, min(MOST, int(n * RATIO)))
    target = counts.sum(0) / max(1, counts.sum())
    score, now, left = np.zeros(n), np.zeros(counts.shape[1]), list(range(n))
    for rank in range(size):
        trial = now + counts[left]
        q = (trial + 1e-9) / (trial.sum(1, keepdims=True) + 1e-9 * trial.shape[1])
        pick = left.pop(int(np.argmin((q * np.log(q / (target + 1e-9))).sum(1))))
        now = now + counts[pick]
        score[pick] = size - rank
    return score


def ranked(docs: DataFrame, method: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, summary, picks (places in the text), scores, n_sentences; row by row."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    # the first two stand in for sentence encoders, which see every word
    stops = frozenset(L.STOP_WORDS)
    rank = {"textrank": textrank, "lexrank": lexrank, "lsa": partial(lsa, stops=stops), "kl": partial(kl, stops=stops)}[method]
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in _slices(batches):
            out = []
            for sentences in batch.column(1).to_pylist():
                n = len(sentences)
                scores = rank(sentences) if n > LEAST else np.ones(n)
                picks = _chosen(scores)
                out.append((" ".join(sentences[i] for i in picks), picks, [float(s) for s in scores], n))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.int32()), strict=True)]], names=[id_col, "summary", "picks", "scores", "n_sentences"])

    s = docs.select(id_col, T.sentences(F.coalesce(F.col(text_col), F.lit(""))).alias("s"))
    return s.mapInArrow(run, f"`{id_col}` {kind}, summary string, picks array<int>, scores array<double>, n_sentences int")


def rouge_n(pairs: DataFrame, n: int, *, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, precision, recall, f of (keys, candidate, reference) by n-gram counts; 0 where there is no n-gram."""

    def counts(column: str, name: str) -> DataFrame:
        return pairs.select(*keys, F.explode(ngrams(T.words(F.col(column)), n)).alias("g")).groupBy(*keys, "g").agg(F.count("*").alias(name))

    shared = counts("candidate", "c").join(counts("reference", "r"), [*keys, "g"]).groupBy(*keys).agg(F.sum(F.least("c", "r")).alias("shared"))
    size = lambda c: F.greatest(F.size(T.words(F.col(c))) - (n - 1), F.lit(0))
    rows = pairs.select(*keys, size("candidate").alias("nc"), size("reference").alias("nr")).join(shared, list(keys), "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    p, r = F.coalesce(F.try_divide("shared", "nc"), F.lit(0.0)), F.coalesce(F.try_divide("shared", "nr"), F.lit(0.0))
    return rows.select(*keys, p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f"))


def longest_common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one bit vector a row."""
    places: dict[str, int] = {}
    for i, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << i
    row = 0
    for w in a:
        x = row | places.get(w, 0)
        row = x & ~(x - (row << 1 | 1))
    return row.bit_count()


def rouge_l(pairs: DataFrame, *, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    kinds = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for batch in _slices(batches):
            out = []
            for c, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = longest_common(c, r)
                p, q = n / len(c) if c else 0.0, n / len(r) if r else 0.0
                out.append((p, q, 2 * p * q / (p + q) if n else 0.0))
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *[pa.array(c, pa.float64()) for c in columns]], names=[*keys, "precision", "recall", "f"])

    return pairs.select(T.words(F.col("candidate")).alias("c"), T.words(F.col("reference")).alias("r"), *keys).mapInArrow(run, f"{kinds}, precision double, recall double, f double")


ROUGES = ("rouge_1", "rouge_2", "rouge_l")
PARTS = ("precision", "recall", "f")


def _rates(shared: int, candidate: int, reference: int) -> tuple[float, float, float]:
    p, r = shared / candidate if candidate else 0.0, shared / reference if reference else 0.0
    return p, r, 2 * p * r / (p + r) if shared else 0.0


def rouge(pairs: DataFrame, *, keys: tuple[str, ...] = ("doc_id",), stemmed: bool = True) -> DataFrame:
    """keys and precision, recall and f of ROUGE-1, -2 and -L of (keys, candidate, reference), row by row without a shuffle.

    stemmed: words of more than three letters count by their stems. Null texts have no words; without words all is 0."""
    kinds = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys)
    names = [f"{x}_{y}" for x in ROUGES for y in PARTS]

    def run(batches):
        for batch in _slices(batches):
            out = []
            for sides in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c, r = ([stem(w) if stemmed and len(w) > 3 else w for w in side or ()] for side in sides)
                row: tuple[float, ...] = ()
                for n in (1, 2):
                    mine, theirs = (list(zip(*(w[i:] for i in range(n)), strict=False)) for w in (c, r))
                    row += _rates((Counter(mine) & Counter(theirs)).total(), len(mine), len(theirs))
                out.append(row + _rates(longest_common(c, r), len(c), len(r)))
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *[pa.array(x, pa.float64()) for x in columns]], names=[*keys, *names])

    return pairs.select(T.words(F.col("candidate")).alias("c"), T.words(F.col("reference")).alias("r"), *keys).mapInArrow(run, f"{kinds}, {', '.join(f'{n} double' for n in names)}")


def _length(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def evaluate(made: DataFrame, references: DataFrame, *, id_col: str = "doc_id", stemmed: bool = True) -> DataFrame:
    """The ROUGE columns, summary_length and reference_length (words between spaces) of each summary (id, summary) that has a reference (id, reference)."""
    both = made.select(id_col, F.col("summary").alias("candidate")).join(references.select(id_col, "reference"), id_col)
    both = both.withColumns({"summary_length": _length(F.col("candidate")), "reference_length": _length(F.col("reference"))})
    return rouge(both, keys=(id_col, "summary_length", "reference_length"), stemmed=stemmed)


def mean_rouge(evaluated: DataFrame) -> DataFrame:
    """One row: document_count and the mean of every ROUGE column; null without documents."""
    return evaluated.agg(F.count("*").alias("document_count"), *[F.avg(f"{x}_{y}").alias(f"{x}_{y}") for x in ROUGES for y in PARTS])


def intrinsic(made: DataFrame, method: str) -> DataFrame:
    """method, documents, and mean, least and largest compression ratio and summary length of summaries (id, summary, ratio)."""
    one = made.select("ratio", _length(F.col("summary")).alias("length"))
    each = [f(c).alias(f"{n}_{c}") for c in ("ratio", "length") for n, f in (("mean", F.avg), ("least", F.min), ("most", F.max))]
    return one.agg(F.count("*").alias("documents"), *each).select(F.lit(method).alias("method"), "*")
