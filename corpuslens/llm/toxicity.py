"""Toxicity by a chain of linear classifiers.

Categories are learned in a fixed order. Each has a logistic regression on the presence of words and word beginnings
(hashed, then the most telling kept); those after the first also see the earlier categories' log-odds. While training,
these come from models that have not seen the row (out of fold), so later links learn from the same kind of input that
they get when predicting.

Training reads a bounded sample of labelled rows: about ``max_positive`` and ``max_negative`` rows with and without the
last category, picked by a hash of the id; the intercepts are corrected for the picked shares. Prediction is narrow: no
shuffle, one broadcast of at most ``FEATURES`` weights a category.

What categories there are follows from the labels: ``fit`` takes any boolean columns, in the chain's order.
``label_columns`` makes the most of a table that has one label of toxicity and one of quality: low quality, toxic, and
toxic text of low quality. The last two are about toxicity, the first is not, and the third is the conjunction of the
others: the chain has little to add to it beyond what the earlier links say.

Null and empty texts have no words and score what the intercepts say. A document's label rows are one: a category holds
if any of them says so, however many disagree; rows with a null label are not learned from, and a label without a
document is ignored. Extra columns are left out, whatever their names. Without labelled rows, or with one class only, a category's probability is its
share among the labelled rows (about 0 without any). Repeated rows and equal texts get equal scores; texts are read whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_columns, lean

BUCKETS = 1 << 22
FEATURES = 4096
FOLDS = 5
PREFIXES = (4, 5, 6)
MAX_POSITIVE, MAX_NEGATIVE = 2500, 5000


_WORD = re.compile(r"[^\W\d_]+")


def _mixed(word: str) -> int:
    import zlib

    data = word.encode("utf-8", "surrogatepass")
    return (zlib.crc32(data) ^ len(data) * 0x9E3779B1) % BUCKETS


class Hasher:
    """Texts to sorted distinct bucket numbers; remembers words it has seen, up to a bound."""

    def __init__(self):
        self.known: dict[str, tuple[int, ...]] = {}

    def features(self, text: str | None) -> np.ndarray:
        found: set[int] = set()
        known = self.known
        for word in set(_WORD.findall((text or "").lower())):
            ids = known.get(word)
            if ids is None:
                ids = (_mixed(word), *(_mixed(f"{word[:n]}*") for n in PREFIXES if len(word) > n))
                if len(known) < 300_000:
                    known[word] = ids
            found.update(ids)
        return np.array(sorted(found), np.int64)


def _select(rows: np.ndarray, ids: np.ndarray, y: np.ndarray, top: int) -> np.ndarray:
    """The buckets whose presence tells most about y (G statistic), of those seen in 3 rows or more."""
    n, pos = len(y), int(y.sum())
    values, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
    hits = np.bincount(inverse, weights=y[rows], minlength=len(values))
    with np.errstate(divide="ignore", invalid="ignore"):
        total = np.zeros(len(values))
        for seen, expected in ((hits, counts * pos / n), (counts - hits, counts * (n - pos) / n), (pos - hits, (n - counts) * pos / n), (n - pos - counts + hits, (n - counts) * (n - pos) / n)):
            total += np.where(seen > 0, seen * np.log(seen / np.maximum(expected, 1e-12)), 0)
    total[counts < 3] = -1
    best = np.argsort(-total, kind="stable")[:top]
    return np.sort(values[best[total[best] > 2.0]])


class Link:
    """One category's model: kept buckets, their weights, weights of earlier log-odds, intercept."""

    def __init__(self, kept, weights, chain, intercept):
        self.kept, self.weights, self.chain, self.intercept = kept, weights, chain, intercept

    def scores(self, rows: np.ndarray, ids: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        out = np.full(n, self.intercept)
        if len(self.kept) and len(ids):
            at = np.minimum(np.searchsorted(self.kept, ids), len(self.kept) - 1)
            out += np.bincount(rows, weights=np.where(self.kept[at] == ids, self.weights[at], 0.0), minlength=n)
        return out + earlier @ self.chain


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train_link(rows: np.ndarray, ids: np.ndarray, y: np.ndarray, weight: np.ndarray, earlier: np.ndarray, *, steps: int = 120, l2: float = 3e-5) -> Link:
    """Logistic regression by full gradients with momentum per weight (Adam)."""
    n = len(y)
    share = float((y * weight).sum() / weight.sum()) if n else 0.0
    if n == 0 or share in (0.0, 1.0):
        return Link(np.empty(0, np.int64), np.empty(0), np.zeros(earlier.shape[1]), float(np.log((share + 1e-6) / (1 - share + 1e-6))) if n else -30.0)
    kept = _select(rows, ids, y, FEATURES)
    at = np.searchsorted(kept, ids) if len(kept) else np.zeros(len(ids), np.int64)
    inside = (kept[np.minimum(at, len(kept) - 1)] == ids) if len(kept) else np.zeros(len(ids), bool)
    r, c = rows[inside], at[inside]
    k, m = len(kept), earlier.shape[1]
    w = np.zeros(k + m + 1)
    w[-1] = np.log(share / (1 - share))
    first, second = np.zeros_like(w), np.zeros_like(w)
    scaled = weight / weight.sum()
    for step in range(1, steps + 1):
        z = np.bincount(r, weights=w[:k][c], minlength=n) + earlier @ w[k:-1] + w[-1]
        error = (_sigmoid(z) - y) * scaled
        grad = np.concatenate([np.bincount(c, weights=error[r], minlength=k) if k else np.empty(0), earlier.T @ error, [error.sum()]])
        grad[:-1] += l2 * w[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        w -= 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Link(kept, w[:k], w[k:-1], float(w[-1]))


class Chain:
    def __init__(self, names: list[str], links: list[Link]):
        self.names, self.links = names, links

    def predict(self, features: list[np.ndarray]) -> np.ndarray:
        """Probabilities, texts x categories."""
        n = len(features)
        rows = np.repeat(np.arange(n), [len(f) for f in features])
        ids = np.concatenate([*features, np.empty(0, np.int64)])
        odds = np.zeros((n, 0))
        for link in self.links:
            odds = np.column_stack([odds, np.clip(link.scores(rows, ids, n, odds), -12, 12)])
        return _sigmoid(odds)


def train_chain(names: list[str], features: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, fold: np.ndarray) -> Chain:
    """Links in order; each later one is trained on earlier log-odds of models that did not see the row."""
    n = len(features)
    rows = np.repeat(np.arange(n), [len(f) for f in features])
    ids = np.concatenate([*features, np.empty(0, np.int64)])
    odds, links = np.zeros((n, 0)), []
    for k in range(len(names)):
        y = labels[:, k].astype(float)
        links.append(train_link(rows, ids, y, weight, odds))
        if k + 1 == len(names):
            break
        out = np.zeros(n)
        for f in range(FOLDS):
            test = fold == f
            if not test.any():
                continue
            place = np.cumsum(~test) - 1
            seen = ~test[rows]
            model = train_link(place[rows[seen]], ids[seen], y[~test], weight[~test], odds[~test])
            unseen = test[rows]
            place = np.cumsum(test) - 1
            out[test] = model.scores(place[rows[unseen]], ids[unseen], int(test.sum()), odds[test])
        odds = np.column_stack([odds, np.clip(out, -12, 12)])
    return Chain(names, links)


def label_columns(labels: DataFrame) -> dict[str, Column]:
    """The labels table's categories in the chain's order: low quality (no toxicity, but what follows depends on it), toxic, and both at once."""
    low, toxic = F.col("quality") == 0, F.col("toxic") == 1
    return {"low_quality": low, "toxic": toxic, "toxic_low_quality": low & toxic}


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], *, main: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE) -> Chain:
    names = list(categories)
    rows = labels.select(F.col(f"`{id_col}`").alias("id"), *[c.alias(n) for n, c in categories.items()]).dropna()
    known = rows.groupBy("id").agg(*[F.max(n).alias(n) for n in names])
    sizes = {r[main]: r["n"] for r in known.groupBy(main).agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col(main), F.lit(min(1.0, max_positive / sizes.get(True, 1)))).otherwise(F.lit(min(1.0, max_negative / sizes.get(False, 1))))
    place = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # about max_positive + max_negative thin rows, whatever the number of labels: small enough to broadcast
    sample = known.where(place < share)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    picked = texts.join(F.broadcast(sample), "id")

    def run(batches):
        hasher = Hasher()
        for batch in lean(batches):
            data = [hasher.features(t).astype(np.int32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary()), *[batch.column(2 + i) for i in range(len(names))]], names=["fold", "features", *names])

    rows = picked.select((F.crc32(F.col("id").cast("string").cast("binary")) % FOLDS).cast("int").alias("fold"), "text", *names).mapInArrow(run, "fold int, features binary, " + ", ".join(f"`{n}` boolean" for n in names)).toArrow()
    rows = rows.sort_by([("fold", "ascending"), ("features", "ascending")])  # the same model however partitions arrive
    features = [np.frombuffer(x.as_buffer(), np.int32).astype(np.int64) for x in rows.column("features")]
    y = np.column_stack([np.asarray(rows.column(n)) for n in names]).astype(bool) if len(features) else np.zeros((0, len(names)), bool)
    positive = y[:, names.index(main)]
    weight = np.where(positive, sizes.get(True, 0) / max(1, positive.sum()), sizes.get(False, 0) / max(1, (~positive).sum()))
    return train_chain(names, features, y, weight, np.asarray(rows.column("fold")))


def predict(docs: DataFrame, chain: Chain, *, main: str = "toxic", threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, main (boolean), p_<category> of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = chain.names
    shared = docs.sparkSession.sparkContext.broadcast([(x.kept, x.weights, x.chain, x.intercept) for x in chain.links])

    def run(batches):
        own, hasher = Chain(names, [Link(*x) for x in shared.value]), Hasher()
        for batch in lean(batches):
            texts = batch.column(1).to_pylist()
            out = np.concatenate([own.predict([hasher.features(t) for t in texts[i : i + 256]]) for i in range(0, len(texts), 256)] or [np.zeros((0, len(names)))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[:, names.index(main)] >= threshold), *[pa.array(out[:, i]) for i in range(len(names))]], names=[id_col, main, *[f"p_{n}" for n in names]])

    return doc_columns(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, `{main}` boolean, " + ", ".join(f"`p_{n}` double" for n in names))
