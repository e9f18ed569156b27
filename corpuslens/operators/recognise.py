"""Statistical entity recognition: an averaged structured perceptron over B/I/O tags, trained where the texts are.

Training (iterative parameter mixing, McDonald et al. 2010): the labelled texts are dealt to shards. Each round sends the
mixed weights to all shards; each makes one perceptron pass over its sentences (Viterbi, then an update where tags
differ); the shards' weights are averaged in Spark, and only the averages, whose size does not depend on the input,
reach the driver. The model is the mean of the rounds' in-pass averages.

Weights are a table of hashed features by tags. Features see a token, its shape and ends, and its neighbours, but no
list of names, so names that no list has are found by how they look and where they stand. A sentence's best tags obey
the B/I/O rules, as an I that continues nothing is not reachable. Tokens are runs of letters and digits with inner
apostrophes or hyphens, or single marks; sentences end at .!? before space; offsets count characters.

Null and empty texts give no rows; repeated ids are judged each by its own text, and labelled by the spans of that id;
spans that do not fall on token bounds teach nothing; without any span the model finds nothing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored

TOKENS = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*|[^\w\s]|_")
END = re.compile(r"[.!?](?=\s|\Z)")  # a mark is a token of its own wherever it stands
CONFIDENCE = 0.9
SLICE = 1024  # texts that are Python objects at a time
BLOCK = 4096  # words that are scored at a time
KNOWN = 1 << 16  # sentences that a task remembers


def sentences(text: str) -> list[list[tuple[str, int]]]:
    """Tokens with their start, sentence by sentence."""
    out: list[list[tuple[str, int]]] = [[]]
    for m in TOKENS.finditer(text):
        out[-1].append((m.group(), m.start()))
        if m.group() in ".!?" and (m.end() == len(text) or text[m.end()].isspace()):
            out.append([])
    return [s for s in out if s]


def pieces_of(text: str) -> list[tuple[str, int]]:
    """The text of each sentence with its start; their tokens are those of ``sentences``."""
    out, at = [], 0
    for m in END.finditer(text):
        out.append((text[at : m.end()], at))
        at = m.end()
    out.append((text[at:], at))
    return [(p.lstrip(), start + len(p) - len(p.lstrip())) for p, start in out if p and not p.isspace()]


def shape(word: str) -> str:
    """Classes of characters, runs of a class as one: Xx, x, X, d, and the mark itself."""
    return re.sub(r"(.)\1+", r"\1", "".join("X" if c.isupper() else "x" if c.isalpha() else "d" if c.isdigit() else c for c in word))


def features(words: list[str], size: int) -> np.ndarray:
    """words x features: places in a table of ``size`` rows."""
    low, look = ["", *[w.lower() for w in words], ""], ["", *[shape(w) for w in words], ""]
    out = []
    for i in range(1, len(words) + 1):
        w, s = low[i], look[i]
        own = ["", f"w={w}", f"s={s}", f"a={w[:3]}", f"z={w[-3:]}", f"-w={low[i - 1]}", f"+w={low[i + 1]}", f"-s={look[i - 1]}", f"+s={look[i + 1]}", f"-ws={low[i - 1]} {s}", f"s+w={s} {low[i + 1]}", f"-s+={look[i - 1]} {s} {look[i + 1]}"]
        out.append([zlib.crc32(x.encode("utf-8", "surrogatepass")) % size for x in own])
    return np.array(out, np.int64)


def viterbi(scores: np.ndarray, moves: np.ndarray) -> list[int]:
    """The best path: scores are words x tags, moves are tags x tags from the row's to the column's; of ties the smaller tags from the end."""
    best, back = scores[0], []
    for row in scores[1:]:
        through = best[:, None] + moves
        back.append(through.argmax(axis=0))
        best = through.max(axis=0) + row
    path = [int(best.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return path[::-1]


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # feature places x tags
    moves: np.ndarray  # tags x tags, from a sentence's start in the last row

    def tags(self) -> list[str]:
        return tags_of(self.labels)


def tags_of(labels: list[str]) -> list[str]:
    return ["O", *[f"{kind}-{name}" for name in labels for kind in "BI"]]


def forbidden(tags: list[str]) -> np.ndarray:
    """Minus infinity where a tag can't follow: an I follows a B or I of its own label; the last row is the start."""
    out = np.zeros((len(tags) + 1, len(tags)))
    for j, tag in enumerate(tags):
        if tag.startswith("I-"):
            for i in range(len(tags) + 1):
                if i == len(tags) or tags[i][2:] != tag[2:]:
                    out[i, j] = -np.inf
    return out


def best_tags(places: np.ndarray, weights: np.ndarray, moves: np.ndarray) -> list[int]:
    scores = weights[places].sum(axis=1)
    scores[0] = scores[0] + moves[-1]
    return viterbi(scores, moves[:-1])


def gold_tags(tokens: list[tuple[str, int]], spans: dict[int, tuple[int, str]], number: dict[str, int]) -> list[int]:
    """spans: start to (end, label); one that does not end with a token is left out."""
    out, i = [0] * len(tokens), 0
    ends = {start + len(w): k for k, (w, start) in enumerate(tokens)}
    for k, (_, start) in enumerate(tokens):
        end, label = spans.get(start, (None, ""))
        if k >= i and end in ends and f"B-{label}" in number:
            i = ends[end] + 1
            out[k:i] = [number[f"B-{label}"], *[number[f"I-{label}"]] * (i - k - 1)]
    return out


def one_pass(rows: list[tuple[np.ndarray, list[int]]], weights: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, ...]:
    """Weights and moves after a pass over (features, tags), and their averages during it. The averages are made from sums of updates by the time of each."""
    start = moves.shape[0] - 1
    w, m, late_w, late_m, now = weights.copy(), moves.copy(), np.zeros_like(weights), np.zeros_like(moves), 1
    for places, gold in rows:
        found = best_tags(places, w, m)
        if found != gold:
            before_g = before_f = start
            for i, (g, f) in enumerate(zip(gold, found, strict=True)):
                if g != f:
                    np.add.at(w, (places[i], g), 1.0)
                    np.add.at(w, (places[i], f), -1.0)
                    np.add.at(late_w, (places[i], g), now)
                    np.add.at(late_w, (places[i], f), -now)
                if (before_g, g) != (before_f, f):
                    m[before_g, g] += 1.0
                    m[before_f, f] -= 1.0
                    late_m[before_g, g] += now
                    late_m[before_f, f] -= now
                before_g, before_f = g, f
        now += 1
    return w, m, w - late_w / now, m - late_m / now


def labelled(docs: DataFrame, spans: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 4000) -> DataFrame:
    """id, text, spans (start, end, label) of at most about max_docs texts that hold a span, chosen by a hash of their id, so that the same ones are chosen wherever they lie. spans: id, start, end, label, disjoint."""
    with_spans = spans.select(id_col).distinct()
    n = max(1, with_spans.count())
    chosen = with_spans.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("teach")), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, max_docs / n))))
    own = spans.join(chosen, id_col, "left_semi").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("spans"))
    return docs.select(id_col, F.col(text_col).alias("text")).where("text IS NOT NULL").join(own, id_col)


def _trainer(weights: np.ndarray, moves: np.ndarray):
    """A shard's sentences to the changes of a pass: (place, change, change of the average); moves stand behind the weights."""
    size, n_rows = weights.shape[0], moves.shape[0]

    def train(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("place", "ascending")])
        rows = [(np.array(p, np.int64).reshape(len(t), -1), t) for p, t in zip(table.column("places").to_pylist(), table.column("tags").to_pylist(), strict=True)]
        w, m, mean_w, mean_m = one_pass(rows, weights, moves)
        at = np.flatnonzero((w != weights).any(axis=1) | (mean_w != weights).any(axis=1))
        finite = np.where(np.isinf(moves), 0.0, moves)
        change = lambda x: np.where(np.isinf(moves), 0.0, x) - finite
        last, mean = np.concatenate([(w - weights)[at], change(m)]), np.concatenate([(mean_w - weights)[at], change(mean_m)])
        places = [*at.tolist(), *range(size, size + n_rows)]
        return pa.Table.from_arrays([pa.array(places, pa.int32()), pa.array(last.tolist(), pa.list_(pa.float64())), pa.array(mean.tolist(), pa.list_(pa.float64()))], names=["place", "last", "mean"])

    return train


def fit(examples: DataFrame, labels: list[str], *, id_col: str = "doc_id", rounds: int = 5, shards: int = 8, size: int = 1 << 16) -> Model:
    """examples: id, text, spans (from ``labelled``, so of bounded number). A model has size x (2 labels + 1) weights."""
    labels = sorted(set(labels))
    tags = tags_of(labels)
    number, n_tags = {t: i for i, t in enumerate(tags)}, len(tags)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, gold, order = [], [], []
            for i, (text, spans) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                own = {s["start"]: (s["end"], s["label"]) for s in spans}
                for tokens in sentences(text):
                    order.append(i)
                    places.append(features([w for w, _ in tokens], size).ravel().astype(np.int32))
                    gold.append(gold_tags(tokens, own, number))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(order, pa.int64())), pa.array(range(len(order)), pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(gold, pa.list_(pa.int32()))], names=["id", "place", "places", "tags"])

    kind = examples.schema[id_col].dataType.simpleString()
    made = examples.select(F.col(id_col).alias("id"), "text", "spans").mapInArrow(prepare, f"id {kind}, place long, places array<int>, tags array<int>")
    made = stored(made.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")), "sentences")
    moves = forbidden(tags)
    weights, sum_w, sum_m = np.zeros((size, n_tags)), np.zeros((size, n_tags)), np.zeros_like(moves)
    for _ in range(rounds):
        each = made.select("shard", "id", "place", "places", "tags").groupBy("shard").applyInArrow(_trainer(weights, moves), "place int, last array<double>, mean array<double>")
        totals = [F.sum(F.col(c)[k]).alias(f"{c}{k}") for c in ("last", "mean") for k in range(n_tags)]
        steps = each.groupBy("place").agg(F.count("*").alias("n"), F.array(*totals[:n_tags]).alias("last"), F.array(*totals[n_tags:]).alias("mean")).collect()
        share = max([r.n for r in steps if r.place >= size], default=1)  # every shard tells its moves
        mean_w, mean_m, weights, moves = weights.copy(), moves.copy(), weights.copy(), moves.copy()
        for r in steps:
            now, mean = (weights, mean_w) if r.place < size else (moves, mean_m)
            now[r.place % size] += np.array(r.last) / share
            mean[r.place % size] += np.array(r.mean) / share
        sum_w, sum_m = sum_w + mean_w, sum_m + mean_m
    return Model(labels, sum_w / rounds, sum_m / rounds)


def viterbi_many(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """``viterbi`` of sentences of one length: scores are sentences x words x tags; a path in each row."""
    best, back = scores[:, 0], []
    for i in range(1, scores.shape[1]):
        through = best[:, :, None] + moves
        back.append(through.argmax(axis=1))
        best = through.max(axis=1) + scores[:, i]
    path, every = [best.argmax(axis=1)], np.arange(len(scores))
    for step in reversed(back):
        path.append(step[every, path[-1]])
    return np.stack(path[::-1], axis=1)


class Spans:
    """Finds spans in texts: sentences met before (``KNOWN`` at most and a slice's) are looked up, all others of one length are tagged at once."""

    def __init__(self, labels: list[str], weights: np.ndarray, moves: np.ndarray):
        self.tags, self.weights, self.moves = tags_of(labels), weights, moves
        self.known: dict[str, list[tuple[int, int, str]]] = {}

    def _learn(self, new: list[str]) -> None:
        groups: dict[int, list[tuple[str, list[tuple[str, int]]]]] = {}
        for piece in new:
            tokens = [(m.group(), m.start()) for m in TOKENS.finditer(piece)]
            if tokens:
                groups.setdefault(len(tokens), []).append((piece, tokens))
            else:
                self.known[piece] = []
        for n, every in groups.items():
            step = max(1, BLOCK // n)
            for at in range(0, len(every), step):
                part = every[at : at + step]
                places = np.array([features([w for w, _ in tokens], self.weights.shape[0]) for _, tokens in part])
                scores = self.weights[places].sum(axis=2)
                scores[:, 0] = scores[:, 0] + self.moves[-1]
                for (piece, tokens), path in zip(part, viterbi_many(scores, self.moves[:-1]).tolist(), strict=True):
                    self.known[piece] = self._spans(tokens, path)

    def _spans(self, tokens: list[tuple[str, int]], path: list[int]) -> list[tuple[int, int, str]]:
        out = []
        for k, tag in enumerate(path):
            if self.tags[tag][0] == "B":
                last = k
                while last + 1 < len(path) and self.tags[path[last + 1]] == f"I-{self.tags[tag][2:]}":
                    last += 1
                out.append((tokens[k][1], tokens[last][1] + len(tokens[last][0]), self.tags[tag][2:]))
        return out

    def __call__(self, texts: list[str | None]) -> tuple[list[int], list[tuple[str, str, int, int]]]:
        """Places of the texts and (entity, label, start, end) of their spans."""
        if len(self.known) > KNOWN:
            self.known.clear()
        pieces = [pieces_of(t or "") for t in texts]
        self._learn(list({p for own in pieces for p, _ in own if p not in self.known}))
        at, found = [], []
        for i, own in enumerate(pieces):
            for piece, start in own:
                for a, b, label in self.known[piece]:
                    at.append(i)
                    found.append((piece[a:b], label, start + a, start + b))
        return at, found


def recognise(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, entity, label, start, end, confidence, source of every span that the model finds; narrow."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((model.labels, model.weights.astype(np.float32), model.moves))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Spans(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows, found = find(batch.column(1).slice(at, SLICE).to_pylist())
                columns = list(zip(*found, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, SLICE).take(pa.array(rows, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int32()), strict=True)]], names=[id_col, "entity", "label", "start", "end"])

    rows = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, entity string, label string, start int, end int")
    return rows.withColumn("confidence", F.lit(CONFIDENCE)).withColumn("source", F.lit("statistical"))


def hidden(entity: Column, share: int = 4) -> Column:
    """Whether a term is kept from training: by its own hash, so all its occurrences are."""
    return F.pmod(F.crc32(F.lower(entity).cast("binary")), F.lit(share)) == 0


def evaluation(found: DataFrame, gold: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """label, n_gold, n_found, n_right, precision, recall, f1 of exact spans; labels of either side. Shares of nothing are null."""
    key = [id_col, "start", "end", "label"]
    both = found.select(*key).distinct().withColumn("f", F.lit(1)).join(gold.select(*key).distinct().withColumn("g", F.lit(1)), key, "full")
    counts = both.groupBy("label").agg(F.count("g").alias("n_gold"), F.count("f").alias("n_found"), F.count(F.when(F.col("f").isNotNull() & F.col("g").isNotNull(), 1)).alias("n_right"))
    p, r = F.try_divide("n_right", "n_found"), F.try_divide("n_right", "n_gold")
    return counts.select("label", "n_gold", "n_found", "n_right", p.alias("precision"), r.alias("recall"), F.try_divide(2 * F.col("n_right"), F.col("n_gold") + F.col("n_found")).alias("f1"))
