"""Part-of-speech tags: a hidden Markov model by expectation maximisation under a tag dictionary.

A word's possible tags come from a small dictionary of closed classes, from its shape and from its ending; everything
else is open. Forward-backward runs where the texts are, over all of them, for all sentences of one length at a time;
only expected counts are summed in Spark, whose size is tags x tags and words x tags and so does not depend on the
input. The log-likelihood never falls from round to round. Tags are each sentence's best path.

Words are known by themselves if they are among the ``vocabulary`` most frequent (counted over all texts), else by shape
and ending. Tokens and sentences are those of ``recognise``. Null and empty texts have no tokens; an empty table teaches
nothing, and the dictionary alone decides then.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..sources.scratch import stored
from .recognise import sentences, shape

TAGS = ["ADJ", "ADP", "ADV", "CONJ", "DET", "NOUN", "NUM", "PART", "PRON", "PROPN", "PUNCT", "VERB"]
K = len(TAGS)
FIRST = 8.0
OPEN = ("NOUN", "VERB", "ADJ")
# Closed classes of English, an own small dictionary.
CLOSED = {
    "DET": "the a an this that these those each every no some any all both another such",
    "PRON": "i you he she it we they me him her us them who whom which what mine yours hers ours theirs himself herself itself themselves nobody nothing everyone his its their our my your",
    "ADP": "of in on at by for with from to into during after before between among under over against through without within around near until since",
    "CONJ": "and or but nor yet if while because although when where as than whether",
    "VERB": "is are was were be been being has have had do does did will would can could may might shall should must said",
    "ADV": "not very also never always there here then now soon again still too later once often almost quite rather perhaps together away back early late",
    "PART": "to not",
}
ENDINGS = {"ly": ("ADV", "ADJ"), "ing": ("VERB", "NOUN", "ADJ"), "ed": ("VERB", "ADJ"), "tion": ("NOUN",), "ness": ("NOUN",), "ment": ("NOUN",), "ity": ("NOUN",), "ous": ("ADJ",), "ful": ("ADJ",), "able": ("ADJ",), "est": ("ADJ",), "s": ("NOUN", "VERB")}


def _closed() -> dict[str, tuple[str, ...]]:
    out: dict[str, tuple[str, ...]] = {}
    for tag, words in CLOSED.items():
        for w in words.split():
            out[w] = (*out.get(w, ()), tag)
    return out


KNOWN = _closed()
TITLE_WORDS = {w for t in L.TITLES for w in t.split()}


def possible(key: str) -> tuple[str, ...]:
    """Tags that a key may have, the likeliest first; a key is a word, after ^ at a sentence's start, or ~look ending for rarer words."""
    first = key.startswith("^")
    word = key[1:] if first else key
    if word.startswith("~"):
        kind, _, ending = word[1:].partition(" ")
        low = ""
    else:
        low, kind = word.lower(), shape(word)
        ending = next((e for e in ENDINGS if low.endswith(e) and len(low) > len(e) + 2), "")
    if not any(c in kind for c in "xX"):
        return ("NUM",) if "d" in kind else ("PUNCT",)
    if low in KNOWN and (first or not kind.startswith("X")):
        return KNOWN[low]
    if word in TITLE_WORDS:
        return ("PROPN",)
    if "d" in kind:
        return ("NUM", "NOUN", "ADJ")
    own = ENDINGS.get(ending, OPEN)
    if kind.startswith("X"):
        return (*own, "PROPN") if first else ("PROPN", "ADJ") if low.endswith(("an", "ese", "ish")) else ("PROPN",)
    return own


def keys_of(tokens: list[tuple[str, int]]) -> list[str]:
    return [("^" if i == 0 else "") + w for i, (w, _) in enumerate(tokens)]


def look(word: str) -> str:
    """The first three runs of small letters, capitals and digits; other marks are passed over."""
    return re.sub(r"(.)\1+", r"\1", re.sub("[^xXd]", "", shape(word)))[:3]


def rare(key: str) -> str:
    first, word = key.startswith("^") and key != "^", key[1:] if key.startswith("^") and key != "^" else key
    low = word.lower()
    return f"{'^' if first else ''}~{look(word)} {next((e for e in ENDINGS if low.endswith(e) and len(low) > len(e) + 2), '')}"


#: Every class that ``rare`` can give.
CLASSES = [f"{first}~{''.join(runs)} {ending}" for first in ("", "^") for n in range(4) for runs in product("xXd", repeat=n) for ending in ("", *ENDINGS)]


@dataclass
class Model:
    places: dict[str, int]  # of the most frequent keys, and of the classes that stand for all others
    start: np.ndarray  # tags
    moves: np.ndarray  # tags x tags
    words: np.ndarray  # keys x tags: probability of the key, given the tag
    likelihood: list[float]  # log-likelihood before each round

    def place(self, key: str) -> int:
        found = self.places.get(key)
        return self.places[rare(key)] if found is None else found


def allowed(key: str) -> np.ndarray:
    """Where learning starts: the likeliest tag counts several times."""
    own, out = possible(key), np.zeros(K)
    out[[TAGS.index(t) for t in own]] = 1.0
    out[TAGS.index(own[0])] = FIRST
    return out


def forward_backward(e: np.ndarray, start: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sentences of one length, e (sentences x words x tags: probability of each word under each tag): the tags' posteriors, the expected moves of each sentence, and each log-likelihood."""
    b, n, k = e.shape
    alpha, scale = np.empty_like(e), np.empty((b, n))
    now = start * e[:, 0]
    for t in range(n):
        if t:
            now = (alpha[:, t - 1] @ moves) * e[:, t]
        scale[:, t] = now.sum(axis=1)
        alpha[:, t] = now / scale[:, t, None]
    beta, expected = np.ones((b, k)), np.zeros((b, k, k))
    gamma = np.empty_like(e)
    gamma[:, -1] = alpha[:, -1]
    for t in range(n - 2, -1, -1):
        ahead = e[:, t + 1] * beta / scale[:, t + 1, None]
        expected += alpha[:, t, :, None] * moves * ahead[:, None, :]
        beta = ahead @ moves.T
        gamma[:, t] = alpha[:, t] * beta
    return gamma, expected, np.log(scale).sum(axis=1)


def by_length(rows: Iterable[list[int]], most: int = 1 << 16) -> Iterator[tuple[list[int], np.ndarray]]:
    """Rows of places as matrices, all rows of one length together, of bounded size, and which rows they are."""
    groups: dict[int, list[int]] = {}
    rows = list(rows)
    for i, row in enumerate(rows):
        groups.setdefault(len(row), []).append(i)
    for n, own in groups.items():
        step = max(1, most // max(n, K))
        for at in range(0, len(own), step):
            yield own[at : at + step], np.array([rows[i] for i in own[at : at + step]], np.int64)


COUNTS = "kind string, place int, counts array<double>"


def _expected(start: np.ndarray, moves: np.ndarray, words: np.ndarray):
    """Distinct sentences and how often they occur, to expected counts: kind s (start), m (moves, by tag), w (words, by key) and l (log-likelihood)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, m, w, total = np.zeros(K), np.zeros((K, K)), np.zeros_like(words), 0.0
        for batch in batches:
            often = batch.column(1).to_numpy(zero_copy_only=False)
            for own, places in by_length(batch.column(0).to_pylist()):
                n = often[own].astype(np.float64)
                gamma, expected, log_p = forward_backward(words[places], start, moves)
                gamma *= n[:, None, None]
                s += gamma[:, 0].sum(axis=0)
                m += np.tensordot(n, expected, 1)
                np.add.at(w, places, gamma)
                total += n @ log_p
        used = np.flatnonzero(w.any(axis=1))
        kinds = ["s", *["m"] * K, *["w"] * len(used), "l"]
        rows = [s.tolist(), *m.tolist(), *w[used].tolist(), [total]]
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array([0, *range(K), *used.tolist(), 0], pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["kind", "place", "counts"])

    return run


def _normal(x: np.ndarray) -> np.ndarray:
    total = x.sum(axis=-1, keepdims=True)
    return np.divide(x, total, out=np.full_like(x, 1 / x.shape[-1]), where=total > 0)


def fit(docs: DataFrame, *, text_col: str = "text", rounds: int = 8, vocabulary: int = 20_000) -> Model:
    """Learns from all texts, without labels. Sentences that are alike are one row with their number, as they are expected to teach the same."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = Counter(tuple(keys_of(s)) for text in batch.column(0).to_pylist() for s in sentences(text or ""))
            yield pa.RecordBatch.from_arrays([pa.array([list(r) for r in rows], pa.list_(pa.string())), pa.array(list(rows.values()), pa.int64())], names=["keys", "n"])

    own = docs.select(F.col(text_col).alias("text")).mapInArrow(split, "keys array<string>, n long")
    cut = stored(own.groupBy("keys").agg(F.sum("n").alias("n")), "keys", compression="zstd")
    often = cut.select(F.explode("keys").alias("key"), "n").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(vocabulary).collect()
    known = [r.key for r in often]
    places = {k: i for i, k in enumerate(dict.fromkeys([*known, *CLASSES]))}
    mask = np.array([allowed(k) for k in places]).reshape(-1, K)
    model = Model(places, np.full(K, 1 / K), np.full((K, K), 1 / K), _normal(mask.T).T, [])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[model.place(k) for k in keys] for keys in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), batch.column(1)], names=["places", "n"])

    numbered = cut.select("keys", "n").mapInArrow(number, "places array<int>, n long")
    numbered = stored(numbered.groupBy("places").agg(F.sum("n").alias("n")), "places", compression="zstd")
    for _ in range(rounds):
        sums = numbered.mapInArrow(_expected(model.start, model.moves, model.words), COUNTS).groupBy("kind", "place").agg(F.array(*[F.sum(F.get("counts", i)) for i in range(K)]).alias("counts")).collect()
        start, moves, words, total = np.zeros(K), np.zeros((K, K)), np.zeros_like(model.words), 0.0
        for r in sums:
            if r.kind == "l":
                total = r.counts[0]
            else:
                {"s": start[None], "m": moves, "w": words}[r.kind][r.place] = r.counts
        model = Model(places, _normal(start), _normal(moves), np.divide(words, words.sum(axis=0), out=np.zeros_like(words), where=words.sum(axis=0) > 0), [*model.likelihood, total])
    # keys that no sentence had keep what the dictionary allows
    unused = ~model.words.any(axis=1)
    model.words[unused] = mask[unused] * (model.words[model.words > 0].min() if model.words.any() else 1.0)
    return model


def best_path(e: np.ndarray, start: np.ndarray, moves: np.ndarray) -> list[int]:
    with np.errstate(divide="ignore"):
        log_e, log_moves, best, back = np.log(e), np.log(moves), np.log(start) + np.log(e[0]), []
    for row in log_e[1:]:
        through = best[:, None] + log_moves
        back.append(through.argmax(axis=0))
        best = through.max(axis=0) + row
    path = [int(best.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return path[::-1]


def best_paths(e: np.ndarray, start: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """``best_path`` of sentences of one length: e is sentences x words x tags."""
    with np.errstate(divide="ignore"):
        log_e, log_moves, back = np.log(e), np.log(moves), []
        best = np.log(start) + log_e[:, 0]
    for t in range(1, e.shape[1]):
        through = best[:, :, None] + log_moves
        back.append(through.argmax(axis=1))
        best = through.max(axis=1) + log_e[:, t]
    path, row = np.empty(e.shape[:2], np.int64), np.arange(len(e))
    path[:, -1] = best.argmax(axis=1)
    for t in range(len(back) - 1, -1, -1):
        path[:, t] = back[t][row, path[:, t + 1]]
    return path


def tag(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, tokens: array of (text, pos, start, sentence); narrow."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((model.places, model.start, model.moves, model.words))  # plain values: workers need no copy of this package
    item = pa.list_(pa.struct([("text", pa.string()), ("pos", pa.string()), ("start", pa.int32()), ("sentence", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value, [])
        start, moves = m.start + 1e-9, m.moves + 1e-9  # a path always exists
        for batch in batches:
            cut = [[(tuple(keys_of(tokens)), tokens) for tokens in sentences(text or "")] for text in batch.column(1).to_pylist()]
            # sentences that are alike within a batch have one best path
            distinct = list(dict.fromkeys(keys for row in cut for keys, _ in row))
            paths: dict[tuple, list[str]] = {}
            for own, places in by_length([m.place(k) for k in keys] for keys in distinct):
                for i, path in zip(own, best_paths(m.words[places], start, moves).tolist(), strict=True):
                    paths[distinct[i]] = [TAGS[t] for t in path]
            words, tags, places, numbers, bounds = [], [], [], [], [0]
            for row in cut:
                for number, (keys, tokens) in enumerate(row):
                    words += [w for w, _ in tokens]
                    places += [at for _, at in tokens]
                    tags += paths[keys]
                    numbers += [number] * len(tokens)
                bounds.append(len(words))
            columns = zip((words, tags, places, numbers), item.value_type, strict=True)
            out = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in columns], fields=list(item.value_type)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), out], names=[id_col, text_col, "tokens"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, `{text_col}` string, tokens array<struct<text: string, pos: string, start: int, sentence: int>>")


# Nouns that make an event of the proper nouns before them, words that are periods, and eras after a year.
EVENT_NOUNS = ["war", "revolution", "treaty", "conference", "congress", "council", "alliance", "league"]
PERIOD_WORDS = ["century", "era", "age", "period"]
ERAS = ["bc", "ad", "bce", "ce"]


def proper_noun_entities(tagged: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, entity, label, start, end, confidence, source: PERSON is a title and the proper nouns after it, EVENT is proper nouns and the event's noun after them, DATE is a period's word or a year of four digits and its era. Letters' case doesn't matter; longest runs, within a sentence; narrow."""
    kind = tagged.schema[id_col].dataType.simpleString()
    titles = {tuple(t.lower().split()) for t in L.TITLES}
    begins = {t[0] for t in titles}

    def spans(low: list[str], pos: list[str], sentence: list[int]) -> Iterator[tuple[int, int, str]]:
        """First token, token after the last, label."""
        n, size = 0, len(low)
        while n < size:
            title = next((k for k in (2, 1) if tuple(low[n : n + k]) in titles), 0) if low[n] in begins else 0
            end = n + title
            while end < size and sentence[end] == sentence[n] and pos[end] == "PROPN" and low[end] not in EVENT_NOUNS:
                end += 1
            inside = end < size and sentence[end] == sentence[n]
            if title and end > n + title:
                yield n, end, "PERSON"
            elif not title and end > n and inside and low[end] in EVENT_NOUNS:
                end += 1
                yield n, end, "EVENT"
            elif low[n] in PERIOD_WORDS:
                yield n, n + 1, "DATE"
                end = n + 1
            elif len(low[n]) == 4 and low[n].isdigit() and n + 1 < size and sentence[n + 1] == sentence[n] and low[n + 1] in ERAS:
                end = n + 2
                yield n, end, "DATE"
            n = max(end, n + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found, first_token = [], [], 0
            tokens = batch.column(2)
            sizes = [n or 0 for n in pc.list_value_length(tokens).to_pylist()]
            # field by field: a Python value for each token's struct would take most of the time
            words, pos, starts, sentence = (tokens.flatten().field(c).to_pylist() for c in ("text", "pos", "start", "sentence"))
            low = [w.lower() for w in words]
            for i, (text, size) in enumerate(zip(batch.column(1).to_pylist(), sizes, strict=True)):
                own = slice(first_token, first_token + size)
                for first, end, label in spans(low[own], pos[own], sentence[own]):
                    last = first_token + end - 1
                    start, stop = starts[first_token + first], starts[last] + len(words[last])
                    at.append(i)
                    found.append((text[start:stop], label, start, stop))
                first_token += size
            columns = list(zip(*found, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int32()), strict=True)]], names=[id_col, "entity", "label", "start", "end"])

    rows = tagged.select(id_col, text_col, "tokens").mapInArrow(run, f"`{id_col}` {kind}, entity string, label string, start int, end int")
    return rows.withColumn("confidence", F.lit(0.9)).withColumn("source", F.lit("pattern"))
