"""Vector best-fit packing: documents into few sequences under three capacities, tokens, documents and attention cost.

1. Tokenise (narrow). A document's ids and its end mark are one piece; only documents of more than ``size`` tokens are
   cut. Pieces that fill a sequence are one by themselves and take no part in what follows.
2. The other pieces are dealt evenly to groups of about ``group_pieces`` by a hash of their place in the written table,
   so no group's size depends on ids, sources or copies. Only places and lengths move.
3. Within a group, best-fit decreasing on vectors. A piece of n tokens demands (n, 1, n * n) of a bin's residual
   (tokens, documents, attention). Among the bins that can take it under every constraint, it goes to the one with the
   smallest score: the weighted norm of the residual it leaves, or the weighted dot product of its demand and the bin's
   residual. If none can take it, it opens one.

Residuals count as far as later pieces could use them: t tokens hold at most t more documents and t * t more attention.
So a bin whose other two capacities can't bind any more is known by its tokens alone. Such bins stand in one stack
for each number of tokens and the first that is not empty has the smallest score; the others are compared one by one.

By default 2048 documents and 2048 * 2048 attention are what 2048 tokens can hold at most, so that tokens alone decide.

A null text is empty and packs its end mark; repeated rows and ids are packed as often as they come. Texts of any length
are encoded whole. Extra columns are left out, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import json
import math
import os
import re
import sys
import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, stored

END_ID = 0
TOKENS = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
LONG_RUN = 2000

# Characters whose classes and lower case all Unicode versions agree on: Latin without dotted capital I, basic Cyrillic, punctuation.
_LETTERS = "a-zªµºß-öø-ɏа-џ"
_DIGITS = "0-9²³¹¼½¾"
_SAFE = re.compile("[\x01-\x84\x86-\x9f¡-įı-ɏЀ-џ‐-‧‰-⁞€]*")
_APART = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_DIGITS}]|[^ {_LETTERS}{_DIGITS}]+")  # what stands between letters
_WORDS = re.compile("[^ \t-\r]+")
_BLANKS = "\t\n\v\f\r"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[str, int]:
    """The usual letters that stand for bytes in byte-level vocabularies: printable bytes for themselves, the rest from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def encoder(tokenizer_path: str) -> Callable[[str], bytes]:
    """text -> its ids as little-endian 32-bit numbers, as the tokenizer file's own library gives them, nothing added; one encoder a process.

    Texts of safe characters take a shorter way to the same ids: lower case, the file's own split into parts, and
    merging by rank in a faster library, where a space ends each part. That holds for vocabularies whose ids are in
    the order of their merges. The tokenizer drops white space and never joins across it, so of other texts only the
    stretches with such characters, with an added token's string or of extreme length go through the file's library;
    for other vocabularies, all do."""
    made = sys.__dict__.setdefault("_corpuslens_word_encoders", {})
    if tokenizer_path not in made:
        made[tokenizer_path] = _encoder(tokenizer_path)
    return made[tokenizer_path]


def _encoder(tokenizer_path: str) -> Callable[[str], bytes]:
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    whole = Tokenizer.from_file(tokenizer_path)

    def slow(text: str) -> bytes:
        return array("I", whole.encode(text, add_special_tokens=False).ids).tobytes()

    with open(tokenizer_path, encoding="utf-8") as f:
        made = json.load(f)
    model, marks = made["model"], [t["content"] for t in made.get("added_tokens") or []]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges") or []]
    vocabulary = {k: v for k, v in model["vocab"].items() if k not in marks}
    end, first = model.get("end_of_word_suffix"), len(vocabulary) - len(merges)
    if not end or first != 512 or any(vocabulary.get(a + b) != first + i for i, (a, b) in enumerate(merges)):
        return slow
    import tiktoken

    letters, ranks = _byte_letters(), {}
    for token, number in vocabulary.items():
        closed = number >= 256 and token.endswith(end)
        ranks[bytes(letters[c] for c in (token[: -len(end)] if closed else token)) + b" " * closed] = number
    fast = tiktoken.Encoding("words", pat_str="[^ ]++ ", mergeable_ranks=ranks, special_tokens={})

    def is_safe(text: str) -> bool:  # the faster library is quadratic in long parts
        return _SAFE.fullmatch(text) is not None and not any(m in text for m in marks) and (len(text) <= LONG_RUN or max(map(len, text.split()), default=0) <= LONG_RUN)

    def quick(text: str) -> bytes:
        for blank in _BLANKS:
            text = text.replace(blank, " ")
        return array("I", fast.encode_ordinary(_APART.sub(r" \g<0> ", text.lower()) + " ")).tobytes()

    def encode(text: str) -> bytes:
        if is_safe(text):
            return quick(text)
        stretches = itertools.groupby(_WORDS.findall(text), is_safe)
        return b"".join([quick(" ".join(words)) if fit else b"".join(map(slow, words)) for fit, words in stretches])

    return encode


def tokenized_pieces(docs: DataFrame, *, size: int, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """TOKENS, and with with_ids the piece's ids (binary, little-endian 32 bit). uid is a piece's place: task, then running number."""
    path = tokenizer_path or default_path()

    def run(batches):
        from pyspark import TaskContext

        uid, encode, end = TaskContext.get().partitionId() << 40, encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in lean(batches):
            rows, all_ids = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = memoryview(encode(text or "") + end)
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    own = ids[at : at + 4 * size]
                    rows.append((uid, doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own)))
                    if with_ids:
                        all_ids.append(bytes(own))
                    uid += 1
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()], strict=True)]
            names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(all_ids, pa.binary())] * with_ids, names=names + ["ids"] * with_ids)

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, TOKENS + (", ids binary" if with_ids else ""))


class Bins:
    """Open bins of one group, found by what is left in them."""

    def __init__(self, size: int, max_docs: int, max_attention: int, weights: tuple[float, float, float], score: str):
        self.capacity, self.weights, self.by_norm = (size, max_docs, max_attention), weights, score == "norm"
        self.free: list[list[int]] = [[] for _ in range(size + 1)]  # by tokens left: bins in which nothing else can bind
        self.bound: list[dict[tuple[int, int], list[int]]] = [{} for _ in range(size + 1)]  # the others, by documents and attention left
        self.free_levels = self.bound_levels = 0  # bit t: some bin has t tokens left
        self.loads: list[int] = []

    def score(self, n: int, left: tuple[int, int, int]) -> float:
        """Of a piece of n tokens in a bin with that much left: smaller is tighter."""
        if self.by_norm:
            left = usable(left[0] - n, left[1] - 1, left[2] - n * n)
            return sum(w * (x / c) ** 2 for w, x, c in zip(self.weights, left, self.capacity, strict=True))
        return sum(w * (d / c) * (x / c) for w, d, x, c in zip(self.weights, (n, 1, n * n), left, self.capacity, strict=True))

    def _least(self, n: int, tokens: int) -> float:
        """No bin with that many tokens left, or more, scores less."""
        c, w = self.capacity[0], self.weights[0]
        return w * ((tokens - n) / c) ** 2 if self.by_norm else w * (n / c) * (tokens / c)

    def best(self, n: int) -> tuple[int, int, int] | None:
        """What is left in the best bin for a piece of n tokens."""
        found, least = None, math.inf
        levels = self.free_levels >> n
        if levels:
            t = n + (levels & -levels).bit_length() - 1
            found = (t, t, t * t)
            least = self.score(n, found)
        levels = self.bound_levels >> n
        t = n
        while levels:
            step = (levels & -levels).bit_length() - 1
            t += step
            if self._least(n, t) > least:
                break
            for docs, attention in self.bound[t]:
                if docs >= 1 and attention >= n * n:
                    own = self.score(n, (t, docs, attention))
                    if own < least:
                        found, least = (t, docs, attention), own
            levels >>= step + 1
            t += 1
        return found

    def _take(self, left: tuple[int, int, int]) -> int:
        t, docs, attention = left
        if docs >= t and attention >= t * t:
            own = self.free[t].pop()
            if not self.free[t]:
                self.free_levels ^= 1 << t
            return own
        own = self.bound[t][docs, attention].pop()
        if not self.bound[t][docs, attention]:
            del self.bound[t][docs, attention]
            if not self.bound[t]:
                self.bound_levels ^= 1 << t
        return own

    def _put(self, own: int, t: int, docs: int, attention: int) -> None:
        if t <= 0 or docs <= 0 or attention <= 0:
            return  # nothing fits any more
        t, docs, attention = usable(t, docs, attention)
        if docs >= t and attention >= t * t:
            self.free[t].append(own)
            self.free_levels |= 1 << t
        else:
            self.bound[t].setdefault((docs, attention), []).append(own)
            self.bound_levels |= 1 << t

    def place(self, n: int) -> tuple[int, int]:
        """Bin and offset of a piece of n tokens."""
        left = self.best(n)
        if left is None:
            own, left = len(self.loads), self.capacity
            self.loads.append(0)
        else:
            own = self._take(left)
        at = self.loads[own]
        self.loads[own] += n
        self._put(own, left[0] - n, left[1] - 1, left[2] - n * n)
        return own, at


def usable(tokens: int, docs: int, attention: int) -> tuple[int, int, int]:
    """What of a residual later pieces could use: pieces have a token at least, and squares of parts are no more than the whole's square."""
    return tokens, min(docs, tokens), min(attention, tokens * tokens)


def best_fit(lengths: list[int], size: int, max_docs: int, max_attention: int, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), score: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece; longer pieces are placed first."""
    bins, own, at = Bins(size, max_docs, max_attention, weights, score), np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-np.asarray(lengths, np.int64), kind="stable").tolist():
        own[i], at[i] = bins.place(lengths[i])
    return own, at


def pack(docs: DataFrame, *, size: int = 2048, max_docs: int | None = None, max_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), score: str = "norm", group_pieces: int = 1 << 15, with_ids: bool = False, **how) -> DataFrame:
    """PIECES, and with with_ids the piece's ids. A smaller max_attention also shortens the pieces that documents are cut into, so that each fits."""
    if score not in ("norm", "dot") or min(weights) < 0:
        raise ValueError("score is norm or dot, weights are not negative")
    max_docs, max_attention = max_docs or size, max_attention or size * size
    longest = min(size, math.isqrt(max_attention))
    pieces = stored(tokenized_pieces(docs, size=longest, with_ids=with_ids, **how), "pieces", compression="zstd")
    whole, rest = pieces.where(F.col("length") == size), pieces.where(F.col("length") < size)
    groups = max(1, math.ceil(rest.count() / group_pieces))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("uid")
        own, at = best_fit(table.column("length").to_pylist(), size, max_docs, max_attention, weights, score)
        sequence = (table.column("grp")[0].as_py() << 32) + own
        return pa.Table.from_arrays([*[table.column(c) for c in moved], pa.array(sequence), pa.array(at)], names=[*moved, "sequence_id", "offset"])

    # ids don't move: they are joined to their places only where they are asked for
    moved = ["uid"] if with_ids else columns
    out = "uid long, sequence_id long, offset long" if with_ids else PIECES
    placed = rest.withColumn("grp", F.pmod(F.xxhash64("uid"), F.lit(groups))).select("grp", *dict.fromkeys(["uid", "length", *moved])).groupBy("grp").applyInArrow(run, out)
    alone = whole.select(*[c for c in pieces.columns if with_ids or c != "uid"], (-1 - whole["uid"]).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if with_ids:
        return alone.unionByName(rest.join(placed, "uid")).drop("uid")
    return alone.unionByName(placed)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (binary, little-endian 32 bit), doc_ids, starts (of each piece in the sequence): from pack(..., with_ids=True). A sequence has no more than its capacity of pieces."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return parts.select("sequence_id", joined.alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("starts"))
