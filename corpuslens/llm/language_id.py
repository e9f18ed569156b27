"""Language ID by bit-sliced Bloom filters of character n-grams.

One row of the filter holds a bit for every language. An n-gram sets its language's bit in HASHES rows; a lookup ANDs
those rows and so returns, in one mask, all languages that contain the n-gram. A text's score for a language is the
popcount of its bit over all n-grams, corrected for the filter's false positives and divided by the coverage that the
language's own training texts reach.

Fitting reads a bounded sample: about ``per_language`` texts of each language, picked by a hash of the id. Prediction
is narrow: no shuffle, one broadcast of ``ROWS`` x 8 bytes for every 64 languages, whatever the input.

``known_language`` filters by it: a text whose best score ratio is below ``least`` by more than so few n-grams leave open
(1 / sqrt(n)) is in none of the languages, and goes. Texts that mix learned languages stay (0.53 and more of every clean
text of the check tables; random letters and other scripts reach 0.1).

Null or letterless text: ``und`` with score 0. Rows whose language is null are never learned from. An empty training
set makes every text ``und``. Repeated rows and ties: equal texts get equal results; between equal scores the
alphabetically first language wins. Texts of any length are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_columns, lean

ROWS = 1 << 19
HASHES = 2
ORDERS = (3, 5)
MAX_LANGUAGES = 1024
PIECE = 1 << 18  # bytes looked up at once

_KEEP = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normalized(text: str | None) -> bytes | None:
    """Lower-case letters as UTF-8, other ASCII as single spaces; None if there is no letter."""
    if not text or not any(map(str.isalpha, text)):
        return None
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_KEEP).split()) + b" "


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """Every n-gram of bytes as a mixed 64-bit number."""
    n = len(data) - order + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = data[:n].astype(np.uint64)
    for i in range(1, order):
        out <<= np.uint64(8)
        out |= data[i : i + n]
    out += np.uint64(order << 56)
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out


def _slots(hashes: np.ndarray) -> list[np.ndarray]:
    return [((hashes >> np.uint64(44 - 20 * i)) & np.uint64(ROWS - 1)).astype(np.int64) for i in range(HASHES)]


def _top_grams(frames, top: int, least_rate: float):
    """One language's sample to its frequent n-grams of each order, with their rates."""
    hashes, rates = [], []
    data = np.frombuffer(b"".join(filter(None, map(normalized, frames["text"]))), np.uint8)
    for order in ORDERS:
        values, counts = np.unique(grams(data, order), return_counts=True)
        rate = counts / max(1, counts.sum())
        keep = np.flatnonzero((rate >= least_rate) & (counts > 1))
        keep = keep[np.argsort(-rate[keep], kind="stable")[:top]]
        hashes.append(values[keep])
        rates.append(rate[keep])
    return np.concatenate(hashes), np.concatenate(rates)


class LanguageFilter:
    """The bit-sliced filter with what the decision needs."""

    def __init__(self, by_language: dict[str, tuple[np.ndarray, np.ndarray]], keep_ratio: float):
        self.languages = sorted(by_language)
        self.rows = np.zeros((max(1, -(-len(self.languages) // 64)), ROWS), np.uint64)
        self.coverage = np.ones(len(self.languages))
        best: dict[int, float] = {}
        for hashes, rates in by_language.values():
            for h, r in zip(hashes.tolist(), rates.tolist(), strict=True):
                best[h] = max(r, best.get(h, 0.0))
        for bit, lang in enumerate(self.languages):
            hashes, rates = by_language[lang]
            keep = hashes[rates >= keep_ratio * np.array([best[h] for h in hashes.tolist()])] if len(hashes) else hashes
            self.coverage[bit] = max(rates[rates >= keep_ratio * np.array([best[h] for h in hashes.tolist()])].sum() / len(ORDERS), 1e-3) if len(hashes) else 1.0
            for slot in _slots(keep):
                self.rows[bit // 64, slot] |= np.uint64(1 << bit % 64)
        ones = [((self.rows[b // 64] >> np.uint64(b % 64)) & np.uint64(1)).mean() for b in range(len(self.languages))]
        self.false_rate = np.minimum(np.array(ones) ** HASHES, 0.99)

    def hits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Per text: the popcounts of each language, and the number of n-grams."""
        counts, totals = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= PIECE):
                size += len(texts[end])
                end += 1
            # n-grams across two texts share only a separator that normalized text never holds
            data = np.frombuffer(b"\0".join([*texts[at:end], b""]), np.uint8)
            starts = np.cumsum([0, *[len(t) + 1 for t in texts[at : end - 1]]])
            sizes = np.array([len(t) for t in texts[at:end]])
            for order in ORDERS:
                hashed = grams(data, order)
                if not len(hashed):
                    continue
                first, second = _slots(hashed)
                n = np.maximum(sizes - order + 1, 0)
                inside = np.zeros(len(hashed) + 1, np.int32)
                np.add.at(inside, starts[n > 0], 1)
                np.add.at(inside, (starts + n)[n > 0], -1)
                outside = np.cumsum(inside[:-1]) == 0
                for word, bits in enumerate(self.rows):
                    mask = bits[first] & bits[second]
                    mask[outside] = 0
                    for bit in range(64 * word, min(64 * word + 64, len(self.languages))):
                        ones = np.concatenate([[0], np.cumsum((mask >> np.uint64(bit % 64)) & np.uint64(1), dtype=np.int64)])
                        counts[at:end, bit] += ones[np.minimum(starts + n, len(mask))] - ones[np.minimum(starts, len(mask))]
                totals[at:end] += n
            at = end
        return counts, totals

    def ratios(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Per text: the corrected share of its n-grams that each language has, by that language's coverage; and their number."""
        counts, totals = self.hits(texts)
        corrected = (counts - totals[:, None] * self.false_rate) / (1 - self.false_rate)
        return np.maximum(corrected, 0) / np.maximum(totals, 1)[:, None] / self.coverage, totals

    def evidence(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Per text: the language, its share among the languages' scores, and its ratio with what so few n-grams leave open (0 without letters)."""
        plain = [normalized(t) for t in texts]
        langs, scores, most = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        known = [i for i, p in enumerate(plain) if p is not None]
        if known and self.languages:
            ratios, totals = self.ratios([plain[i] for i in known])
            power = ratios**4
            open_ = ratios.max(1) + 1 / np.sqrt(np.maximum(totals, 1))
            for i, k, share, ratio in zip(known, ratios.argmax(1).tolist(), (power.max(1) / np.maximum(power.sum(1), 1e-300)).tolist(), open_.tolist(), strict=True):
                langs[i], scores[i], most[i] = self.languages[k], min(1.0, share), ratio
        return langs, scores, most

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        return self.evidence(texts)[:2]


def fit(train: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 600, top: int = 20_000, least_rate: float = 2e-6, keep_ratio: float = 0.15) -> LanguageFilter:
    """Learns from about ``per_language`` whole texts of each language; the sample is the only thing gathered by key."""
    rows = train.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return LanguageFilter({}, keep_ratio)
    share = F.lit(None).cast("double")
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))).otherwise(share)
    place = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def learn(frame):
        import pandas as pd

        hashes, rates = _top_grams(frame, top, least_rate)
        return pd.DataFrame({"lang": [frame["lang"].iloc[0]], "hashes": [hashes.tobytes()], "rates": [rates.tobytes()]})

    learned = rows.where(place < share).groupBy("lang").applyInPandas(learn, "lang string, hashes binary, rates binary").collect()
    return LanguageFilter({r["lang"]: (np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["rates"], np.float64)) for r in learned}, keep_ratio)


def predict(docs: DataFrame, model: LanguageFilter, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # plain arrays: executors need not have this module
    kind = next(f.dataType for f in docs.schema if f.name == id_col)

    def run(batches):
        own = LanguageFilter({}, 0)
        vars(own).update(shared.value)
        for batch in lean(batches):
            langs, scores = own.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    return doc_columns(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, lang_pred string, score double")


def known_language(docs: DataFrame, model: LanguageFilter, *, text_col: str = "text", lang_col: str | None = "lang", least: float = 0.25) -> DataFrame:
    """The rows of docs, all columns, whose text is in a language that the model knows; a null lang_col (if there is one) becomes that language. Narrow.

    Null, empty and letterless texts go. A model without languages can't tell: every text with a letter stays."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    place = docs.columns.index(text_col)
    named = docs.columns.index(lang_col) if lang_col in docs.columns and docs.schema[lang_col].dataType.simpleString() == "string" else None

    def run(batches):
        own = LanguageFilter({}, 0)
        vars(own).update(shared.value)
        for batch in lean(batches):
            texts = batch.column(place).to_pylist()
            langs, _, most = own.evidence(texts)
            if not own.languages:
                yield batch.filter(pa.array([normalized(t) is not None for t in texts], pa.bool_()))
                continue
            if named is not None:
                filled = pc.coalesce(batch.column(named), pa.array([None if x == "und" else x for x in langs], batch.column(named).type))
                batch = batch.set_column(named, batch.schema.field(named), filled)
            yield batch.filter(pa.array([m >= least for m in most], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 3, is 1: never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
