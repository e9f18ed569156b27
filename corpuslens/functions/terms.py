"""How many terms of each category occur in a text, for all categories in one pass over a batch's bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PLACES = 1 << 16  # of the table that says whether a term may begin with some bytes


class Finder:
    """Terms by their first bytes (as many as the shortest has, three at most): only where a term may begin are its other bytes compared."""

    def __init__(self, categories: list[list[str]]):
        self.n = len(categories)
        names = sorted({t for ts in categories for t in ts})
        if not all(names):
            raise ValueError("a term must not be empty")
        self.terms = [np.frombuffer(t.encode(), np.uint8) for t in names]
        self.categories = [[c for c, ts in enumerate(categories) if t in ts] for t in names]
        self.head = min([3, *[len(t) for t in self.terms]])
        keys = [int(self._keys(t[: self.head])[0]) for t in self.terms]
        self.own = {k: [i for i, x in enumerate(keys) if x == k] for k in sorted(set(keys))}
        self.known = np.zeros(PLACES, bool)
        self.known[list(self.own)] = True

    def _keys(self, data: np.ndarray) -> np.ndarray:
        """One for each place with ``head`` bytes; different bytes may share a key."""
        n = len(data) - self.head + 1
        out = np.zeros(max(0, n), np.uint16)
        for i in range(self.head if n > 0 else 0):
            out *= np.uint16(37)
            out += data[i : i + n]
        return out

    def counts(self, texts: pa.Array) -> np.ndarray:
        """rows x categories: distinct terms that occur. A term never reaches over a row's end."""
        found = np.zeros((len(texts), self.n), np.int32)
        texts = texts.cast(pa.large_string()).fill_null("") if texts.null_count else texts.cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if not len(texts) or ends[0] == ends[-1]:
            return found
        data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        keys = self._keys(data)
        at = np.flatnonzero(self.known[keys])
        own = keys[at]
        order = np.argsort(own, kind="stable")
        at, own = at[order], own[order]
        row = np.searchsorted(ends, at, "right") - 1
        for key, terms in self.own.items():
            a, b = np.searchsorted(own, [key, key + 1])
            for term in terms if a < b else ():
                t = self.terms[term]
                here = a + np.flatnonzero(at[a:b] + len(t) <= ends[row[a:b] + 1])
                for i, byte in enumerate(t):
                    here = here[data[at[here] + i] == byte]
                if len(here):
                    rows = np.unique(row[here])
                    for c in self.categories[term]:
                        found[rows, c] += 1
        return found


def _lists(values: np.ndarray) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(values.ravel()))


def term_counts(text: Column, categories: list[list[str]]) -> Column:
    """For each category the number of its distinct terms that are substrings of the lower-case text; null has none. Of a text only the counts come back."""
    finder = Finder(categories)

    def run(texts: pa.Array) -> pa.Array:
        return _lists(finder.counts(texts))

    return F.arrow_udf(run, "array<int>")(F.lower(text))


def term_rates(text: Column, categories: list[list[str]], n: Column, per: float = 1000.0) -> Column:
    """``term_counts`` over n, times ``per``; 0 where n is. The division is made here, as one for each category in a row's generated code makes that too long to be compiled well."""
    finder = Finder(categories)

    def run(texts: pa.Array, sizes: pa.Array) -> pa.Array:
        size = np.asarray(sizes.cast(pa.float64()).fill_null(0))[:, None]
        found = finder.counts(texts)
        return _lists(np.divide(found, size, out=np.zeros(found.shape), where=size > 0) * per)

    return F.arrow_udf(run, "array<double>")(F.lower(text), n)
