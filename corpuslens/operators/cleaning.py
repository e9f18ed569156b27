"""Cleaning that keeps protected spans: the text is split into protected and free segments, and only free ones are cleaned."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import dates as D
from ..functions import text as T

# Abbreviations that cleaning leaves alone.
PROTECTED = ["U.S.", "U.S.S.R.", "U.K.", "B.C.", "A.D.", "C.E.", "B.C.E.", "e.g.", "i.e.", "etc.", "vs.", "viz.", "cf.", "et al."]


def _rules() -> list[tuple[re.Pattern, str]]:
    """The column rules in Python's dialect."""
    space = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

    def python(pattern: str) -> str:
        return pattern.replace(T.NOT_SPACE, space.replace("[", "[^", 1)).replace(T.SPACE, space).replace(T.EDGE, r"[^\w]")

    rules = [(re.compile(python(p)), re.sub(r"\$(\d)", r"\\\1", to)) for p, to in T.UNWANTED]
    for p, to, times in T.OCR:
        rules += [(re.compile(python(p)), re.sub(r"\$(\d)", r"\\\1", to))] * times
    return rules


def cleaned(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, kept columns, text, n_protected: NFKC, typography, removals, scan errors and whitespace, with dates, Roman numerals and abbreviations untouched (leftmost, then longest). Null stays null."""
    kind = docs.schema[id_col].dataType.simpleString()
    typography = str.maketrans(T.TYPOGRAPHY | {"…": "..."})

    def run(batches):
        dates = [re.compile(p, re.IGNORECASE) for p, _ in D.PATTERNS]
        dates += [re.compile(r"\b[IVXLCDM]+\b"), re.compile("|".join(re.escape(a) for a in sorted(PROTECTED, key=len, reverse=True)))]
        rules = _rules()

        def one(text: str | None) -> tuple[str | None, int]:
            if text is None:
                return None, 0
            text = unicodedata.normalize("NFKC", text).translate(typography)
            spans = sorted({(m.start(), -m.end()) for p in dates for m in p.finditer(text)})
            out, at, n = [], 0, 0
            for start, end in spans:
                if start < at:
                    continue
                out += [(text[at:start], False), (text[start:-end], True)]
                at, n = -end, n + 1
            out.append((text[at:], False))
            parts = []
            for part, protected in out:
                if not protected:
                    for pattern, to in rules:
                        part = pattern.sub(to, part)
                parts.append(part)
            lines = (" ".join(line.split()) for line in "".join(parts).split("\n"))
            return "\n".join(line for line in lines if line), n

        for batch in batches:
            rows = [one(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array([t for t, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int32())], names=[id_col, *keep, "text", "n_protected"])

    kept = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(id_col, text_col, *keep).mapInArrow(run, f"`{id_col}` {kind}, {kept}text string, n_protected int")
