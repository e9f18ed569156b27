"""Licence scans: Aho-Corasick finds identifier tags and notice phrases, a shunting-yard parser evaluates expressions.

One automaton runs over a text's words (joined by single spaces), so a phrase is found wherever its words stand
consecutively, overlaps included. A second one finds ``SPDX-License-Identifier:`` tags in the raw text; what follows, to
the end of the line or the next tag and without closing comment marks, is parsed as an expression of identifiers with
AND, OR, WITH and brackets. WITH stands between one licence and one exception. Identifiers are looked up in a catalogue;
a licence has one label, whether a phrase or a tag names it, and unknown identifiers are reported apart.

Null and empty texts have no words and no labels. A malformed expression labels nothing but is counted. Texts are
scanned whole, one row at a time: no shuffle, nothing gathered; equal texts get equal results. Every character belongs to
one expression at most and all steps are linear, so very long texts and lines take time in proportion. Extra columns are
left out, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_columns, lean

# The base phrases with their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Further notice phrases, with the labels that ``canonical`` gives the licences' identifiers.
MORE_PHRASES = {
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license version 2 1": "lgpl-2.1",
    "gnu lesser general public license version 3": "lgpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl-2",
    "gnu affero general public license": "agpl-3",
    "gnu free documentation license": "gfdl",
    "mozilla public license version 2": "mpl-2",
    "mozilla public license version 1 1": "mpl-1.1",
    "eclipse public license v 2": "epl-2",
    "eclipse public license version 2": "epl-2",
    "eclipse public license": "epl",
    "common development and distribution license": "cddl",
    "european union public licence": "eupl",
    "boost software license version 1": "bsl-1",
    "boost software license": "bsl-1",
    "artistic license 2": "artistic-2",
    "academic free license": "afl",
    "open software license": "osl",
    "python software foundation license": "psf-2",
    "microsoft public license": "ms-pl",
    "server side public license": "sspl-1",
    "business source license": "busl",
    "do what the fuck you want to public license": "wtfpl",
    "licensed under the apache license": "apache-2",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "permission is hereby granted free of charge": "mit",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc0 1 0 universal": "cc0",
    "open data commons open database license": "odbl-1",
    "sil open font license": "ofl-1.1",
    "all rights reserved": "all-rights-reserved",
}
# Public identifiers of common licences. Others are a parameter.
IDENTIFIERS = """
0BSD AFL-2.1 AFL-3.0 AGPL-1.0-only AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-1.0-Perl
Artistic-2.0 Beerware BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1
CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-2.0 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-2.0 CC-BY-NC-SA-3.0
CC-BY-NC-SA-4.0 CC-BY-ND-3.0 CC-BY-ND-4.0 CC-BY-SA-2.0 CC-BY-SA-2.5 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CDLA-Permissive-1.0
CDLA-Permissive-2.0 CECILL-2.1 CECILL-B CECILL-C CPAL-1.0 CPL-1.0 curl ECL-2.0 EFL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 FSFAP FTL GFDL-1.1-or-later
GFDL-1.2-only GFDL-1.2-or-later GFDL-1.3-only GFDL-1.3-or-later GPL-1.0 GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0
GPL-3.0-only GPL-3.0-or-later HPND ICU IJG Intel IPL-1.0 ISC JSON LGPL-2.0 LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0
LGPL-3.0-only LGPL-3.0-or-later Libpng LPPL-1.3c MirOS MIT MIT-0 MPL-1.0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NASA-1.3 NCSA NPL-1.1 ODbL-1.0 ODC-By-1.0
OFL-1.0 OFL-1.1 OLDAP-2.8 OpenSSL OSL-2.1 OSL-3.0 PDDL-1.0 PHP-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby SISSL Sleepycat SSPL-1.0 TCL Unicode-3.0
Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zend-2.0 Zlib ZPL-2.0 ZPL-2.1
""".split()
# Public identifiers of common exceptions, which only follow WITH.
EXCEPTIONS = """
389-exception Autoconf-exception-2.0 Autoconf-exception-3.0 Bison-exception-2.2 Bootloader-exception Classpath-exception-2.0 CLISP-exception-2.0
DigiRule-FOSS-exception eCos-exception-2.0 Fawkes-Runtime-exception FLTK-exception Font-exception-2.0 freertos-exception-2.0 GCC-exception-2.0
GCC-exception-3.1 gnu-javamail-exception i2p-gpl-java-exception Libtool-exception Linux-syscall-note LLVM-exception LZMA-exception
Nokia-Qt-exception-1.1 OCaml-LGPL-linking-exception OpenJDK-assembly-exception-1.0 openvpn-openssl-exception PS-or-PDF-font-exception-20170817
Qt-GPL-exception-1.0 Qt-LGPL-exception-1.1 Swift-exception u-boot-exception-2.0 Universal-FOSS-exception-1.0 WxWindows-exception-3.1
""".split()
#: A document's own licences, told from mistyped identifiers by their prefix.
REFERENCES = ("licenseref-", "documentref-")


def canonical(identifier: str) -> str:
    """One label a licence, whether a tag or a phrase names it: lower case, without what only says which later versions hold, without a version's last .0, and without the versions of Creative Commons licences."""
    low = identifier.lower().removesuffix("+")
    low = low.removesuffix("-only").removesuffix("-or-later")
    if low.startswith(("cc-by", "cc0")):
        return re.sub(r"-\d+\.\d+$", "", low)
    return re.sub(r"(-\d+)\.0$", r"\1", low)


TAG = "spdx-license-identifier:"
PRECEDENCE = {"WITH": 3, "AND": 2, "OR": 1}
TAG_WEIGHT, BASE_WEIGHT, MORE_WEIGHT = 0.9, 0.75, 0.5

_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9.\-]+(?::[A-Za-z0-9.\-]+)?\+?)")
_CLOSING = re.compile(r"\*/|-->|#|//|\"|'")


class ExpressionError(ValueError):
    pass


def to_postfix(expression: str) -> list[str]:
    """Shunting-yard: operands in order, operators AND, OR, WITH after theirs."""
    out, stack, operand_next, at = [], [], True, 0
    text = expression.strip()
    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found:
            raise ExpressionError(expression)
        token, at = found[1], found.end()
        word = token.upper()
        if token == "(":
            if not operand_next:
                raise ExpressionError(expression)
            stack.append(token)
        elif token == ")":
            if operand_next:
                raise ExpressionError(expression)
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ExpressionError(expression)
            stack.pop()
        elif word in PRECEDENCE:
            if operand_next:
                raise ExpressionError(expression)
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[word]:
                out.append(stack.pop())
            stack.append(word)
            operand_next = True
        else:
            if not operand_next:
                raise ExpressionError(expression)
            out.append(token)
            operand_next = False
    if operand_next or "(" in stack:
        raise ExpressionError(expression)
    return out + stack[::-1]


def operands(postfix: list[str]) -> list[tuple[str, str | None]]:
    """The licences named, in order, each with its exception or none. WITH stands between a single licence and a single exception."""
    names: list[tuple[str, str | None]] = []
    plain: list[bool] = []  # for each operand on the stack: a single name, not yet with an exception
    for token in postfix:
        if token in PRECEDENCE:
            right, left = plain.pop(), plain.pop()
            if token == "WITH":
                if not (left and right):
                    raise ExpressionError("WITH needs a licence and an exception")
                exception = names.pop()[0]  # single operands stand last
                names[-1] = (names[-1][0], exception)
            plain.append(False)
        else:
            names.append((token, None))
            plain.append(True)
    return names


def identifiers(postfix: list[str], known: frozenset[str] = frozenset(x.lower() for x in IDENTIFIERS), exceptions: frozenset[str] = frozenset(x.lower() for x in EXCEPTIONS)) -> tuple[list[str], list[str]]:
    """Labels of the licences that an expression names, and its unknown identifiers in lower case. A document's own references are labels; with an unknown exception, the licence is a label without it."""
    labels, unknown = [], []
    for name, exception in operands(postfix):
        low = name.lower()
        if low.removesuffix("+") in known or low.startswith(REFERENCES):
            label = low if low.startswith(REFERENCES) else canonical(low)
            if exception is not None and exception.lower() in exceptions:
                label = f"{label} with {exception.lower()}"
            labels.append(label)
        else:
            unknown.append(low)
        if exception is not None and exception.lower() not in exceptions:
            unknown.append(exception.lower())
    return labels, unknown


def permits(postfix: list[str], allowed: set[str]) -> bool:
    """Whether the expression can be met with the allowed licences (labels): AND needs both sides, OR one."""
    stack: list[tuple[bool, str]] = []
    for token in postfix:
        if token in PRECEDENCE:
            (b, right), (a, left) = stack.pop(), stack.pop()
            name = f"{canonical(left)} with {right}"
            stack.append(((name in allowed, name) if token == "WITH" else (a and b, "") if token == "AND" else (a or b, "")))
        else:
            stack.append((canonical(token) in allowed, token.lower()))
    return bool(stack) and stack[0][0]


class Scanner:
    def __init__(self, base: dict[str, str], more: dict[str, str], allowed: set[str], known: Iterable[str] = IDENTIFIERS, exceptions: Iterable[str] = EXCEPTIONS):
        import ahocorasick

        self.allowed = {canonical(a) if " " not in a else a for a in allowed}
        self.known, self.exceptions = frozenset(x.lower() for x in known), frozenset(x.lower() for x in exceptions)
        self.phrases, self.tags = ahocorasick.Automaton(), ahocorasick.Automaton()
        for phrases, is_base in ((more, False), (base, True)):
            for phrase, label in phrases.items():
                self.phrases.add_word(f" {phrase} ", (phrase.count(" "), len(phrase) + 2, label, is_base))
        self.tags.add_word(TAG, 1)
        if len(self.phrases):
            self.phrases.make_automaton()
        self.tags.make_automaton()

    def expressions(self, text: str) -> list[str]:
        """What stands after each identifier tag, to the end of its line or the next tag and without closing comment marks."""
        plain = text.lower()
        if len(plain) != len(text):  # a letter whose lower case is longer: lower A-Z only
            plain = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        starts = [end + 1 for end, _ in self.tags.iter(plain)]
        found = []
        for start, following in zip(starts, [*[s - len(TAG) for s in starts[1:]], len(text)], strict=True):
            line = text.find("\n", start, following)
            stop = following if line < 0 else line
            closing = _CLOSING.search(text, start, stop)
            found.append(text[start : closing.start() if closing else stop].strip())
        return found

    def scan(self, text: str | None) -> dict:
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = _WORD.findall(raw.lower())
        # latin-1 keeps one character a byte, so that places count bytes on both sides
        joined = " " + b" ".join(words).decode("latin-1") + " "
        starts, labels, more, doubt, extra = [], set(), set(), 1.0, 0
        hits = [(end - size + 1, label, is_base) for end, (_, size, label, is_base) in (self.phrases.iter(joined) if len(self.phrases) else ())]
        hits.sort()
        word = at = 0
        for place, label, is_base in hits:
            word += joined.count(" ", at, place)
            at = place
            if is_base:
                starts.append(word)
                labels.add(label)
            else:
                more.add(label)
                extra += 1
        tags = self.expressions(text) if text and b"-identifier:" in raw.lower() else []
        good, permitted, unknown, counted = [], None, set(), 0
        for expression in tags:
            try:
                postfix = to_postfix(expression)
                found, strange = identifiers(postfix, self.known, self.exceptions)
                more.update(found)
                unknown.update(strange)
                counted += bool(found)
                permitted = permits(postfix, self.allowed) and permitted is not False
                good.append(expression)
            except (ExpressionError, IndexError):
                pass
        for n, weight in ((counted, TAG_WEIGHT), (len(starts), BASE_WEIGHT), (extra, MORE_WEIGHT)):
            doubt *= (1 - weight) ** min(n, 64)
        return {"n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(labels | more)), "score": 1 - doubt, "expressions": good, "n_malformed": len(tags) - len(good), "unknown": ",".join(sorted(unknown)), "permitted": permitted}


COLUMNS = [("n_words", pa.int64(), "long"), ("n_base", pa.int64(), "long"), ("first_word", pa.int64(), "long"), ("last_word", pa.int64(), "long"), ("base_labels", pa.string(), "string"), ("labels", pa.string(), "string"), ("score", pa.float64(), "double"), ("expressions", pa.list_(pa.string()), "array<string>"), ("n_malformed", pa.int32(), "int"), ("unknown", pa.string(), "string"), ("permitted", pa.bool_(), "boolean")]


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE_PHRASES, more: dict[str, str] = MORE_PHRASES, allowed: frozenset[str] = frozenset({"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "cc0-1.0", "unlicense"}), known: Iterable[str] = IDENTIFIERS, exceptions: Iterable[str] = EXCEPTIONS) -> DataFrame:
    """id and COLUMNS of every row. Identifiers that ``known`` doesn't have label nothing and don't raise the score; ``unknown`` names them. ``permitted`` says whether all well-formed expressions can be met with ``allowed``; null without any."""
    kind = docs.schema[id_col].dataType.simpleString()
    known, exceptions = list(known), list(exceptions)

    def run(batches):
        scanner = Scanner(base, more, set(allowed), known, exceptions)
        for batch in lean(batches):
            rows = [scanner.scan(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[n] for r in rows], t) for n, t, _ in COLUMNS]], names=[id_col, *[n for n, _, _ in COLUMNS]])

    return doc_columns(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{n} {t}" for n, _, t in COLUMNS))
