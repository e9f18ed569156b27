"""Scalar text functions as Catalyst expressions: metadata, cleaning, tokens, normalisation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L

# Classes that Java's, RE2's and Python's engines read alike.
SPACE = r"[\t-\r \x{85}\p{Z}]"
NOT_SPACE = r"[^\t-\r \x{85}\p{Z}]"
EDGE = r"[^\p{L}\p{N}_]"
TOKEN = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*|[^\t-\r \x{85}\p{Z}\p{L}\p{N}]"
WORD = r"[\p{L}\p{N}]+"
YEAR = r"(?:^|[^\p{L}\p{N}_])(1[0-9]{3}|20[0-9]{2})(?:$|[^\p{L}\p{N}_])"
KEYWORD = r"[A-Za-z]{4,}"
#: Removals in order: (pattern, replacement with $1). The footer rule spares dates: no digit may stand next to it.
UNWANTED = [
    (rf"\n{SPACE}*[0-9]+{SPACE}*\n", "\n"),
    (rf"(^|[^0-9])-{SPACE}*[0-9]+{SPACE}*-([^0-9]|$)", "$1$2"),
    (rf"https?://{NOT_SPACE}+|www\.{NOT_SPACE}+", ""),
    (rf"{NOT_SPACE}+@{NOT_SPACE}+\.{NOT_SPACE}+", ""),
    (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""),
    (r"[!?.]{2,}([!?.])", "$1"),
    (r"-{3,}", "--"),
]
#: As before, with the original's footer rule, which also eats the month of 1945-08-15.
UNWANTED_COMPAT = [UNWANTED[0], (rf"-{SPACE}*[0-9]+{SPACE}*-", ""), *UNWANTED[2:]]
#: Confusions of characters in scans; rules with an edge on both sides run twice, as neighbours share an edge.
OCR = [
    *[(rf"(^|{EDGE})([A-Z]){wrong}($|{EDGE})", f"$1$2{right}$3", 2) for wrong, right in (("l", "I"), ("1", "I"), ("0", "O"), ("5", "S"))],
    *[(rf"(^|{EDGE}){word}{SPACE}*([A-Z])", f"$1{word} $2", 1) for word in ("the", "and", "of")],
    *[(rf"(^|{EDGE})(?i:{wrong})($|{EDGE})", f"$1{right}$2", 2) for wrong, right in (("rn", "m"), ("cl", "d"), ("vv", "w"))],
]
# Typographic characters and what they become.
TYPOGRAPHY = {"“": '"', "”": '"', "«": '"', "»": '"', "‘": "'", "’": "'", "–": "-", "—": "-", "―": "-"}


def typography(text: Column) -> Column:
    return F.replace(F.translate(text, "".join(TYPOGRAPHY), "".join(TYPOGRAPHY.values())), F.lit("…"), F.lit("..."))


def remove_unwanted(text: Column, compat: bool = False) -> Column:
    for pattern, to in UNWANTED_COMPAT if compat else UNWANTED:
        text = F.regexp_replace(text, pattern, to)
    return text


def fix_ocr(text: Column) -> Column:
    """What the rules of OCR do, in one pass each: edges are looked at, not consumed, and only where the letters fit."""
    inner = r"[\p{L}\p{N}_]"
    for wrong, right in (("[l1]", "I"), ("0", "O"), ("5", "S")):
        text = F.regexp_replace(text, rf"([A-Z]){wrong}(?!{inner})(?<!{inner}[A-Z]{wrong})", f"$1{right}")
    words = "|".join(rf"({w})(?<!{inner}{w})" for w in ("the", "and", "of"))
    text = F.regexp_replace(text, rf"(?:{words}){SPACE}*([A-Z])", "$1$2$3 $4")
    for wrong, right in (("rn", "m"), ("cl", "d"), ("vv", "w")):
        text = F.regexp_replace(text, rf"(?i:{wrong})(?!{inner})(?<!{inner}(?i:{wrong}))", right)
    return text


def normalize_whitespace(text: Column) -> Column:
    """Every line trimmed and its spaces collapsed; blank lines dropped."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, rf"{SPACE}+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def clean(text: Column, compat: bool = False) -> Column:
    """All cleaning steps but Unicode compatibility composition, which needs Python (see operators.cleaning)."""
    return F.trim(normalize_whitespace(fix_ocr(remove_unwanted(typography(text), compat))))


def tokens(text: Column) -> Column:
    """Words (with inner apostrophes and hyphens) and single punctuation marks."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def sentences(text: Column) -> Column:
    """Sentences end at .!? before space, but not after an abbreviation."""
    guarded = text
    for a in L.ABBREVIATIONS:
        guarded = F.replace(guarded, F.lit(f" {a} "), F.lit(f" {a.replace('.', chr(2))} "))
    marked = F.regexp_replace(F.regexp_replace(guarded, rf"{SPACE}+", " "), r"([.!?]+[\"')]*) ", "$1\x1f")
    parts = F.transform(F.split(marked, "\x1f"), lambda s: F.replace(F.trim(s), F.lit("\x02"), F.lit(".")))
    return F.filter(parts, lambda s: s != "")


def normalized_tokens(own: Column, *, remove_punctuation: bool = False, stop_words: Iterable[str] = (), lemmatize: bool = True) -> Column:
    """Per token: contraction, lower case, spelling, lemma, then tokens of fewer than two characters go."""
    both = {k: v for table in (L.CONTRACTIONS,) for k, v in table.items()}
    contraction = F.create_map(*[F.lit(x) for pair in both.items() for x in pair])
    spelling = F.create_map(*[F.lit(x) for pair in L.SPELLINGS.items() for x in pair])

    def one(t: Column) -> Column:
        t = F.lower(t)
        t = F.coalesce(F.try_element_at(contraction, t), t)
        t = F.coalesce(F.try_element_at(spelling, t), t)
        if remove_punctuation:
            t = F.regexp_replace(t, r"[^\p{L}\p{N} ]", "")
        return lemma(t) if lemmatize else t

    out = F.filter(F.transform(own, one), lambda t: F.length(F.trim(t)) >= 2)
    stop = list(stop_words)
    return F.filter(out, lambda t: ~t.isin(stop)) if stop else out


def lemma(word: Column) -> Column:
    """Plural endings of nouns, by rule: stands in for a dictionary lemmatiser, which is not available offline."""
    alpha = word.rlike("^[a-z]{4,}$")
    out = F.when(word.rlike("(ss|us|is)$"), word).when(word.rlike("ies$"), F.regexp_replace(word, "ies$", "y"))
    out = out.when(word.rlike("(ch|sh|x|z|ss)es$"), F.regexp_replace(word, "es$", "")).when(word.rlike("s$"), F.regexp_replace(word, "s$", ""))
    return F.when(alpha, out.otherwise(word)).otherwise(word)


def has_any(text: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(text, F.lit(t))
    return out


def source_type(text: Column) -> Column:
    low, out = F.lower(text), None
    for name, terms in L.SOURCE_TYPES:
        out = (F if out is None else out).when(has_any(low, terms), F.lit(name))
    return out.otherwise(L.OTHER_SOURCE)


def period(year: Column) -> Column:
    out = F.when(year.isNull(), F.lit(None).cast("string"))
    for limit, name in L.PERIODS:
        out = out.when(year < limit, F.lit(name))
    return out.otherwise(L.LAST_PERIOD)


def first_year(text: Column, prefix: int = 2000) -> Column:
    """The first year from 1000 to 2099 that stands alone within the first characters, as the metadata rule has it."""
    found = F.regexp_extract(F.substring(text, 1, prefix), YEAR, 1)
    return F.when(found != "", found.cast("int"))


def valid_text(text: Column) -> Column:
    """At least 100 characters and more than nine tenths printable or space."""
    bad = F.length(F.regexp_replace(text, r"[^\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f]", ""))
    return (F.length(F.trim(text)) >= 100) & (F.length(text) - bad > 0.9 * F.length(text))


def syllables(word: Column) -> Column:
    """Groups of vowels, at least one."""
    return F.greatest(F.regexp_count(word, F.lit("[aeiouyáéíóúàèêëïôûüöä]+")), F.lit(1))
