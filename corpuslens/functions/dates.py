"""Dates in text: patterns, parsing, derived fields. All regexes are ASCII and read alike in Java, RE2 and Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
_YEAR = r"(1[0-9]{3}|20[0-9]{2})"
# Patterns in order of precedence, with their precision.
PATTERNS = [
    (r"\b([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})\b", "day"),
    (r"\b([0-9]{1,2})[-/]([0-9]{1,2})[-/]([0-9]{4})\b", "day"),
    (rf"\b({_MONTHS})[a-z]*\s+([0-9]{{4}})\b", "month"),
    (rf"\b{_YEAR}\b", "year"),
    (rf"\b{_YEAR}s'?", "decade"),
    (r"\b([0-9]{1,2})(?:st|nd|rd|th)\s+century\b", "century"),
    (rf"\b{_YEAR}[-–—]{_YEAR}\b", "year"),
    (r"\b([0-9]+)\s+(BCE?|CE|AD)\b", "year"),
    (r"\b(?:circa|c\.?|approx\.?|approximately|around|about)\s+([0-9]{3,4})\b", "approximate"),
    (r"\b(?:Spring|Summer|Autumn|Fall|Winter)(?:\s+of)?\s+([0-9]{4})\b", "month"),
    (r"\b(early|mid|middle|late)\s+([0-9]{1,2})(?:st|nd|rd|th)\s+century\b", "century"),
]
MONTH_NUMBERS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
PRECISIONS = ["year", "month", "day", "decade", "century", "approximate", "unknown"]
#: Which precisions outrank others when events are merged.
RANK = {"day": 3, "month": 2, "year": 1}


def pattern(i: int, start: bool = False) -> str:
    return f"(?i){'^' if start else ''}{PATTERNS[i][0]}"


def month_number(name: Column) -> Column:
    """By the first three letters; unknown names are January."""
    place = F.array_position(F.array(*[F.lit(m) for m in MONTH_NUMBERS]), F.substring(F.lower(name), 1, 3))
    return F.when(place > 0, place.cast("string")).otherwise("1")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once: it is bound as the only element of an array."""
    return F.get(F.transform(F.array(value), use), 0)


def _date(year: Column, month: Column | str, day: Column | str) -> Column:
    part = lambda c, n: F.lpad(c if isinstance(c, Column) else F.lit(c), n, "0")
    text = lambda y: F.concat(part(y, 4), F.lit("-"), part(month, 2), F.lit("-"), part(day, 2))
    return _let(year, lambda y: F.when(F.length(y) <= 4, _let(text(y), lambda t: F.when(F.length(t) == 10, t.try_cast("date")))))


def parse_date(text: Column) -> Column:
    """struct(date, precision, year): the first pattern that fits at the start and gives a valid date.

    1914-1918 is the year 1914, 1960's the year 1960, 1960s the middle of the decade; BCE keeps a positive year; seasons
    and what fits nothing are unknown. A pattern's groups are read only where it fits, and what they give is made once."""
    g = lambda i, n: F.regexp_extract(text, pattern(i, True), n)
    number = lambda c: c.try_cast("int")
    century = lambda c: ((number(c) - 1) * 100 + 50).cast("string")
    dates = [
        (0, lambda: _date(g(0, 1), g(0, 2), g(0, 3)), "day"),
        (1, lambda: _date(g(1, 3), g(1, 2), g(1, 1)), "day"),
        (2, lambda: _date(g(2, 2), month_number(g(2, 1)), "01"), "month"),
        (3, lambda: _date(g(3, 1), "06", "15"), "year"),
        (4, lambda: _date((number(g(4, 1)) + 5).cast("string"), "06", "15"), "decade"),
        (5, lambda: _date(century(g(5, 1)), "06", "15"), "century"),
        (7, lambda: _date(g(7, 1), "06", "15"), "year"),
        (8, lambda: _date(g(8, 1), "06", "15"), "approximate"),
        (10, lambda: _date(century(g(10, 2)), "06", "15"), "century"),
    ]
    found = lambda p: lambda d: F.when(d.isNotNull(), F.struct(d.alias("date"), F.lit(p).alias("precision"), F.year(d).alias("year")))
    rows = [F.when(text.rlike(pattern(i, True)), _let(made(), found(p))) for i, made, p in dates]
    return F.coalesce(*rows, F.struct(F.lit(None).cast("date").alias("date"), F.lit("unknown").alias("precision"), F.lit(None).cast("int").alias("year")))


_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
#: Words that add nothing to a date.
FILLERS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "the", "of", "on", "in", "year", "anno", "domini", "ad", "a.d", "ce"]
ROMAN = "^m{0,2}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"
#: The grammar of what the patterns don't know: a date's parts in order, and the weight of that order. d and y are a day
#: and a year, M a month's name, m its number.
ORDERS = [("dMy", 1.0), ("Mdy", 0.9), ("yMd", 0.9), ("dmy", 0.8), ("ymd", 0.8), ("My", 0.7), ("mdy", 0.6), ("yM", 0.6), ("y", 0.5)]


_FIELDS = {"d": "day", "m": "number", "M": "name", "y": "year"}


def _roman(token: Column) -> Column:
    """1000 to 2099, null for what is no such numeral of two letters or more. Each letter counts, less twice those before a greater one."""
    count = lambda found: F.length(token) - F.length(F.replace(token, F.lit(found), F.lit("")))
    total = sum((count(c) * v for c, v in zip("mdclxvi", (1000, 500, 100, 50, 10, 5, 1), strict=True)), F.lit(0))
    total = total - sum((count(c) * v for c, v in (("cm", 100), ("cd", 100), ("xc", 10), ("xl", 10), ("ix", 1), ("iv", 1))), F.lit(0))
    return F.when(token.rlike(ROMAN) & (F.length(token) >= 2) & total.between(1000, 2099), total)


def _part(kind: str, token: Column) -> Column:
    """What a token means as that part; null if it can't be one."""
    if kind == "d":
        return F.when(token.rlike("^[0-9]{1,2}(st|nd|rd|th)?$"), F.regexp_extract(token, "^[0-9]+", 0).cast("int"))
    if kind == "m":
        return F.when(token.rlike("^[0-9]{1,2}$"), token.try_cast("int"))
    if kind == "y":
        return F.coalesce(F.when(token.rlike("^(1[0-9]{3}|20[0-9]{2})$"), token.try_cast("int")), _roman(token))
    place = lambda names: F.nullif(F.array_position(F.array(*[F.lit(n) for n in names]), token), F.lit(0)).cast("int")
    return F.coalesce(place(_NAMES), place([n[:3] for n in _NAMES]), F.when(token == "sept", 9))


def _reading(order: str, parts: Column) -> Column:
    """The date that the parts give in this order; null if they don't fit it. A day or month that is not said is the first."""
    own = {k.lower(): F.get(parts, i)[_FIELDS[k]].cast("string") for i, k in enumerate(order)}
    return F.when(F.size(parts) == len(order), _date(own["y"], own.get("m", "01"), own.get("d", "01")))


def parse_loose(text: Column) -> Column:
    """struct(date, precision, year) by the heaviest order of the grammar that all of the text's tokens fit as a valid date; null if there is none.

    Tokens are parted by space, commas, slashes, hyphens and periods; fillers are left out; letters may be of either
    case. The precision is what the date shows: a day unless it is the first, a month unless it is January, else a year."""
    tokens = F.filter(F.split(F.lower(text), r"[\s,/.\-]+"), lambda t: (t != "") & ~t.isin(FILLERS))
    meant = F.transform(tokens, lambda t: F.struct(*[_part(k, t).alias(f) for k, f in _FIELDS.items()]))
    heaviest = [o for o, _ in sorted(ORDERS, key=lambda x: -x[1])]
    date = _let(meant, lambda parts: F.coalesce(*[_reading(o, parts) for o in heaviest]))
    precision = lambda d: F.when(F.day(d) != 1, "day").when(F.month(d) != 1, "month").otherwise("year")
    return _let(date, lambda d: F.when(d.isNotNull(), F.struct(d.alias("date"), precision(d).alias("precision"), F.year(d).alias("year"))))


def parse_any(text: Column) -> Column:
    """As parse_date; what the patterns leave unknown is read by the grammar."""
    return _let(parse_date(text), lambda known: F.when(known["date"].isNotNull(), known).otherwise(F.coalesce(parse_loose(text), known)))


_DAY = r"[0-9]{1,2}(?:st|nd|rd|th)?"
#: Dates in words that the patterns don't find as a whole.
LOOSE = [rf"(?i)\b{_DAY}\s+(?:of\s+)?(?:{_MONTHS})[a-z]*\.?,?\s+{_YEAR}\b", rf"(?i)\b(?:{_MONTHS})[a-z]*\.?\s+(?:the\s+)?{_DAY},?\s+{_YEAR}\b", r"\bM[MDCLXVI]{3,}\b"]


def loose_mentions(text: Column) -> Column:
    """Dates in words and Roman years that the grammar accepts, pattern by pattern, duplicates included."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in LOOSE])
    return F.filter(found, lambda x: parse_loose(x).isNotNull())


#: By pattern, the characters that a match can begin with: a look at one comes before the bounds and words are tried.
_FIRST = ["0-9", "0-9", "jfmasond", "0-9", "0-9", "0-9", "0-9", "0-9", "ca", "safw", "eml"]


def mentions(text: Column) -> Column:
    """All matches, pattern by pattern, duplicates included."""
    return F.concat(*[F.regexp_extract_all(text, F.lit(f"(?i)(?=[{first}]){p}"), F.lit(0)) for first, (p, _) in zip(_FIRST, PATTERNS, strict=True)])


def decade(year: Column) -> Column:
    return F.when(year != 0, (F.floor(year / 10) * 10).cast("int"))


def century(year: Column) -> Column:
    return F.when(year != 0, (F.floor((year - 1) / 100) + 1).cast("int"))
