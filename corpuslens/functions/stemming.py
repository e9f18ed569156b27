"""Suffix stripping of English words by Porter's published algorithm (1980)."""

from __future__ import annotations

from functools import lru_cache

# The algorithm's suffixes and what takes their place.
SECOND = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(s: str) -> str:
    """A letter for each: v for vowels, c for consonants; y is a vowel after a consonant."""
    out = ""
    for ch in s:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(s: str) -> int:
    return _shape(s).count("vc")


def _short_end(s: str) -> bool:
    return _shape(s).endswith("cvc") and s[-1] not in "wxy"


def _replaced(word: str, table: dict[str, str], least: int) -> str:
    """The longest suffix in the table decides, whether or not what is before it is long enough."""
    for n in range(min(len(word), 7), 1, -1):
        if word[-n:] in table:
            stem = word[:-n]
            kept = word[-n:] != "ion" or stem.endswith(("s", "t"))
            return stem + table[word[-n:]] if kept and _measure(stem) > least else word
    return word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters, and what isn't a-z, stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        cut = 2 if word.endswith("ed") else 3 if word.endswith("ing") else 0
        if cut and "v" in _shape(word[:-cut]):
            word = word[:-cut]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _shape(word).endswith("cc") and word[-1] == word[-2] and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short_end(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(word, SECOND, 0)
    word = _replaced(word, THIRD, 0)
    word = _replaced(word, dict.fromkeys(FOURTH, ""), 1)
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short_end(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word
