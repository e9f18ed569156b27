"""Sentence boundaries learned from the corpus: which words keep a period inside a sentence, and which begin one.

A word that nearly always carries a period is an abbreviation by its log-likelihood against the corpus's share of periods
(short words and inner periods count for it, each sight of it without a period against it), if what follows it mostly
goes on: in lower case, with a digit, or with a word that is capitalised inside sentences too."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..sources.scratch import stored

EDGES = r"^[\"'(\[]+|[,;:!?\"')\]]+$"
WORD = r"^\p{L}[\p{L}.]*$"
END = r"[.!?][\"')\]]*$"
# Fixed values of the published score: the chance of a period after an abbreviation, and the least score.
CERTAIN, LEAST_SCORE = 0.99, 0.3


@dataclass
class Boundaries:
    abbreviations: list[str]  # lower case, without the last period
    starters: list[str]  # words that begin a sentence even after an abbreviation


def _core(token: Column) -> Column:
    return F.regexp_replace(token, EDGES, "")


def _type(core: Column) -> Column:
    return F.lower(F.regexp_replace(core, r"\.$", ""))


def tokens(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """type, period, lower, inside, next_type, next_goes_on for each word: with a period, begun in lower case, capitalised though no sentence ends before it; the word behind, and whether its first letter is small or a digit. Narrow."""
    own = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"{T.NOT_SPACE}+"), F.lit(0))
    t = docs.select(own.alias("own"))
    n = F.size("own")
    t = t.select(F.explode(F.arrays_zip(F.col("own").alias("token"), F.concat(F.array(F.lit(None).cast("string")), F.slice("own", 1, F.greatest(n - 1, F.lit(0)))).alias("last"), F.slice("own", 2, F.greatest(n - 1, F.lit(0))).alias("next"))).alias("x"))
    t = t.select(_core(F.col("x.token")).alias("core"), F.col("x.last").alias("last"), _core(F.col("x.next")).alias("next")).where(F.col("core").rlike(WORD))
    inside = F.col("core").rlike(r"^\p{Lu}") & F.col("last").isNotNull() & ~F.col("last").rlike(END)
    return t.select(_type(F.col("core")).alias("type"), F.col("core").endswith(".").alias("period"), F.col("core").rlike(r"^\p{Ll}").alias("lower"), F.coalesce(inside, F.lit(False)).alias("inside"), _type(F.col("next")).alias("next_type"), F.col("next").rlike(r"^[\p{Ll}0-9]").alias("next_goes_on"))


def type_counts(words: DataFrame) -> DataFrame:
    """type, n, n_period, n_lower, n_inside."""
    sums = [F.count_if(F.col(c)).alias(f"n_{c}") for c in ("period", "lower", "inside")]
    return words.groupBy("type").agg(F.count("*").alias("n"), *sums)


def scores(words: DataFrame, counts: DataFrame) -> DataFrame:
    """type, n, n_period, score, n_continued: of words seen with a period; n_continued of those periods are followed by what goes on.

    A table of pairs (word with a period, next word) meets the counts of the next word; both are sums of the corpus."""
    total = counts.agg(F.sum("n").alias("all"), F.sum("n_period").alias("periods"))  # one row
    name = counts.select(F.col("type").alias("next_type"), (F.col("n_inside") > 0).alias("name"))
    pairs = words.where("period AND next_type IS NOT NULL").groupBy("type", "next_type", "next_goes_on").agg(F.count("*").alias("k"))
    goes = pairs.join(name, "next_type", "left").groupBy("type").agg(F.sum(F.when(F.col("next_goes_on") | F.coalesce("name", F.lit(False)), F.col("k")).otherwise(0)).alias("n_continued"))
    c = counts.where("n_period > 0").join(goes, "type", "left").crossJoin(F.broadcast(total))
    share, bare = F.col("periods") / F.col("all"), F.col("n") - F.col("n_period")
    chance = F.col("n_period") * F.log(share) + F.when(bare > 0, bare * F.log(1 - share)).otherwise(0.0)
    certain = F.col("n_period") * F.log(F.lit(CERTAIN)) + bare * F.log(F.lit(1 - CERTAIN))
    letters = F.length(F.replace("type", F.lit("."), F.lit("")))
    inner = F.length("type") - letters + 1
    score = 2 * (certain - chance) * F.exp(-letters) * inner * F.pow(letters.cast("double"), -bare)
    return c.select("type", "n", "n_period", score.alias("score"), F.coalesce("n_continued", F.lit(0)).alias("n_continued"))


def learn(docs: DataFrame, *, text_col: str = "text", least: int = 5, most: int = 5000) -> Boundaries:
    """Abbreviations seen at least ``least`` times with a period, mostly (half or more) followed by what goes on; and, of the words behind them, those that stand in lower case elsewhere and are never capitalised inside a sentence.

    Counts are those of all texts. ``most`` bounds both lists, the best scored and the most frequent first, as they
    become part of the plan. Null and empty texts have no words; an empty table teaches nothing."""
    words = stored(tokens(docs, text_col=text_col), "tokens")
    counts = stored(type_counts(words), "types")
    kept = scores(words, counts).where((F.col("n_period") >= least) & (F.col("score") >= LEAST_SCORE) & (2 * F.col("n_continued") >= F.col("n_period")))
    found = [r.type for r in kept.orderBy(F.desc("score"), "type").limit(most).collect()]
    known = found + [a.lower().removesuffix(".") for a in L.ABBREVIATIONS]
    behind = words.where(F.col("period") & F.col("type").isin(known) & ~F.col("next_goes_on")).groupBy(F.col("next_type").alias("type")).agg(F.count("*").alias("k"))
    begin = behind.join(counts.where("n_lower > 0 AND n_inside = 0"), "type").orderBy(F.desc("k"), "type").limit(most)
    return Boundaries(found, [r.type for r in begin.collect()])


def sentences(text: Column, learned: Boundaries, fixed: Iterable[str] = L.ABBREVIATIONS) -> Column:
    """Sentences of a text, words joined by one space. They end behind .!? (and closing quotes or brackets), but not after an abbreviation, learned or fixed, unless a capitalised starter follows it. Null for null."""
    known = sorted({*learned.abbreviations, *(a.lower().removesuffix(".") for a in fixed)})
    own = F.regexp_extract_all(text, F.lit(f"{T.NOT_SPACE}+"), F.lit(0))
    after = F.concat(F.slice(own, 2, F.greatest(F.size(own) - 1, F.lit(0))), F.array(F.lit("")))

    def marked(token: Column, follows: Column) -> Column:
        core, behind = _core(token), _core(follows)
        short = core.endswith(".") & _type(core).isin(known)
        begins = behind.rlike(r"^\p{Lu}") & (_type(behind).isin(learned.starters) if learned.starters else F.lit(False))
        return F.when(token.rlike(END) & (~short | begins | (follows == "")), F.concat(token, F.lit("\x1f"))).otherwise(token)

    joined = F.array_join(F.zip_with(own, after, marked), " ")
    return F.filter(F.transform(F.split(joined, "\x1f"), lambda s: F.trim(s)), lambda s: s != "")
