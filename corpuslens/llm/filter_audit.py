"""Filter interaction audit: what each order of five quality filters removes, from one SQL CUBE.

1. Every document becomes flags (True where it fails a filter), its part (source) and its labels. Whether a text is a
   copy of a smaller id's is settled among digests: rows collapse to counts per (digest, part, labels) first, so a hot
   text is a few rows, and texts never move.
2. The counts per (part, flags) go through SQL's CUBE over the five flags and the part. A grouping set's row whose
   selected flags are all false counts the documents that survive that subset of filters, in any order.
3. A step of an order adds one filter to a subset: the survivors of the subset and of the larger subset are joined in
   pairs (80 of them for each part), and all measures are differences of the two.
4. The 120 orders by 5 steps are a fixed table of 600 rows that is joined to the pairs.

A null text is empty; a null part is the empty string's. Equal texts are those of equal SHA-256. A null id is no
document's smaller one, and its row is never a copy; rows that repeat an id and a text are not copies of each other, and
each counts. Labels that repeat an id hold if any of its rows says so. An empty table gives no rows. Extra columns, whatever their
names, are left out. Texts of any length are judged whole.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> dict[str, Column]:
    """The conditions that one text decides by itself: True where it fails."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n = F.size(words)
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * n,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def counted(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, A to E, n, good, toxic: documents by the filters they fail, and how many of them are labelled good or toxic."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    seen = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), *[c.alias(k) for k, c in failures(text).items()])
    marks = labels.groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("is_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("is_toxic"))
    marked = seen.join(marks.where("id IS NOT NULL"), "id", "left").fillna(False, ["is_good", "is_toxic"])
    alike = ["digest", "part", *"ABCD", "is_good", "is_toxic"]
    by_id = marked.groupBy("id", *alike).agg(F.count(F.lit(1)).alias("n"))
    # one row for all copies of a text in a part: how many, and the smallest id with its own rows
    texts = by_id.groupBy(*alike).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("without_id"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least")
    )
    texts = stored(texts, "texts")
    first = texts.groupBy("digest").agg(F.min("least.id").alias("first"))
    judged = texts.join(first, "digest").withColumn("kept", F.col("without_id") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0))
    both = judged.select("part", *"ABCD", "is_good", "is_toxic", F.explode(F.array(F.struct(F.lit(False).alias("E"), F.col("kept").alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("kept")).alias("n")))).alias("x"))
    n = F.col("x.n")
    return both.where(n > 0).groupBy("part", *"ABCD", F.col("x.E").alias("E")).agg(F.sum(n).alias("n"), F.sum(F.when(F.col("is_good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("is_toxic"), n).otherwise(0)).alias("toxic"))


def survivors(counts: DataFrame) -> DataFrame:
    """part, subset (bit k: filter k is applied), kept, good, toxic: from SQL's CUBE, the rows of grouping sets with the part whose selected flags are all false. Subsets that nothing survives have no row."""
    cube = counts.sparkSession.sql(
        """
        SELECT part, A, B, C, D, E, grouping(part) AS any_part,
            grouping(A) AS no_a, grouping(B) AS no_b, grouping(C) AS no_c, grouping(D) AS no_d, grouping(E) AS no_e,
            sum(n) AS kept, sum(good) AS good, sum(toxic) AS toxic
        FROM {counts} GROUP BY CUBE (A, B, C, D, E, part)
        """,
        counts=counts,
    )
    selected = [(F.col(k), F.col(f"no_{k.lower()}") == 0) for k in FILTERS]
    clean = F.col("any_part") == 0
    for flag, chosen in selected:
        clean &= ~chosen | ~flag
    subset = sum((F.when(chosen, 1 << k).otherwise(0) for k, (_, chosen) in enumerate(selected)), F.lit(0))
    return cube.where(clean).select("part", subset.alias("subset"), "kept", "good", "toxic")


def pairs(counts: DataFrame) -> DataFrame:
    """part, subset, added (a filter not in it), n_kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: all 80 steps of every part, zeros included."""
    alive = survivors(counts)
    steps = [(s, k, s | 1 << k) for s in range(32) for k in range(5) if not s >> k & 1]
    every = counts.select("part").distinct().select("part", F.explode(F.array(*[F.struct(F.lit(s).alias("subset"), F.lit(k).alias("added"), F.lit(t).alias("larger")) for s, k, t in steps])).alias("x")).select("part", "x.*")
    before = alive.select("part", "subset", F.col("kept").alias("n"), F.col("good").alias("good_n"), F.col("toxic").alias("toxic_n"))
    after = alive.select("part", F.col("subset").alias("larger"), F.col("kept").alias("m"), F.col("good").alias("good_m"), F.col("toxic").alias("toxic_m"))
    joined = every.join(before, ["part", "subset"], "left").join(after, ["part", "larger"], "left").fillna(0)
    weight = F.element_at(F.array(*[F.lit(factorial(i) * factorial(4 - i)) for i in range(5)]), F.bit_count("subset") + 1)  # orders in which this step occurs
    step = joined.select("part", "subset", "added", F.col("m").alias("kept"), (F.col("n") - F.col("m")).alias("removed"), (F.col("good_n") - F.col("good_m")).alias("good_lost"), (F.col("toxic_n") - F.col("toxic_m")).alias("toxic_lost"))
    per_filter = step.groupBy("part", "added").agg(
        F.sum(F.when(F.col("subset") == 0, F.col("removed"))).alias("fails"),  # alone, a filter removes all that fail it
        F.sum(F.when(F.bit_count("subset") == 4, F.col("removed"))).alias("unique_fails"),  # last of all, those that fail nothing else
        F.sum(F.col("removed") * weight).alias("shapley"),
    )
    return step.join(per_filter, ["part", "added"]).withColumn("redundant", F.col("fails") - F.col("removed")).drop("fails")


def orders(spark: SparkSession) -> DataFrame:
    """filter_order, step, subset (what was applied before), added: 600 rows."""
    rows = []
    for order in permutations(range(5)):
        name = "".join(FILTERS[k] for k in order)
        rows += [(name, i + 1, sum(1 << k for k in order[:i]), order[i]) for i in range(5)]
    return spark.createDataFrame(rows, "filter_order string, step int, subset int, added int")


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley (all long)."""
    measures = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = pairs(stored(counted(docs, labels, **columns), "counts")).join(F.broadcast(orders(docs.sparkSession)), ["subset", "added"])  # 600 fixed rows
    return found.select("part", "filter_order", "step", *[F.col(m).cast("long").alias(m) for m in measures])
