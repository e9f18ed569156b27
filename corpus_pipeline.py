"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import decontamination, language_id, packing, simhash, substrings
from corpuslens.llm.common import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language that the corpus's own labels teach: letterless ones and those in another language or none. A null lang becomes the language found.

    Null and empty texts go. Without any labelled document every text with a letter stays. Repeated rows are judged alike and stay repeated."""
    return language_id.known_language(docs, language_id.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of every group of near copies; of rows that repeat an id, one. Rows with a null id stay."""
    return simhash.representatives(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that occur elsewhere; documents keep what is left, and n_chars follows. Documents of which nothing is left stay as empty texts; null texts stay null."""
    prefix = "_" * (1 + max(len(c) - len(c.lstrip("_")) for c in docs.columns))
    kept = substrings.deduplicate(docs, prefix=prefix)
    n_removed, text = F.col(f"{prefix}n_removed"), F.col(f"{prefix}kept_text")
    renewed = kept.withColumn("n_chars", F.when(n_removed > 0, F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return renewed.withColumn("text", text).select(*docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage; an empty benchmark drops none. Rows that repeat an id are judged each by its own text."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens in the corpus's own mixture; an empty table gives no pieces."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [("language_id", known_languages), ("near_duplicates", near_duplicates), ("substring_dedup", repeated_passages), ("decontamination", benchmark_free), ("packing", packed)]

#: Tokenising can't be expressed in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
