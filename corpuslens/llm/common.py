"""What the operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import remove, scratch, shared_dir, stored

__all__ = ["doc_columns", "lean", "remove", "scratch", "shared_dir", "stored", "table", "unused"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: extra ones, whatever their names, can't clash with what an operator adds."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


def unused(name: str, df: DataFrame) -> str:
    """A column name that df doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def lean(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A task's batches in slices of few rows, so that little of them is Python objects at a time; in the end, the memory
    that the allocators still hold goes back: the worker lives on beside those of other stages."""
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
    finally:
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)
        pa.default_memory_pool().release_unused()
