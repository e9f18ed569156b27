"""Nearest neighbours of a stated query set: blocks of queries, as matrices, against Arrow batches of all rows."""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

SLICE = 256  # rows multiplied at a time


def _unit(column: pa.Array) -> np.ndarray:
    """Rows of length 1; a zero vector stays zero."""
    m = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


class Best:
    """The k nearest of each query so far. Rows come with ids ascending, so of equal ones the first stay."""

    def __init__(self, ids: list, vectors: np.ndarray, k: int):
        self.vectors, self.k, self.least = vectors, k, np.full(len(ids), -np.inf)
        self.found: list[list[tuple[float, object]]] = [[] for _ in ids]

    def add(self, ids: list, rows: np.ndarray) -> None:
        near = np.round(self.vectors @ rows.T, 9)
        for i in np.flatnonzero((near > self.least[:, None]).any(axis=1)).tolist():
            kept = self.found[i]
            for j in np.argsort(-near[i], kind="stable")[: self.k].tolist():
                if near[i, j] <= self.least[i]:
                    break
                at = bisect_left(kept, -near[i, j], key=lambda x: x[0])
                while at < len(kept) and kept[at][0] == -near[i, j]:
                    at += 1
                kept.insert(at, (-near[i, j], ids[j]))
                if len(kept) > self.k:
                    kept.pop()
                if len(kept) == self.k:
                    self.least[i] = -kept[-1][0]


def nearest(vectors: DataFrame, queries: DataFrame, *, id_col: str, vector_col: str, k: int = 3, block: int = 4096) -> DataFrame:
    """query, neighbour, cosine (to nine digits), rank: the k rows nearest to each query (its id is in queries; not itself), ties by id.

    Equal vectors are searched once: of each class of equal rows the k + 1 smallest ids are enough, as only one of them
    may be the query, and equal queries share their k + 1 best rows. Blocks of about ``block`` different queries are taken
    one after the other, so what a task holds is bounded; each block's matrix meets all classes where they are. Only
    k + 1 rows a query class and task are shuffled. A zero vector's cosines are 0; null vectors have no neighbours and
    are none; vectors must be of one length, and ids are unique."""
    kind = vectors.schema[id_col].dataType.simpleString()
    known = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    asked = stored(known.join(queries.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi"), "queries")
    classes = stored(asked.groupBy("v").agg(F.min("id").alias("rep")), "classes")
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    rows = stored(known.withColumn("place", place).where(F.col("place") <= k + 1).select("id", "v"), "rows")
    blocks, found = max(1, math.ceil(classes.count() / block)), []
    rows = spread(rows).sortWithinPartitions("id")

    for number in range(blocks):
        own = classes.where(F.pmod(F.xxhash64("rep"), F.lit(blocks)) == number).collect()
        ids, matrix = [r.rep for r in own], np.array([r.v for r in own], np.float64).reshape(len(own), -1)
        norm = np.linalg.norm(matrix, axis=1, keepdims=True)
        matrix = np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)

        def search(batches, ids=ids, matrix=matrix):
            best, id_type = Best(ids, matrix, k + 1), None
            for batch in batches:
                id_type = batch.schema.field(0).type
                for at in range(0, batch.num_rows if ids else 0, SLICE):
                    best.add(batch.column(0).slice(at, SLICE).to_pylist(), _unit(batch.column(1).slice(at, SLICE)))
            out = [(q, x, -c) for q, kept in zip(ids, best.found, strict=True) for c, x in kept]
            if out:
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (id_type, id_type, pa.float64()), strict=True)], names=["rep", "neighbour", "cosine"])

        part = rows.mapInArrow(search, f"rep {kind}, neighbour {kind}, cosine double")
        found.append(stored(part, "neighbours") if blocks > 1 else part)
    pairs = found[0]
    for part in found[1:]:
        pairs = pairs.union(part)
    best = Window.partitionBy("rep").orderBy(F.desc("cosine"), "neighbour")
    pairs = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1).drop("rank")
    # repeated rows of a query id are one query
    members = asked.join(classes, "v").select(F.col("id").alias("query"), "rep").distinct()
    pairs = members.join(pairs, "rep").where(F.col("query") != F.col("neighbour")).select("query", "neighbour", "cosine")
    order = Window.partitionBy("query").orderBy(F.desc("cosine"), "neighbour")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def spread(rows: DataFrame) -> DataFrame:
    """Rows over all cores, also where they are one small file."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores, "id")
