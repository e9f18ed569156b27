"""Manifold reduction: an approximate graph of nearest neighbours by neighbour descent, fuzzy weights, and a layout in rounds of attraction and sampled repulsion."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .ml import pca

BLOCK = 32  # rows that meet in a block of a projection's order
SPREAD, TAIL = 1.577, 0.895  # the similarity 1 / (1 + SPREAD * d^(2 * TAIL)) of points of the layout falls off from a distance of 0.1
REPULSION, SAMPLE = 5.0, 64  # what repulsion weighs against attraction; points of a sample that repel each other


def distinct_vectors(vectors: DataFrame, *, id_col: str, vector_col: str) -> DataFrame:
    """id, rep, v: equal vectors share the smallest id as their rep, whose row alone holds the vector; null vectors are left out.

    A group of copies is one point of the graph, so that copies don't crowd out all other neighbours."""
    known = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    own = known.groupBy("id").agg(F.min("v").alias("v"))
    # vectors are named by two hashes of unlike seeds: copies meet as 16 bytes, not as vectors
    ids = own.select("id", F.struct(F.xxhash64("v"), F.xxhash64("v", F.lit(1))).alias("mark"))
    reps = ids.groupBy("mark").agg(F.min("id").alias("rep"))
    named = ids.join(reps, "mark").select("id", "rep")
    return own.join(named, "id").select("id", "rep", F.when(F.col("id") == F.col("rep"), F.col("v")).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _local_join(rows: np.ndarray, fresh: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of each row, of its k nearest rows in the group, and their distances; pairs that have met before are left out."""
    away = np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(axis=2))  # the same in both directions, to the last bit
    away[~(fresh[:, None] | fresh[None])] = np.inf
    np.fill_diagonal(away, np.inf)
    near = np.argsort(away, axis=1, kind="stable")[:, :k]
    found = np.take_along_axis(away, near, axis=1)
    a, at = np.nonzero(np.isfinite(found))
    return a, near[a, at], found[a, at]


def _joined(groups: Iterator[tuple[pa.Array, np.ndarray, np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    for ids, rows, fresh in groups:
        if len(ids) > 1:
            a, b, d = _local_join(rows, fresh, k)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(d)], names=["id", "neighbour", "distance"])


def _in_blocks(k: int) -> Callable:
    """Rows (id, v) in the order of a projection, in blocks of BLOCK."""

    def run(batches):
        blocks = (b.slice(at, BLOCK) for b in batches for at in range(0, b.num_rows, BLOCK))
        yield from _joined(((b.column(0), _matrix(b.column(1)), np.ones(b.num_rows, bool)) for b in blocks), k)

    return run


def _in_groups(k: int) -> Callable:
    """Rows (place, id, v, fresh), those of a place one after the other."""

    def groups(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
            place = t.column(0).combine_chunks()
            if not t.num_rows:
                continue
            ends = [0, *(np.flatnonzero(np.asarray(pa.compute.not_equal(place[1:], place[:-1]).to_numpy(zero_copy_only=False))) + 1).tolist()]
            for start, end in zip(ends[:-1], ends[1:], strict=True):
                yield t.slice(start, end - start)
            held = t.slice(ends[-1])
        if held is not None:
            yield held

    def run(batches):
        parts = (g.combine_chunks() for g in groups(batches))
        yield from _joined(((g.column(1).combine_chunks(), _matrix(g.column(2).combine_chunks()), g.column(3).to_numpy()) for g in parts), k)

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each id, ties by id; a pair found again is fresh only if it was not known before. The rank is limited before the shuffle."""
    order = Window.partitionBy("id").orderBy("distance", "neighbour")
    best = found.withColumn("_r", F.dense_rank().over(order)).where(F.col("_r") <= k)
    return best.groupBy("id", "neighbour").agg(F.min("distance").alias("distance"), F.min("fresh").alias("fresh"))


def neighbour_graph(points: DataFrame, *, k: int = 15, rounds: int = 8, projections: int = 4, settled: float = 0.002, seed: int = 0) -> DataFrame:
    """id, neighbour, distance: about the k nearest points (Euclidean) of each; points has rows (id, v) with distinct ids and vectors of one length.

    It starts from blocks of neighbours in the orders of a few random projections. Each round then brings together, at
    every point, its k neighbours and as many of the points that have it as a neighbour (those of least hash, another
    choice each round), and keeps the k nearest of all that met; pairs that both know from earlier rounds are not
    compared again. So a point costs at most (2k)^2 distances a round however popular it is, and no more than 2k
    vectors meet in one place. It ends when fewer than ``settled`` of the edges changed. Recall is measured in tests;
    blocks follow Spark's range partitions, so that two runs may differ in a few edges. Fewer than two points give no
    edges."""
    kind = points.schema["id"].dataType.simpleString()
    made = f"id {kind}, neighbour {kind}, distance double"
    first = points.select("v").first()
    size = len(first.v) if first else 0
    axes = np.random.default_rng(seed).normal(size=(projections, size)).tolist()

    def project(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((_matrix(b.column(1)) @ np.array(axes).T).tolist(), pa.list_(pa.float64()))] if b.num_rows else [b.column(0), b.column(1), pa.array([], pa.list_(pa.float64()))], names=["id", "v", "p"])

    points = stored(points.select("id", "v").mapInArrow(project, f"id {kind}, v array<double>, p array<double>"), "points")
    n = points.count()
    start = None
    for i in range(projections):
        ordered = points.select("id", "v", F.col("p")[i].alias("_p")).repartitionByRange("_p", "id").sortWithinPartitions("_p", "id").select("id", "v")
        part = ordered.mapInArrow(_in_blocks(k), made)
        start = part if start is None else start.union(part)
    graph = stored(_best(start.withColumn("fresh", F.lit(True)), k), "graph")
    for number in range(rounds):
        back = graph.select(F.col("neighbour").alias("place"), "id", "fresh")
        chosen = Window.partitionBy("place").orderBy(F.xxhash64("place", "id", F.lit(number)), "id")
        back = back.withColumn("_r", F.row_number().over(chosen)).where(F.col("_r") <= k).drop("_r")
        own = points.select(F.col("id").alias("place"), "id", F.lit(False).alias("fresh"))
        met = graph.select(F.col("id").alias("place"), F.col("neighbour").alias("id"), "fresh").union(back).union(own).groupBy("place", "id").agg(F.max("fresh").alias("fresh"))
        met = met.join(points.select("id", "v"), "id").select("place", "id", "v", "fresh")
        found = met.repartition("place").sortWithinPartitions("place", "id").mapInArrow(_in_groups(k), made)
        known = graph.withColumn("fresh", F.lit(False))
        graph = stored(_best(found.withColumn("fresh", F.lit(True)).unionByName(known), k), "graph")
        if graph.where("fresh").count() <= settled * n * k:
            break
    return graph.select("id", "neighbour", "distance")


def _memberships(distances: np.ndarray) -> np.ndarray:
    """exp(-(d - least) / s) with s such that each row sums to log2 of its length; distances ascend, rows are padded with infinity."""
    n = np.isfinite(distances).sum(axis=1, keepdims=True)
    over = np.where(np.isfinite(distances), distances - distances[:, :1], np.inf)
    target = np.log2(np.maximum(n, 1))
    low, high, s = np.zeros(n.shape), np.full(n.shape, np.inf), np.ones(n.shape)
    for _ in range(64):
        much = np.exp(-over / s).sum(axis=1, keepdims=True) > target
        high, low = np.where(much, s, high), np.where(much, low, s)
        s = np.where(np.isinf(high), np.minimum(s * 2, 1e100), np.maximum((low + high) / 2, 1e-100))
    return np.exp(-over / s)


def fuzzy_weights(graph: DataFrame) -> DataFrame:
    """a, b, weight (a before b): the fuzzy union p + q - p * q of both directions' memberships. A point's k distances are in one row."""
    kind = graph.schema["id"].dataType.simpleString()
    rows = graph.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))).alias("x")).select("id", F.col("x.neighbour").alias("near"), F.col("x.distance").alias("d"))

    def run(batches):
        for batch in batches:
            lengths = np.asarray(pa.compute.list_value_length(batch.column(2)))
            if not len(lengths):
                continue
            filled = np.arange(lengths.max())[None] < lengths[:, None]
            padded = np.full(filled.shape, np.inf)
            padded[filled] = np.asarray(batch.column(2).flatten(), np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(lengths)), lengths))), batch.column(1).flatten(), pa.array(_memberships(padded)[filled])], names=["id", "neighbour", "p"])

    p = rows.mapInArrow(run, f"id {kind}, neighbour {kind}, p double")
    pair = p.groupBy(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b"))
    both = F.when(F.count("*") > 1, F.min("p") * F.max("p")).otherwise(0.0)
    return pair.agg((F.sum("p") - both).alias("weight"))


def layout(positions: DataFrame, weights: DataFrame, *, rounds: int = 40) -> DataFrame:
    """id, x, y after rounds that move all points at once, by steps that shrink to nothing.

    A point goes to its neighbours by the weighted mean of their pulls, and away from the others of a sample of about
    SAMPLE points dealt anew by hash each round. Only built-in functions; points without an edge are only pushed."""
    edges = stored(weights.select(F.col("a").alias("id"), F.col("b").alias("to"), "weight").union(weights.select(F.col("b").alias("id"), F.col("a").alias("to"), "weight")), "edges")
    now = stored(positions.select("id", "x", "y"), "positions")
    samples = max(1, math.ceil(now.count() / SAMPLE))
    cut = lambda c: F.greatest(F.lit(-4.0), F.least(F.lit(4.0), c))
    for number in range(rounds):
        other = now.select(F.col("id").alias("to"), F.col("x").alias("tx"), F.col("y").alias("ty"))
        dx, dy = F.col("x") - F.col("tx"), F.col("y") - F.col("ty")
        q = dx * dx + dy * dy
        pull = F.when(q > 0, F.least(F.lit(1.0), 2 * SPREAD * TAIL * F.pow(q, F.lit(TAIL - 1)) / (1 + SPREAD * F.pow(q, F.lit(TAIL))))).otherwise(0.0)
        mean = lambda d: -F.sum(F.col("weight") * pull * d) / F.sum("weight")
        pulled = edges.join(other, "to").join(now, "id").groupBy("id").agg(mean(dx).alias("px"), mean(dy).alias("py"))
        dealt = now.withColumn("sample", F.pmod(F.xxhash64("id", F.lit(number)), F.lit(samples)))
        beside = dealt.select("sample", F.col("id").alias("to"), F.col("x").alias("tx"), F.col("y").alias("ty"))
        push = 2 * TAIL / ((0.001 + q) * (1 + SPREAD * F.pow(q, F.lit(TAIL))))
        pushed = dealt.join(beside, "sample").where(F.col("id") != F.col("to")).groupBy("id").agg(F.avg(cut(push * dx)).alias("rx"), F.avg(cut(push * dy)).alias("ry"))
        step = 1 - number / rounds
        move = lambda p, r: step * cut(F.coalesce(F.col(p), F.lit(0.0)) + REPULSION * F.coalesce(F.col(r), F.lit(0.0)))
        moved = now.join(pulled, "id", "left").join(pushed, "id", "left")
        now = stored(moved.select("id", (F.col("x") + move("px", "rx")).alias("x"), (F.col("y") + move("py", "ry")).alias("y")), "positions")
    return now


def reduce(vectors: DataFrame, *, id_col: str, vector_col: str, k: int = 15, rounds: int = 40) -> DataFrame:
    """id, x0, x1: a layout in which near vectors are near, begun from the principal components.

    Equal vectors share a place. Null vectors have none; one distinct vector is at 0, 0; an empty table gives an empty
    one. Repeated rows of an id count once, by the least of their vectors."""
    rows = stored(distinct_vectors(vectors, id_col=id_col, vector_col=vector_col), "vectors")
    points = rows.where(F.col("v").isNotNull()).select("id", "v")
    if len(points.take(2)) < 2:
        return rows.select(F.col("id").alias(id_col), F.lit(0.0).alias("x0"), F.lit(0.0).alias("x1"))
    begun = stored(pca(points.select("id", array_to_vector("v").alias("vector")), id_col="id"), "components")
    largest = begun.agg(F.max(F.greatest(F.abs("x0"), F.abs("x1")))).first()[0] or 1.0
    begun = begun.select("id", (F.col("x0") * 10 / largest).alias("x"), (F.col("x1") * 10 / largest).alias("y"))
    placed = layout(begun, fuzzy_weights(neighbour_graph(points, k=k)), rounds=rounds)
    return rows.select(F.col("id").alias(id_col), F.col("rep").alias("_rep")).join(placed.withColumnRenamed("id", "_rep"), "_rep").select(id_col, F.col("x").alias("x0"), F.col("y").alias("x1"))
