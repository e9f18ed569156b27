"""Batches that resume: per-document steps over what is not finished yet, committed batch by batch.

A folder holds the steps' tables in parts, one for each committed batch, and a small commit file for each batch, written last
and as a whole. A run

1. reads the commits and leaves out every document that a committed batch has, by id and a hash of its content (an
   anti-join with the commits' keys), so a document whose text changed is done again;
2. deals the rest to batches by a hash and runs all steps on each, every step on what earlier steps of the batch wrote;
3. if a batch fails, halves it by another hash, again and again, until what fails is one document (rows that repeat an id
   and its content fail together): that goes to the quarantine with its error, and the others are committed.

Whatever a killed run had written without a commit is never read. ``load`` gives a step's rows of all committed batches;
of a document that was done again, those of its latest batch.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch

Step = Callable[[dict[str, DataFrame]], DataFrame]
KEY = "_key"
DEEPEST = 60


class Store:
    """The committed batches of a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def commits(self) -> list[dict]:
        names = [n for n in scratch.names_in(self.spark, f"{self.folder}/commits") if n.endswith(".json")]
        return [json.loads(scratch.read_text(self.spark, f"{self.folder}/commits/{n}")) for n in names]

    def _read(self, table: str) -> DataFrame | None:
        """A table's rows of all commits, with the number of their batch."""
        out = None
        for schema, parts in self._by_schema(table).items():
            rows = self.spark.read.schema(schema).parquet(*[p for p, _ in parts])
            number = F.create_map(*[F.lit(x) for p, n in parts for x in (p.rsplit("/", 1)[-1], n)])
            rows = rows.withColumn("_batch", F.element_at(number, F.element_at(F.split(F.input_file_name(), "/"), -2)))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def _by_schema(self, table: str) -> dict[str, list[tuple[str, int]]]:
        found: dict[str, list[tuple[str, int]]] = {}
        for c in self.commits():
            for schema, path in c["tables"].get(table, []):
                found.setdefault(schema, []).append((f"{self.folder}/{path}", c["batch"]))
        return found

    def has(self, table: str) -> bool:
        return bool(self._by_schema(table))

    def finished(self) -> DataFrame | None:
        """id, _key of every document of a committed batch, those in quarantine included; none if nothing is committed."""
        keys = self._read("keys")
        return None if keys is None else keys.drop("_batch").distinct()

    def load(self, table: str, id_col: str = "doc_id") -> DataFrame:
        """A step's rows, or the quarantine's (id, error), of every document's latest batch."""
        rows, keys = self._read(table), self._read("keys")
        if rows is None:
            raise FileNotFoundError(f"no batch has {table}")
        latest = keys.groupBy(id_col).agg(F.max("_batch").alias("_latest")).withColumnRenamed(id_col, "_id")
        return rows.join(latest, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_batch") == F.col("_latest"))).drop("_id", "_latest", "_batch")

    def commit(self, batch: int, tables: dict[str, list[tuple[str, str]]]) -> None:
        scratch.write_text(self.spark, f"{self.folder}/commits/{batch:09d}.json", json.dumps({"batch": batch, "tables": tables}))


def keyed(docs: DataFrame, id_col: str) -> DataFrame:
    """docs with a hash of all columns."""
    return docs.withColumn(KEY, F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), {"ignoreNullFields": "false"}), 256))


def process(docs: DataFrame, folder: str, steps: dict[str, Step], *, id_col: str = "doc_id", batch_docs: int = 100_000, after: Callable[[int], None] | None = None) -> Store:
    """Runs steps on all documents that no committed batch has. A step gets the tables so far: ``documents``, and earlier steps by name; its rows carry the id. after: called with a batch's number once it is committed.

    An empty input commits nothing. Null ids are an id of their own; extra columns are part of the documents, but for
    one named ``_key``, which is an error."""
    if KEY in docs.columns or "documents" in steps or {"keys", "quarantine"} & set(steps):
        raise ValueError("a reserved name")
    spark = docs.sparkSession
    store = Store(spark, folder)
    rows, done = keyed(docs, id_col), store.finished()
    if done is not None:
        same = done.select(F.col(id_col).alias("_id"), F.col(KEY).alias("_done"))
        rows = rows.join(same, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col(KEY) == F.col("_done")), "left_anti")
    # what is to be done is written once: commits made meanwhile must not change the batches
    todo = scratch.stored(rows, "todo", compression="zstd")
    batches = -(-todo.count() // batch_docs)
    first = max([c["batch"] for c in store.commits()], default=0) + 1
    for i in range(batches):
        own = todo.where(F.pmod(F.xxhash64(KEY, F.lit("batch")), F.lit(batches)) == i)
        if own.isEmpty():
            continue
        tables: dict[str, list[tuple[str, str]]] = {}
        _attempt(own, store, steps, id_col, tables, 0)
        _write(own.select(id_col, KEY), store, "keys", tables)
        store.commit(first + i, tables)
        if after:
            after(first + i)
    return store


def _write(df: DataFrame, store: Store, table: str, tables: dict[str, list[tuple[str, str]]]) -> DataFrame:
    path = f"data/{table}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(f"{store.folder}/{path}")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    tables.setdefault(table, []).append((schema, path))
    return store.spark.read.schema(df.schema).parquet(f"{store.folder}/{path}")


def _attempt(own: DataFrame, store: Store, steps: dict[str, Step], id_col: str, tables: dict, depth: int) -> None:
    made: dict[str, list[tuple[str, str]]] = {}
    try:
        known = {"documents": own.drop(KEY)}
        for name, step in steps.items():
            known[name] = _write(step(known), store, name, made)
    except Exception as e:  # whatever a step raises for these documents
        if own.select(KEY).distinct().count() <= 1 or depth >= DEEPEST:
            said = f"{type(e).__name__}: {e}".split("\n\nJVM stacktrace", 1)[0][-2000:]
            _write(own.select(id_col).distinct().withColumn("error", F.lit(said)), store, "quarantine", tables)
            return
        half = F.pmod(F.xxhash64(KEY, F.lit(f"half {depth}")), F.lit(2))
        for k in (0, 1):
            part = own.where(half == k)
            if not part.isEmpty():
                _attempt(part, store, steps, id_col, tables, depth + 1)
        return
    for name, parts in made.items():
        tables.setdefault(name, []).extend(parts)
