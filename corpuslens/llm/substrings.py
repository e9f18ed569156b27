"""Substring deduplication over a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words of one text. Each window is represented by an anchor: the smallest hash among
its ``GRAM``-word grams. Equal windows have equal anchors, and neighbouring windows mostly share one, so the index
holds about one fingerprint for every 13 windows.

1. Chunks (narrow): a batch's documents are bundled into chunks of about ``chunk_bytes`` of text, written once beside the
   chunk's sorted, distinct anchors.
2. Arrival (``SubstringIndex.add``): the batch's anchors meet those of all historical runs, range by range of hashes, in a
   merge of sorted arrays. That one pass answers for the batch (a bit per anchor: known to history, or repeated in the
   batch), leaves the batch as a new immutable run, and lists what it knows of history; ``fan_in`` runs of a tier are then
   compacted into one of the next. The number of ranges grows with the bytes that meet in them, so a range is about
   ``RANGE_BYTES`` at any size; runs of coarser ranges are cut finer as they are read.
3. Results (``SubstringIndex.results``): earlier chunks look up what later batches have in common with them. Windows whose
   anchor occurs more than once send two 64-bit hashes of all their words, distinct per chunk, and are matched range by
   range. The two are rolled from unrelated hashes of each word (XXH64 and XXH3), so 128 bits decide, not anchors and
   not one hash of a word; the words themselves are not compared.
4. Every word under a window that starts anywhere else in the index too is removed. Windows are judged on the input.

An index is a folder (chunks, runs, and a manifest that names them; a new version for every step, written after what it
names) that any later session can open to add a batch and ask for the new documents' results, or all. Two sessions that
add at the same time: one of them fails. ``deduplicate`` does it for one table in a few batches.

Null and empty texts have no words. Texts of fewer than WINDOW words are kept whole. Repeated rows, and repeats inside
one text, count as copies: all of them lose the passage. Extra columns ride along in the chunks, whatever their names;
in the results one that is named like a result gives way to it, unless ``prefix`` names the results differently.
Texts are read whole; a single text longer than a chunk is a chunk of its own.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.scratch import names_in, read_text, write_text
from .common import lean, remove, scratch, stored

WINDOW, GRAM = 35, 10
RANGE_BYTES = 8 << 20  # of hashes that meet in one range
#: Odd bases of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


class Words:
    """The words of some texts, side by side, with rolling hashes that never cross a text's end."""

    def __init__(self, texts: list[bytes | None], window: int = WINDOW, gram: int = GRAM):
        import xxhash

        self.window, self.gram = window, gram
        self._second: np.ndarray | None = None
        self.tokens: list[bytes] = []
        counts = []
        for text in texts:
            found = _WORD.findall(text) if text else []
            counts.append(len(found))
            self.tokens += found
        self.counts = np.array(counts, np.int64)
        self.ends = np.cumsum(self.counts)
        n = len(self.tokens)
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.tokens), np.uint64, n)
        starts = np.arange(max(0, n - window + 1))
        self.valid = np.flatnonzero(np.repeat(self.ends, self.counts)[starts] >= starts + window) if len(starts) else starts

    def second(self) -> np.ndarray:
        """The words' hashes by a function unrelated to the first one: words that collide in one don't in the other."""
        import xxhash

        if self._second is None:
            self._second = np.fromiter(map(xxhash.xxh3_64_intdigest, self.tokens), np.uint64, len(self.tokens))
        return self._second

    def rolling(self, length: int, base: int) -> np.ndarray:
        """A mixed 64-bit hash of every run of length words."""
        n = len(self.hashes)
        powers = np.ones(n + 1, np.uint64)
        powers[1:] = np.uint64(base)
        powers = np.cumprod(powers)
        back = np.ones(n + 1, np.uint64)
        back[1:] = np.uint64(pow(base, -1, 1 << 64))
        back = np.cumprod(back)
        words = self.hashes if base == BASES[0] else self.second()
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * powers[:n], out=sums[1:])
        return _mix((sums[length:] - sums[:-length]) * back[: n - length + 1])

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each valid window's anchor; the distinct ones, sorted; and which of those stand here more than once."""
        if not len(self.valid):
            none = np.empty(0, np.uint64)
            return none, none, np.empty(0, bool)
        grams = self.rolling(self.gram, BASES[0])
        least, span, want = grams, 1, self.window - self.gram + 1
        while span * 2 <= want:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < want:
            least = np.minimum(least[: len(grams) - want + 1], least[want - span :][: len(grams) - want + 1])
        own = _mix(least[self.valid])  # minima crowd at low values: mixed again, ranges of hashes are even
        distinct = np.unique(own)
        starts = np.arange(len(grams))
        inside = np.repeat(self.ends, self.counts)[starts] >= starts + self.gram
        there, counts = np.unique(_mix(grams[inside]), return_counts=True)
        return own, distinct, counts[np.searchsorted(there, distinct)] > 1

    def candidates(self, repeated: np.ndarray, own: np.ndarray, distinct: np.ndarray):
        """Of the windows whose anchor is repeated: starts, their number in the distinct list, and that list's two hashes and repeats."""
        at = self.valid[repeated[np.searchsorted(distinct, own)]] if len(own) else self.valid
        if not len(at):
            none = np.empty(0, np.uint64)
            return at, np.empty(0, np.int64), none, none, np.empty(0, bool)
        first, second = (self.rolling(self.window, b)[at] for b in BASES)
        order = np.argsort(first, kind="stable")
        if np.any((first[order][1:] == first[order][:-1]) & (second[order][1:] != second[order][:-1])):
            order = np.lexsort((second, first))
        f, s = first[order], second[order]
        fresh = np.concatenate([[True], (f[1:] != f[:-1]) | (s[1:] != s[:-1])])
        number = np.empty(len(at), np.int64)
        number[order] = np.cumsum(fresh) - 1
        return at, number, f[fresh], s[fresh], np.bincount(number) > 1


def _sliced(hashes: np.ndarray, multi: np.ndarray, parts: int, second: np.ndarray | None = None) -> list[dict]:
    """Sorted hashes as one blob for each range (of ``parts``, a power of two) that has any."""
    shift = np.uint64(64 - (parts.bit_length() - 1))
    part = (hashes >> shift).astype(np.int64) if parts > 1 else np.zeros(len(hashes), np.int64)
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(hashes)] if len(hashes) else [0]
    wide = hashes if second is None else np.stack([hashes, second], 1)
    return [{"part": int(part[a]), "n": b - a, "hashes": wide[a:b].tobytes(), "multi": np.packbits(multi[a:b]).tobytes()} for a, b in zip(cuts, cuts[1:], strict=False)]


def ranges(size: int, least: int = 8) -> int:
    """The number of ranges, a power of two, for so many bytes of hashes."""
    return 1 << max(least - 1, -(-size // RANGE_BYTES) - 1).bit_length()


def _flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Merges sorted arrays: distinct hashes, and whether each is repeated in one of them or stands in two."""
    hashes, multi = np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs])
    if not len(hashes):
        return hashes, multi
    order = np.argsort(hashes, kind="stable")  # merges presorted runs
    hashes, multi = hashes[order], multi[order]
    starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    return hashes[starts], np.logical_or.reduceat(multi, starts) | (np.diff(np.append(starts, len(hashes))) > 1)


def _arrays(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for data, bits in zip(table.column("hashes"), table.column("multi"), strict=True):
        hashes = np.frombuffer(data.as_buffer(), np.uint64)
        out.append((hashes, _flags(bits.as_py(), len(hashes))))
    return out


def _cut(blobs: DataFrame, parts: int) -> DataFrame:
    """blobs (chunk_id, batch, hashes sorted, multi) with their hashes dealt to ranges: chunk_id, batch, part, hashes, multi. Narrow."""

    def run(batches):
        for batch in lean(batches):
            for i in range(batch.num_rows):
                hashes = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint64)
                found = _sliced(hashes, _flags(batch.column(3)[i].as_py(), len(hashes)), parts)
                own = [pa.array([batch.column(c)[i].as_py()] * len(found), t) for c, t in ((0, pa.int64()), (1, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*own, pa.array([b["part"] for b in found], pa.int32()), *[pa.array([b[n] for b in found], pa.binary()) for n in ("hashes", "multi")]], names=["chunk_id", "batch", "part", "hashes", "multi"])

    return blobs.select("chunk_id", "batch", "hashes", "multi").mapInArrow(run, PARTED)


PARTED = "chunk_id long, batch int, part int, hashes binary, multi binary"
RUN, BITS, KNOWN = 0, 1, 2  # what a merge leaves: the batch's run, its chunks' answers, and what it has in common with history
ROWS = f"{PARTED}, n int"
MERGED = f"{ROWS}, kind int"


def _merge(table: pa.Table) -> pa.Table:
    """One range of an arriving batch (rows with a chunk_id) and of history (without): MERGED."""
    old = np.asarray(pc.is_null(table.column("chunk_id")))
    arrays, part = _arrays(table), table.column("part")[0].as_py()
    mine = [a for a, r in zip(arrays, old, strict=True) if not r]
    chunks = table.column("chunk_id").filter(pa.array(~old)).to_pylist()
    known = [h for (h, _), r in zip(arrays, old, strict=True) if r]
    history = np.unique(np.concatenate(known)) if known else np.empty(0, np.uint64)
    rows = []
    if mine:
        own, multi = merged(mine)
        there = _among(own, history)
        rows = [(None, own, np.packbits(multi), len(own), RUN), (None, own[there], np.empty(0, np.uint8), int(there.sum()), KNOWN)]
        rows += [(chunk, np.empty(0, np.uint64), np.packbits((multi | there)[np.searchsorted(own, h)]), len(h), BITS) for chunk, (h, _) in zip(chunks, mine, strict=True)]
    batch = max([b for b in table.column("batch").to_pylist() if b is not None], default=None)
    values = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.table({"chunk_id": pa.array(values[0], pa.int64()), "batch": pa.array([batch] * len(rows), pa.int32()), "part": pa.array([part] * len(rows), pa.int32()), "hashes": pa.array([x.tobytes() for x in values[1]], pa.binary()), "multi": pa.array([x.tobytes() for x in values[2]], pa.binary()), "n": pa.array(values[3], pa.int32()), "kind": pa.array(values[4], pa.int32())})


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of some hashes are among the sorted known ones."""
    if not len(known):
        return np.zeros(len(hashes), bool)
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def _later(table: pa.Table) -> pa.Table:
    """One range of chunks and (rows without a chunk_id) of what batches have in common with earlier ones: chunk_id, hashes that a later batch knows."""
    known = np.asarray(pc.is_null(table.column("chunk_id")))
    hashes, numbers = [np.frombuffer(h.as_buffer(), np.uint64) for h in table.column("hashes")], table.column("batch").to_pylist()
    out = []
    lists = [(hashes[i], numbers[i]) for i in np.flatnonzero(known)]
    if lists:
        every, last = np.concatenate([h for h, _ in lists]), np.concatenate([np.full(len(h), n) for h, n in lists])
        order = np.lexsort((last, every))
        every, last = every[order], last[order]
        final = np.append(every[1:] != every[:-1], True)[: len(every)]
        every, last = every[final], last[final]  # each hash with the last batch that knows it
        for i in np.flatnonzero(~known):
            at = np.minimum(np.searchsorted(every, hashes[i]), max(0, len(every) - 1))
            found = hashes[i][(every[at] == hashes[i]) & (last[at] > numbers[i])] if len(every) else every
            if len(found):
                out.append((table.column("chunk_id")[i].as_py(), found.tobytes()))
    return pa.table({"chunk_id": pa.array([c for c, _ in out], pa.int64()), "hashes": pa.array([h for _, h in out], pa.binary())})


class SubstringIndex:
    """A folder of chunks, runs and a manifest. Without a path: in the session's shared folder, deleted when the driver ends."""

    def __init__(self, spark: SparkSession, path: str | None = None, *, fan_in: int = 4):
        self.spark, self.path, self.fan_in = spark, (path or scratch(spark, "index")).rstrip("/"), fan_in
        versions = [n for n in names_in(spark, self.path) if re.fullmatch(r"manifest-[0-9]{9}\.json", n)]
        self.state = json.loads(read_text(spark, f"{self.path}/{versions[-1]}")) if versions else {"version": 0, "folders": [], "batches": [], "tiers": [[]]}

    def _save(self) -> None:
        self.state["version"] += 1
        write_text(self.spark, f"{self.path}/manifest-{self.state['version']:09d}.json", json.dumps(self.state))

    @property
    def runs(self) -> list[dict]:
        return [r for tier in self.state["tiers"] for r in tier]

    def add(self, docs: DataFrame, *, text_col: str = "text", batches: int = 1, chunk_bytes: int = 2 << 20) -> int:
        """Adds documents as one batch or, chunk by chunk, several that arrive one after another; the number of the first."""
        number, first = len(self.state["folders"]), len(self.state["batches"])
        docs = docs.select(F.col(f"`{text_col}`"), *[F.col(f"`{c}`") for c in docs.columns if c != text_col])
        path = f"{self.path}/chunks-{number:06d}-{uuid.uuid4().hex}"
        options = {"compression": "uncompressed", "parquet.page.size.row.check.min": "1"}
        chunked(docs, number=number, chunk_bytes=chunk_bytes).write.options(**options).parquet(path)
        self.state["folders"].append({"path": path, "first": first, "of": batches, "schema": docs.schema.json()})
        for batch in range(first, first + batches):
            self._arrive(batch)
        return first

    def _chunks(self, since: int = 0) -> DataFrame:
        """CHUNK and the number of the batch, from batch ``since`` on."""
        out = None
        for f in self.state["folders"]:
            if f["first"] + f["of"] > since:
                own = self.spark.read.schema(CHUNK).parquet(f["path"]).withColumn("batch", (F.lit(f["first"]) + F.pmod(F.xxhash64("chunk_id"), F.lit(f["of"]))).cast("int"))
                out = own if out is None else out.union(own)
        return out.where(F.col("batch") >= since)

    def _read(self, paths: list[str], kind: int) -> DataFrame:
        there = [f"{p}/kind={kind}" for p in paths if f"kind={kind}" in names_in(self.spark, p)]
        return self.spark.read.schema(ROWS).parquet(*there) if there else self.spark.createDataFrame([], ROWS)

    def _runs(self, runs: list[dict], parts: int) -> DataFrame:
        """PARTED rows of some runs at a number of ranges."""
        same, coarse = [r["path"] for r in runs if r["parts"] == parts], [r["path"] for r in runs if r["parts"] < parts]
        rows = self._read(same, RUN).select("chunk_id", "batch", "part", "hashes", "multi") if same else None
        if coarse:
            cut = _cut(self._read(coarse, RUN), parts)
            rows = cut if rows is None else rows.union(cut)
        return rows

    def _arrive(self, batch: int) -> None:
        """Merges a batch with all runs; its own becomes a run, and full tiers are compacted."""
        own = self._chunks(batch).where(F.col("batch") == batch)
        sizes = own.agg(F.coalesce(F.sum("n_anchors"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
        size = 8 * sizes[0]
        parts = max([ranges(size + sum(r["bytes"] for r in self.runs)), *[r["parts"] for r in self.runs]])
        rows = _cut(own, parts)
        if self.runs:
            rows = rows.union(self._runs(self.runs, parts).select("chunk_id", F.lit(None).cast("int").alias("batch"), "part", "hashes", "multi"))
        path = f"{self.path}/merge-{batch:06d}-{uuid.uuid4().hex}"
        rows.groupBy("part").applyInArrow(_merge, MERGED).write.option("compression", "uncompressed").partitionBy("kind").parquet(path)
        self.state["batches"].append({"path": path, "parts": parts, "words": int(sizes[1])})
        self.state["tiers"][0].append({"path": path, "parts": parts, "bytes": size})
        done = []
        for k in range(1, 64):
            if len(self.state["tiers"][k - 1]) < self.fan_in:
                break
            if len(self.state["tiers"]) == k:
                self.state["tiers"].append([])
            done += self._merged(self.state["tiers"][k - 1], k)
            self.state["tiers"][k - 1] = []
        self._save()
        for path in done:
            remove(self.spark, path)

    def _merged(self, runs: list[dict], tier: int) -> list[str]:
        """Compacts runs into one of a tier; the folders that are no longer needed once the manifest says so."""
        parts, path = max(r["parts"] for r in runs), f"{self.path}/run-{tier}-{uuid.uuid4().hex}"

        def run(table: pa.Table) -> pa.Table:
            hashes, multi = merged(_arrays(table))
            return pa.table({"chunk_id": pa.array([None], pa.int64()), "batch": pa.array([None], pa.int32()), "part": pa.array([table.column("part")[0].as_py()], pa.int32()), "hashes": pa.array([hashes.tobytes()], pa.binary()), "multi": pa.array([np.packbits(multi).tobytes()], pa.binary()), "n": pa.array([len(hashes)], pa.int32()), "kind": pa.array([RUN], pa.int32())})

        self._runs(runs, parts).groupBy("part").applyInArrow(run, MERGED).write.option("compression", "uncompressed").partitionBy("kind").parquet(path)
        self.state["tiers"][tier].append({"path": path, "parts": parts, "bytes": sum(r["bytes"] for r in runs)})
        return [f"{r['path']}/kind={RUN}" for r in runs]

    def compact(self) -> None:
        """Merges all runs into one."""
        if len(self.runs) > 1:
            runs = self.runs
            self.state["tiers"] = [[], []]
            done = self._merged(runs, 1)
            self._save()
            for path in done:
                remove(self.spark, path)

    def _answers(self, since: int) -> DataFrame:
        """chunk_id, answers: what is known of each chunk's anchors, for the results of batches from ``since`` on."""
        batches, parts = self.state["batches"], max(b["parts"] for b in self.state["batches"])
        answers = "struct<part: int, n: int, bits: binary, hashes: binary>"
        bits = self._read([b["path"] for b in batches[since:]], BITS).select("chunk_id", F.struct("part", "n", F.col("multi").alias("bits"), F.lit(None).cast("binary").alias("hashes")).cast(answers).alias("x"))
        if len(batches) > 1:
            known = None
            for i in range(max(1, since), len(batches)):
                rows = self._read([batches[i]["path"]], KNOWN).select(F.lit(None).cast("long").alias("chunk_id"), F.lit(i).alias("batch"), "part", "hashes", "multi")
                rows = rows if batches[i]["parts"] == parts else _cut(rows, parts)
                known = rows if known is None else known.union(rows)
            # a chunk older than all wanted batches answers for what any of them has in common with it
            older = _cut(self._chunks().where(F.col("batch") < len(batches) - 1), parts)
            found = older.union(known).groupBy("part").applyInArrow(_later, "chunk_id long, hashes binary")
            bits = bits.union(found.select("chunk_id", F.struct(F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(None).cast("binary"), "hashes").cast(answers).alias("x")))
        return stored(bits.groupBy("chunk_id").agg(F.collect_list("x").alias("answers")), "anchors")

    def results(self, since: int = 0, *, keep_text: bool = True, keep_sha: bool = False, prefix: str = "") -> DataFrame:
        """All columns but the text of the documents of batches from ``since`` on, judged against the whole index, then n_words, n_removed and, as asked, kept_text (the text itself where nothing is removed, else the kept words joined by one space; null stays null) and kept_sha256 (of the kept words joined by one space)."""
        wanted = [f for f in self.state["folders"] if f["first"] + f["of"] > since]
        if len({f["schema"] for f in wanted}) != 1:
            raise ValueError("the batches' columns differ")
        schema = StructType.fromJson(json.loads(wanted[0]["schema"]))
        answers = self._answers(since)
        # a window takes two hashes; at worst all windows are candidates
        parts = ranges(16 * sum(b["words"] for b in self.state["batches"]))

        def verify(arrow):
            for batch in lean(arrow):
                for i in range(batch.num_rows):
                    chunk_id, data, known = (batch.column(c)[i].as_py() for c in range(3))
                    words = Words(_texts(_rows(data)))
                    own, distinct, _ = words.anchors()
                    _, _, first, second, twice = words.candidates(_repeated(known, distinct), own, distinct)
                    found = _sliced(first, twice, parts, second)
                    yield pa.RecordBatch.from_arrays([pa.array([chunk_id] * len(found), pa.int64()), *[pa.array([b[n] for b in found], t) for n, t in (("part", pa.int32()), ("hashes", pa.binary()), ("multi", pa.binary()))]], names=["chunk_id", "part", "hashes", "multi"])

        # the answers are the small side of each partition: hashed, so that chunks pass by without being sorted
        candidates = self._chunks().select("chunk_id", "docs").join(answers.hint("shuffle_hash"), "chunk_id").mapInArrow(verify, "chunk_id long, part int, hashes binary, multi binary")
        repeated = answers.join(_verified(candidates).groupBy("chunk_id").agg(F.collect_list(F.struct("part", "bits")).alias("checked")), "chunk_id", "left")
        given = [f"{prefix}{n}" for n in ("n_words", "n_removed", *["kept_text"] * keep_text, *["kept_sha256"] * keep_sha)]
        others = [f for f in schema if f.name not in (schema[0].name, *given)]

        def finish(arrow):
            for batch in lean(arrow):
                for i in range(batch.num_rows):
                    data, known, checked = (batch.column(c)[i].as_py() for c in range(3))
                    table = _rows(data)
                    texts = _texts(table)
                    words = Words(texts)
                    own, distinct, _ = words.anchors()
                    covered = np.zeros(len(words.tokens), bool)
                    if len(own) and known:
                        at, number, first, second, twice = words.candidates(_repeated(known, distinct), own, distinct)
                        if len(at):
                            by_part = {a["part"]: a["bits"] for a in checked or []}
                            flags = np.concatenate([_flags(by_part[b["part"]], b["n"]) for b in _sliced(first, twice, parts, second)])
                            at = at[flags[number]]
                            edges = np.zeros(len(words.tokens) + 1, np.int32)
                            np.add.at(edges, at, 1)
                            np.add.at(edges, at + words.window, -1)
                            covered = np.cumsum(edges[:-1]) > 0
                    removed = np.diff(np.concatenate([[0], np.cumsum(covered)])[np.concatenate([[0], words.ends])])
                    out = [table.column(f.name).combine_chunks() for f in others] + [pa.array(words.counts), pa.array(removed.astype(np.int64))]
                    kept = []
                    for k, (end, n, gone) in enumerate(zip(words.ends.tolist(), words.counts.tolist(), removed.tolist(), strict=True)):
                        own_words = words.tokens[end - n : end]
                        kept.append(b" ".join(own_words if not gone else [w for w, c in zip(own_words, covered[end - n : end].tolist(), strict=True) if not c]) if keep_sha or gone else texts[k])
                    if keep_text:
                        out.append(pc.cast(pa.array([k if gone else t for k, gone, t in zip(kept, removed.tolist(), texts, strict=True)], pa.binary()), pa.string()))
                    if keep_sha:
                        out.append(pa.array([hashlib.sha256(k).hexdigest() for k in kept]))
                    out = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in out]
                    yield pa.RecordBatch.from_arrays(out, names=[*[f.name for f in others], *given])

        kinds = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in others], *[f"`{n}` {'long' if n.startswith(f'{prefix}n_') else 'string'}" for n in given]])
        chunks = self._chunks(since).select("chunk_id", "docs")
        return chunks.join(repeated.hint("shuffle_hash"), "chunk_id", "left").select("docs", "answers", "checked").mapInArrow(finish, kinds)


def _packed_rows(batches: list[pa.RecordBatch]) -> bytes:
    table = pa.Table.from_batches(batches).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _rows(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _texts(table: pa.Table) -> list[bytes | None]:
    """A chunk's first column."""
    return pc.cast(table.column(0), pa.binary()).to_pylist()


CHUNK = "chunk_id long, n_words long, n_anchors long, docs binary, hashes binary, multi binary"


def chunked(docs: DataFrame, *, number: int, chunk_bytes: int) -> DataFrame:
    """CHUNK: rows of docs (the first column is the text), compressed, and their anchors. Narrow. Ids follow the folder's number and the task, so a repeated task makes them again."""

    def run(batches):
        from pyspark import TaskContext

        held, size, made = [], 0, (number << 44) + (TaskContext.get().partitionId() << 22)

        def chunk(chunk_id):
            words = Words(_texts(pa.Table.from_batches(held)))
            _, distinct, multi = words.anchors()
            values = [chunk_id, len(words.tokens), len(distinct), _packed_rows(held), distinct.tobytes(), np.packbits(multi).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.int64()] * 3 + [pa.binary()] * 3, strict=True)], names=["chunk_id", "n_words", "n_anchors", "docs", "hashes", "multi"])

        for batch in lean(batches):
            sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(0)), 0)).astype(np.int64)
            at, total = 0, np.concatenate([[0], np.cumsum(sizes)])
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(total, total[at] + chunk_bytes - size, side="right")) - 1)
                held.append(batch.slice(at, end - at))
                size += int(total[end] - total[at])
                at = end
                if at < batch.num_rows or size >= chunk_bytes:
                    yield chunk(made)
                    held, size, made = [], 0, made + 1
        if held:
            yield chunk(made)

    return docs.mapInArrow(run, CHUNK)


def _repeated(answers: list[dict], distinct: np.ndarray) -> np.ndarray:
    """Which of a chunk's sorted anchors stand elsewhere too: bits that cover them all (or none do), and single hashes."""
    bits = [_flags(a["bits"], a["n"]) for a in sorted((a for a in answers if a["bits"] is not None), key=lambda a: a["part"])]
    out = np.concatenate(bits) if bits else np.zeros(len(distinct), bool)
    for a in answers:
        if a["hashes"] is not None:
            out[np.searchsorted(distinct, np.frombuffer(a["hashes"], np.uint64))] = True
    return out


def _verified(blobs: DataFrame) -> DataFrame:
    """chunk_id, part, bits: which windows (two hashes) stand in two chunks or twice in one."""

    def run(table: pa.Table) -> pa.Table:
        pairs = [np.frombuffer(x.as_buffer(), np.uint64).reshape(-1, 2) for x in table.column("hashes")]
        multi = np.concatenate([_flags(b.as_py(), len(p)) for b, p in zip(table.column("multi"), pairs, strict=True)])
        sizes = [len(p) for p in pairs]
        both = np.concatenate(pairs)
        order = np.argsort(both[:, 0], kind="stable")
        f, s = both[order, 0], both[order, 1]
        if np.any((f[1:] == f[:-1]) & (s[1:] != s[:-1])):
            order = np.lexsort((both[:, 1], both[:, 0]))
            f, s = both[order, 0], both[order, 1]
        starts = np.flatnonzero(np.concatenate([[True], (f[1:] != f[:-1]) | (s[1:] != s[:-1])]))
        counts = np.diff(np.append(starts, len(f)))
        repeated = np.empty(len(f), bool)
        repeated[order] = np.repeat((counts > 1) | np.logical_or.reduceat(multi[order], starts), counts)
        bits = [np.packbits(x).tobytes() for x in np.split(repeated, np.cumsum(sizes)[:-1])]
        return pa.table({"chunk_id": table.column("chunk_id"), "part": table.column("part"), "bits": pa.array(bits, pa.binary())})

    return blobs.groupBy("part").applyInArrow(run, "chunk_id long, part int, bits binary")


def deduplicate(docs: DataFrame, *, text_col: str = "text", batches: int = 4, fan_in: int = 4, chunk_bytes: int = 2 << 20, path: str | None = None, keep_text: bool = True, keep_sha: bool = False, prefix: str = "") -> DataFrame:
    """The results of documents that arrive at an index (a new one, or that in ``path``) in some batches."""
    index = SubstringIndex(docs.sparkSession, path, fan_in=fan_in)
    first = index.add(docs, text_col=text_col, batches=batches, chunk_bytes=chunk_bytes)
    return index.results(first, keep_text=keep_text, keep_sha=keep_sha, prefix=prefix)
