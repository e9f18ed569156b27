"""Mixture-controlled packing: deficit round-robin over source queues.

1. Tokenise once (narrow): documents become chunks of about ``chunk_tokens`` ids, written as 16-bit numbers to the
   shared folder, with each source's tokens counted.
2. From those counts alone: every source's share, and how much of its queue lies before each chunk. These are prefix
   sums in two levels (tasks, then chunks of a task), so no task sees all chunks.
3. Deficit round-robin in closed form. A window is one sequence of ``window_tokens``. Each window credits every source
   with its share; a source sends whole quanta of ``quantum`` tokens, and what can't be paid out yet is its deficit and
   carries into the next window. So after t windows a source has sent the largest multiple of the quantum within
   t * window_tokens * share, and a queue position tells its window without a look at other chunks: deficits carry
   across windows and partitions, and no source is ever more than a quantum behind its share. Documents are cut where a
   window's credit ends.
4. One shuffle moves the pieces to groups of ``group_windows`` consecutive windows, of bounded size whatever the skew
   of sources. A group's stream, window by window, is cut into sequences of ``size``; its rest is cut into powers of two,
   so no position is padded at all.

Targets default to the sources' shares of the corpus, the only mixture that can hold to the end while every token is
packed once. With others, windows go on without a source once its queue is empty. A null text is empty and packs its
end mark; a null source is a queue of its own; repeated ids are packed as often as they come. Texts of any length are
encoded whole. Extra columns are left out, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, stored

END_ID = 0
CHUNK = "chunk_id long, task int, n_tokens long, ids binary, docs array<struct<doc_id: bigint, source: string, length: int>>, totals array<struct<source: string, tokens: bigint>>"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
LONG_RUN = 2000
RATE = 1 << 32  # rates are tokens a window, in units of one in so many

_SPACES = re.compile(r"\s{%d}" % LONG_RUN)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(tokenizer_path: str, ranks_path: str | None):
    """text -> ids, as the tokenizer file gives them: nothing is added, and strings of the file's added tokens are those tokens.

    With a ranks file of the same vocabulary the faster library is used for all but texts with extremely long runs,
    where its merging is quadratic, and texts that hold such a string. One encoder a process.
    """
    import json
    import sys

    made = sys.__dict__.setdefault("_corpuslens_encoders", {}).setdefault((tokenizer_path, ranks_path), {})
    if "encode" in made:
        return made["encode"]

    def whole(text: str) -> list[int]:
        if "whole" not in made:
            from tokenizers import Tokenizer

            made["whole"] = Tokenizer.from_file(tokenizer_path)
        return made["whole"].encode(text, add_special_tokens=False).ids

    if ranks_path is None:
        return whole
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    with open(tokenizer_path, encoding="utf-8") as f:
        marks = [t["content"] for t in json.load(f).get("added_tokens") or []]

    def encode(text: str) -> list[int]:
        if any(m in text for m in marks):
            return whole(text)
        if len(text) > LONG_RUN and (max(map(len, text.split()), default=0) > LONG_RUN or _SPACES.search(text)):
            return whole(text)
        return fast.encode_ordinary(text)

    made["encode"] = encode
    return encode


def tokenized_chunks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chunk_tokens: int = 1 << 20, tokenizer_path: str | None = None, ranks_path: str | None = None, end_id: int = END_ID) -> DataFrame:
    if tokenizer_path is None:
        tokenizer_path, ranks_path = default_paths()

    def run(batches):
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        encode = encoder(tokenizer_path, ranks_path)
        ids, rows, held = [], [], 0

        def chunk():
            totals: dict[str, int] = {}
            for r in rows:
                totals[r["source"]] = totals.get(r["source"], 0) + r["length"]
            columns = [[task << 32 | made], [task], [held], [np.concatenate(ids).tobytes()], [rows], [[{"source": s, "tokens": n} for s, n in totals.items()]]]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.struct([("doc_id", pa.int64()), ("source", pa.string()), ("length", pa.int32())])), pa.list_(pa.struct([("source", pa.string()), ("tokens", pa.int64())]))]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["chunk_id", "task", "n_tokens", "ids", "docs", "totals"])

        for batch in lean(batches):
            for i in range(batch.num_rows):
                doc_id, text, source = (batch.column(c)[i].as_py() for c in range(3))
                own = np.array([*encode(text or ""), end_id], np.uint32)
                if own.max() > 65535:
                    raise ValueError("ids of more than 16 bits")
                ids.append(own.astype("<u2"))
                rows.append({"doc_id": doc_id, "source": "" if source is None else f"={source}", "length": len(own)})
                held += len(own)
                if held >= chunk_tokens:
                    yield chunk()
                    ids, rows, held, made = [], [], 0, made + 1
        if rows:
            yield chunk()

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{source_col}`").cast("string").alias("source")).mapInArrow(run, CHUNK)


def _before(rows: DataFrame, value: str, keys: list[str], out: str) -> DataFrame:
    """Adds the sum of value over all earlier chunks of the same keys: sums of whole tasks, then within the task."""
    tasks = rows.groupBy(*keys, "task").agg(F.sum(value).alias("_of_task"))
    tasks = tasks.select(*keys, "task", F.coalesce(F.sum("_of_task").over(Window.partitionBy(*keys).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_tasks"))
    within = Window.partitionBy(*keys, "task").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_chunks", F.coalesce(F.sum(value).over(within), F.lit(0))).join(tasks, [*keys, "task"]).withColumn(out, F.col("_chunks") + F.col("_tasks")).drop("_chunks", "_tasks")


def queue_places(chunks: DataFrame, targets: dict[str | None, float] | None = None) -> DataFrame:
    """chunk_id, queues: array of (source, before: tokens of its queue in earlier chunks, own, all: its share is own / all)."""
    parts = chunks.select("chunk_id", "task", F.explode("totals").alias("t")).select("chunk_id", "task", "t.source", "t.tokens")
    parts = _before(parts, "tokens", ["source"], "before")
    if targets:
        scale, total = 1 << 40, sum(map(float, targets.values()))
        given = {("" if s is None else f"={s}"): max(1, round(float(w) / total * scale)) for s, w in targets.items()}
        weights = F.create_map(*[F.lit(x) for pair in given.items() for x in pair])
        parts = parts.withColumn("own", F.coalesce(F.try_element_at(weights, F.col("source")), F.lit(1)).cast("long")).withColumn("all", F.lit(scale).cast("long"))
    else:
        shares = chunks.select(F.explode("totals").alias("t")).groupBy("t.source").agg(F.sum("t.tokens").alias("own"))
        total = chunks.agg(F.sum("n_tokens").alias("all"))
        parts = parts.join(shares, "source").crossJoin(F.broadcast(total))  # one row
    return parts.groupBy("chunk_id").agg(F.collect_list(F.struct("source", "before", "own", "all")).alias("queues"))


def schedule(place: int, n: int, rate: int, quantum: int) -> tuple[np.ndarray, np.ndarray]:
    """Of n tokens that stand at place in their queue: where (from 0) a new window begins, and which window it is.

    Quantum k is sent in the first window t with (t + 1) * rate >= (k + 1) * quantum * RATE. The first one is placed
    exactly, the others from there, in numbers that a chunk's size bounds."""
    first = place // quantum
    window = -(-(first + 1) * quantum * RATE // rate) - 1
    spare = (window + 1) * rate - (first + 1) * quantum * RATE
    each = np.arange((place + n - 1) // quantum - first + 1, dtype=np.int64)
    windows = window + np.maximum(0, -((spare - each * (quantum * RATE)) // rate))
    new = np.flatnonzero(np.append(True, windows[1:] != windows[:-1]))
    return np.maximum(0, (first + new) * quantum - place), windows[new]


def sequence_cuts(n: int, size: int) -> np.ndarray:
    """Bounds of a stream's sequences: full ones, then the rest in falling powers of two."""
    bounds = list(range(0, n - n % size + 1, size))
    rest = n % size
    for bit in range(size.bit_length(), -1, -1):
        if rest >> bit & 1:
            bounds.append(bounds[-1] + (1 << bit))
    return np.array(bounds, np.int64)


GROUPED = "grp long, win array<int>, source array<int>, place array<long>, doc_id array<long>, start array<int>, length array<int>, doc_tokens array<int>, names array<string>, ids binary"


def _dealt(chunks: DataFrame, queues: DataFrame, window_tokens: int, group_windows: int, quantum: int) -> DataFrame:
    """GROUPED: each chunk's pieces, one row for every group of windows that they go to; source is a place in names."""

    def rows(ids: bytes, docs, known: list[dict]) -> pa.RecordBatch:
        tokens = np.frombuffer(ids, "<u2")
        doc_ids, sources, lengths = docs.field("doc_id"), docs.field("source").dictionary_encode(), np.asarray(docs.field("length")).astype(np.int64)
        codes, names = np.asarray(sources.indices), sources.dictionary
        first = np.concatenate([[0], np.cumsum(lengths)])[:-1]  # of each document among the chunk's tokens
        plan = {q["source"]: q for q in known}
        found: list[list[np.ndarray]] = []
        for code, name in enumerate(names.to_pylist()):
            own = np.flatnonzero(codes == code)
            starts = np.concatenate([[0], np.cumsum(lengths[own])])
            q = plan[name]
            cuts, windows = schedule(q["before"], int(starts[-1]), max(1, q["own"] * window_tokens * RATE // q["all"]), quantum)
            begin = np.unique(np.concatenate([starts[:-1], cuts]))
            doc = np.searchsorted(starts, begin, side="right") - 1
            window = windows[np.searchsorted(cuts, begin, side="right") - 1]
            found.append([window, np.full(len(begin), code), q["before"] + begin, own[doc], begin - starts[doc], np.append(begin[1:], starts[-1]) - begin])
        window, code, place, doc, start, length = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(window // group_windows, kind="stable")
        window, code, place, doc, start, length = (x[order] for x in (window, code, place, doc, start, length))
        group = window // group_windows
        cuts = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group))
        sizes = np.concatenate([[0], np.cumsum(length)])
        moved = tokens[np.arange(sizes[-1]) + np.repeat(first[doc] + start - sizes[:-1], length)]
        lists = lambda values: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values)
        columns = [lists(pa.array(window % group_windows, pa.int32())), lists(pa.array(code, pa.int32())), lists(pa.array(place, pa.int64())), lists(doc_ids.take(pa.array(doc))), lists(pa.array(start, pa.int32())), lists(pa.array(length, pa.int32())), lists(pa.array(lengths[doc], pa.int32()))]
        ends = sizes[cuts].tolist()
        every = pa.array([names.to_pylist()] * (len(cuts) - 1), pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(group[cuts[:-1]], pa.int64()), *columns, every, pa.array([moved[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary())], names=["grp", "win", "source", "place", "doc_id", "start", "length", "doc_tokens", "names", "ids"])

    def run(batches):
        for batch in lean(batches):
            for i in range(batch.num_rows):
                yield rows(batch.column(0)[i].as_py(), batch.column(1)[i].values, batch.column(2)[i].as_py())

    # the plan is thin and of a size Spark knows: it is broadcast below the session's threshold, merged beyond it
    return chunks.join(queues, "chunk_id").select("ids", "docs", "queues").mapInArrow(run, GROUPED)


def pack(docs: DataFrame, *, size: int = 1024, window_tokens: int | None = None, group_windows: int = 1024, quantum: int = 64, targets: dict[str | None, float] | None = None, with_ids: bool = False, **how) -> DataFrame:
    """PIECES, and with with_ids the piece's ids (binary, little-endian 16 bit). Windows are as long as sequences unless window_tokens says otherwise."""
    chunks = stored(tokenized_chunks(docs, **how), "tokens", compression="zstd")
    queues = stored(queue_places(chunks, targets), "queues")

    def run(table: pa.Table) -> pa.Table:
        group = table.column("grp")[0].as_py()
        flat = lambda name: np.concatenate([np.asarray(x.values) for x in table.column(name)])
        win, place, start, length, doc_tokens = (flat(n).astype(np.int64) for n in ("win", "place", "start", "length", "doc_tokens"))
        # rows number their sources by themselves: one alphabetical numbering for the group
        names = sorted({n for x in table.column("names") for n in x.as_py()})
        number = {n: i for i, n in enumerate(names)}
        source = np.concatenate([np.array([number[n] for n in own.as_py()], np.int64)[np.asarray(x.values)] for own, x in zip(table.column("names"), table.column("source"), strict=True)])
        tokens = np.concatenate([np.frombuffer(x.as_buffer(), "<u2") for x in table.column("ids")])
        places = np.concatenate([[0], np.cumsum(length)])
        order = np.lexsort((place, source, win))
        starts = np.concatenate([[0], np.cumsum(length[order])])
        bounds = sequence_cuts(int(starts[-1]), size)
        cuts = np.unique(np.concatenate([starts, bounds]))
        begin, end = cuts[:-1], cuts[1:]
        at = np.searchsorted(starts, begin, side="right") - 1
        piece, into = order[at], begin - starts[at]
        sequence = np.searchsorted(bounds, begin, side="right") - 1
        origin = places[piece] + into
        spans = list(zip(origin.tolist(), (origin + end - begin).tolist(), strict=True))
        wide = memoryview(tokens.astype("<u4").tobytes())
        ids = pa.concat_arrays([x.values for x in table.column("doc_id")])
        shown = pa.array([n[1:] if n else None for n in names], pa.string())
        out = [ids.take(pa.array(piece)), pa.array(start[piece] + into), pa.array(end - begin), pa.array([zlib.crc32(wide[4 * a : 4 * b]) for a, b in spans], pa.int64()), pa.array(doc_tokens[piece]), pa.array((group << 32) + sequence), pa.array(begin - bounds[sequence]), shown.take(pa.array(source[piece]))]
        columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
        if with_ids:
            out.append(pa.array([tokens[a:b].tobytes() for a, b in spans], pa.binary()))
            columns.append("ids")
        return pa.Table.from_arrays(out, names=columns)

    dealt = _dealt(chunks, queues, window_tokens or size, group_windows, quantum)
    return dealt.groupBy("grp").applyInArrow(run, PIECES + (", ids binary" if with_ids else ""))
