"""Conversation structure repair: the cheapest edits that give a conversation the shape system? (user assistant)+, or nothing.

The graph of a conversation of n rows has nodes (i, state): i rows are consumed, and the roles so far end at the start,
in a system, a user or an assistant row. Arcs keep a row (0), give it the role that fits (2), delete it (3) or insert
an empty row of the fitting role (2); a truncated row that stays costs 1 more; blank and duplicate rows must go.

* Dial's algorithm finds the distance of every node to the end: costs are at most 3, so a ring of few buckets replaces
  the heap. The audit then walks from the start along tight arcs (distance = cost + distance of the arc's end), always
  the one with the least letter (D, I, K, R). No two arcs of a node share a letter and none is free of both cost and
  progress, so the walk is the least of all cheapest audits.
* Rows are sorted by range over (conversation, turn, ...), not gathered by conversation, and cut into runs of bounded
  rows and bytes. A conversation that lies within one task and run, as nearly all do, is finished where it is.
* Longer ones go run by run. Duplicates across runs: first runs of each (role, text) digest. Each run gives the
  distances between its 4 entry and 4 exit states; a conversation's small matrices are folded from its end into the
  distances that every run's walk needs; walks from each entry state give exits, which are chained from the front.
  Only the SHA-256 of the repaired text, sequential by definition, is computed by streaming a conversation's runs
  through one task, a run at a time.

Rows are taken by turn, nulls first; rows of one turn by role, by the text's first 64 characters, by its XXH64. Null
roles and texts are one space; a null conversation is one of its own. A row that is not present only tells that its
conversation exists: without others it has zeros, an empty audit and the empty string's hash. Repeated rows are rows;
later ones are duplicates. Texts of any length are taken whole. Extra columns, whatever their names, are left out. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, stored

START, SYSTEM, USER, ASSISTANT = range(4)
FITTING = (USER, USER, ASSISTANT, USER)  # the state that a row of the fitting role leads to
INITIALS = {"s": 1, "u": 2, "a": 3}
#: What an end in each state still costs: a user's row wants an assistant's, a system's row both.
AT_END = (0, 4, 2, 0)
END_AUDITS = ("", "II", "I", "")
FAR = 1 << 60
MUST_GO, TRUNCATED = 4, 8  # bits of a row's code beside its initial
BLANKS = " \t\n\v\f\r"

RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
RUNS = "conv_id long, run long, is_open boolean, roles array<string>, texts array<string>, first_turn long, last_turn long, n_turns long"
COUNTS = "blank long, duplicate long, truncated long, illegal long"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present: rows harmed as crc32("conv_id:turn") % 20 says: 0 dropped, 1 emptied, 2 without `.!?`, 3 repeated, 4 said by the user. Nulls are one space, but for turns and ids themselves."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    rows = conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), (kind != 0).alias("present"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")


# One run: rows as codes, their distances and walks


def _arcs() -> tuple[list[list[tuple[str, int, int]]], ...]:
    """Of every code and state, the row's arcs (letter, cost, next state), letters ascending."""
    table = []
    for code in range(16):
        late = 1 if code & TRUNCATED else 0
        states = []
        for state in range(4):
            arcs = [("D", 3, state)]
            if not code & MUST_GO:
                to = code & 3
                if (to == SYSTEM and state == START) or (to == USER and state != USER) or (to == ASSISTANT and state == USER):
                    arcs.append(("K", late, to))
                arcs.append(("R", 2 + late, FITTING[state]))
            states.append(arcs)
        table.append(states)
    return table


ARCS = _arcs()
#: The same arcs by their end: (state it comes from, cost).
INTO = [[[(s, cost) for s in range(4) for _, cost, to in states[s] if to == state] for state in range(4)] for states in ARCS]
INSERTED = [[s for s in range(4) if FITTING[s] == state] for state in range(4)]


def distances(codes: bytes, ends: Iterable[int]) -> list[int]:
    """Of every node (row i, state) at 4 * i + state, the cost of reaching the run's end plus what its end state costs from there. Insertions after the last row belong to what follows."""
    n = len(codes)
    dist, seeds = [FAR] * (4 * n + 4), [(s, v) for s, v in enumerate(ends) if v < FAR]
    if not seeds:
        return dist
    low, high = min(v for _, v in seeds), max(v for _, v in seeds)
    ring = max(3, high - low) + 1
    buckets: list[list[int]] = [[] for _ in range(ring)]
    for s, v in seeds:
        dist[4 * n + s] = v
        buckets[v % ring].append(4 * n + s)
    waiting, d = len(seeds), low
    while waiting:
        bucket = buckets[d % ring]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if dist[node] != d:
                continue  # reached more cheaply since
            i, state = node >> 2, node & 3
            if i < n:
                for s in INSERTED[state]:
                    if d + 2 < dist[4 * i + s]:
                        dist[4 * i + s] = d + 2
                        buckets[(d + 2) % ring].append(4 * i + s)
                        waiting += 1
            if i:
                before = 4 * i - 4
                for s, cost in INTO[codes[i - 1]][state]:
                    if d + cost < dist[before + s]:
                        dist[before + s] = d + cost
                        buckets[(d + cost) % ring].append(before + s)
                        waiting += 1
        d += 1
    return dist


def walk(codes: bytes, dist: list[int], state: int) -> tuple[str, int]:
    """The least of all cheapest audits from a state, and the state that it ends in."""
    letters, i, n = [], 0, len(codes)
    while i < n:
        here, inserted = dist[4 * i + state], FITTING[state]
        for letter, cost, to in ARCS[codes[i]][state]:
            if letter > "I" and here == 2 + dist[4 * i + inserted]:
                letters.append("I")
                state = inserted
                break
            if here == cost + dist[4 * i + 4 + to]:
                letters.append(letter)
                state, i = to, i + 1
                break
        else:
            letters.append("I")  # a row that must go: deleting was its only other arc
            state = inserted
    return "".join(letters), state


def repaired(audit: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[str], int]:
    """The lines that an audit leaves, and the state after them."""
    lines, i, names = [], 0, {USER: "user", ASSISTANT: "assistant"}
    for letter in audit:
        if letter == "I":
            state = FITTING[state]
            lines.append(f"{names[state]}:")
            continue
        if letter == "K":
            state = INITIALS[roles[i][0]]
            lines.append(f"{roles[i]}:{texts[i]}")
        elif letter == "R":
            state = FITTING[state]
            lines.append(f"{names[state]}:{texts[i]}")
        i += 1
    return lines, state


def digest(role: str, text: str) -> bytes:
    """What tells rows apart: SHA-256 of the role's length, the role and the text."""
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")).digest()


def faults(roles: list[str], texts: list[str], seen: set[bytes]) -> tuple[bytes, dict[str, int]]:
    """Codes of a run's rows, and its counts. seen: digests of rows in earlier runs; grows."""
    codes, counts, before = bytearray(), dict(blank=0, duplicate=0, truncated=0, illegal=0), None
    for role, text in zip(roles, texts, strict=True):
        code, own, key = INITIALS.get(role[:1], 0), text.rstrip(BLANKS), digest(role, text)
        if not own:
            counts["blank"] += 1
            code |= MUST_GO
        elif key in seen:
            counts["duplicate"] += 1
            code |= MUST_GO
        elif own[-1] not in ".!?":
            counts["truncated"] += 1
            code |= TRUNCATED
        seen.add(key)
        codes.append(code)
        if before is not None and before + role[:1] not in ("su", "ua", "au"):
            counts["illegal"] += 1
        before = role[:1]
    return bytes(codes), counts


# Runs of conversations


def runs(rows: DataFrame, *, run_rows: int, run_bytes: int) -> DataFrame:
    """RUNS: the rows in order, in runs. run grows along a conversation; is_open: others may hold more of it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, first = TaskContext.get().partitionId() << 40, True
        current, roles, texts, turns, size, is_cut = None, [], [], [], 0, False

        def made(is_open: bool) -> pa.RecordBatch:
            known = [t for t in turns if t is not None]
            row = [current[0], number, is_open, roles, texts, known[0] if known else None, known[-1] if known else None, len(set(known))]
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["conv_id", "run", "is_open", "roles", "texts", "first_turn", "last_turn", "n_turns"])

        for batch in lean(batches):
            for conv, turn, role, text, present in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                if current is None:
                    current = (conv,)
                elif current != (conv,):
                    yield made(first or is_cut)  # the task's first conversation may begin in an earlier task
                    current, roles, texts, turns, size, is_cut, number, first = (conv,), [], [], [], 0, False, number + 1, False
                elif len(roles) >= run_rows or size >= run_bytes:
                    yield made(True)
                    roles, texts, turns, size, is_cut, number = [], [], [], 0, True, number + 1
                if present:
                    roles.append(role)
                    texts.append(text)
                    turns.append(turn)
                    size += len(text)
        if current is not None:
            yield made(True)

    text = F.coalesce(F.col("text"), F.lit(" "))
    whole = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit(" ")).alias("role"), text.alias("text"), F.col("present").alias("present"))
    # the last two split ties: equal texts are interchangeable
    order: list[Column] = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 64), F.xxhash64("text")]
    numbered = whole.withColumn("place", F.monotonically_increasing_id())
    dealt = numbered.repartitionByRange(*order, F.col("place")).sortWithinPartitions(*order, F.col("text"))
    return dealt.select("conv_id", "turn", "role", "text", "present").mapInArrow(cut, RUNS)


def _finished(closed: DataFrame) -> DataFrame:
    """RESULT of conversations that one run holds whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches, 16):
            out = []
            for r in batch.to_pylist():
                codes, counts = faults(r["roles"], r["texts"], set())
                dist = distances(codes, AT_END)
                audit, state = walk(codes, dist, START)
                audit += END_AUDITS[state]
                lines, _ = repaired(audit, START, r["roles"], r["texts"])
                gaps = r["last_turn"] - r["first_turn"] + 1 - r["n_turns"] if r["n_turns"] else 0
                out.append({"conv_id": r["conv_id"], "gaps": gaps, **counts, "cost": dist[START], "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()})
            yield pa.RecordBatch.from_pylist(out, RESULT_ARROW)

    return closed.drop("is_open", "run").mapInArrow(run, RESULT)


_LONG = pa.int64()
RESULT_ARROW = pa.schema([*[(n, _LONG) for n in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _earlier_digests(open_runs: DataFrame) -> DataFrame:
    """run, seen: digests of a run's rows that earlier runs of its conversation hold too."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches, 4):
            for r in batch.to_pylist():
                own = list({digest(*x) for x in zip(r["roles"], r["texts"], strict=True)})
                yield pa.RecordBatch.from_arrays([pa.array([r["conv_id"]] * len(own), _LONG), pa.array([r["run"]] * len(own), _LONG), pa.array(own, pa.binary())], names=["conv_id", "run", "digest"])

    found = open_runs.select("conv_id", "run", "roles", "texts").mapInArrow(keys, "conv_id long, run long, digest binary")
    first = F.min("run").over(Window.partitionBy("conv_id", "digest"))  # a run has a digest once
    return found.withColumn("first", first).where("first < run").groupBy("run").agg(F.collect_list("digest").alias("seen"))


MATRICES = f"conv_id long, run long, codes binary, roles array<string>, texts array<string>, matrix array<long>, first_initial string, last_initial string, first_turn long, last_turn long, n_turns long, {COUNTS}"


def _matrices(open_runs: DataFrame) -> DataFrame:
    """MATRICES: of each run, the rows' codes, its counts and the 16 distances from entry to exit states."""
    kinds = pa.schema([("conv_id", _LONG), ("run", _LONG), ("codes", pa.binary()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("matrix", pa.list_(_LONG)), ("first_initial", pa.string()), ("last_initial", pa.string()), *[(n, _LONG) for n in ("first_turn", "last_turn", "n_turns", "blank", "duplicate", "truncated", "illegal")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches, 4):
            for r in batch.to_pylist():
                codes, counts = faults(r["roles"], r["texts"], set(r.pop("seen") or ()))
                to = [distances(codes, [0 if s == e else FAR for s in range(4)])[:4] for e in range(4)]
                ends = (r["roles"][0][:1], r["roles"][-1][:1]) if r["roles"] else (None, None)
                yield pa.RecordBatch.from_pylist([{**r, **counts, "codes": codes, "matrix": [to[e][s] for s in range(4) for e in range(4)], "first_initial": ends[0], "last_initial": ends[1]}], kinds)

    return open_runs.drop("is_open").join(_earlier_digests(open_runs), "run", "left").mapInArrow(run, MATRICES)


def _folded(matrices: DataFrame) -> DataFrame:
    """run, ends (what each end state of the run costs from there), and in a conversation's last run its totals: one small row a run, folded from a conversation's end."""
    out = f"run long, ends array<long>, is_last boolean, gaps long, cost long, {COUNTS}"
    names = ["blank", "duplicate", "truncated", "illegal"]
    kinds = pa.schema([("run", _LONG), ("ends", pa.list_(_LONG)), ("is_last", pa.bool_()), ("gaps", _LONG), ("cost", _LONG), *[(n, _LONG) for n in names]])

    def fold(table: pa.Table) -> pa.Table:
        rows = table.sort_by("run").to_pylist()
        totals, ends, found = {n: sum(r[n] for r in rows) for n in names}, list(AT_END), []
        initial, turn, low, distinct = None, None, None, 0
        for r in rows:
            if r["first_initial"] is not None:
                totals["illegal"] += initial is not None and initial + r["first_initial"] not in ("su", "ua", "au")
                initial = r["last_initial"]
            if r["n_turns"]:
                low = r["first_turn"] if low is None else low
                distinct += r["n_turns"] - (turn == r["first_turn"])
                turn = r["last_turn"]
        for r in reversed(rows):
            found.append({"run": r["run"], "ends": ends, "is_last": False, "gaps": 0, "cost": 0, **dict.fromkeys(names, 0)})
            ends = [min(FAR, *(r["matrix"][4 * s + e] + ends[e] for e in range(4))) for s in range(4)]
        found[0] |= {"is_last": True, "gaps": turn - low + 1 - distinct if distinct else 0, "cost": ends[START], **totals}
        return pa.Table.from_pylist(found, kinds)

    return matrices.select("conv_id", "run", "matrix", "first_initial", "last_initial", "first_turn", "last_turn", "n_turns", *names).groupBy("conv_id").applyInArrow(fold, out)


def _walked(matrices: DataFrame, folded: DataFrame) -> DataFrame:
    """Each run with the audits of its four entry states and the states they end in."""
    out = f"conv_id long, run long, is_last boolean, audits array<string>, exits array<int>, gaps long, cost long, {COUNTS}"
    names = ["conv_id", "run", "is_last", "gaps", "cost", "blank", "duplicate", "truncated", "illegal"]
    kinds = pa.schema([("conv_id", _LONG), ("run", _LONG), ("is_last", pa.bool_()), ("audits", pa.list_(pa.string())), ("exits", pa.list_(pa.int32())), ("gaps", _LONG), ("cost", _LONG), *[(n, _LONG) for n in names[5:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches, 64):
            made = []
            for r in batch.to_pylist():
                dist = distances(r["codes"], r["ends"])
                found = [walk(r["codes"], dist, s) for s in range(4)]
                made.append({n: r[n] for n in names} | {"audits": [a + END_AUDITS[e] * r["is_last"] for a, e in found], "exits": [e for _, e in found]})
            yield pa.RecordBatch.from_pylist(made, kinds)

    return matrices.select("conv_id", "run", "codes").join(folded, "run").mapInArrow(run, out)


def _entries(walked: DataFrame) -> DataFrame:
    """run, entry: the state in which each run begins; one small row a run, chained from a conversation's start."""

    def chain(table: pa.Table) -> pa.Table:
        table, state, entries = table.sort_by("run"), START, []
        for exits in table.column("exits").to_pylist():
            entries.append(state)
            state = exits[state]
        return pa.Table.from_arrays([table.column("run"), pa.array(entries, pa.int32())], names=["run", "entry"])

    return walked.select("conv_id", "run", "exits").groupBy("conv_id").applyInArrow(chain, "run long, entry int")


def _joined_up(matrices: DataFrame, walked: DataFrame, entries: DataFrame) -> DataFrame:
    """RESULT of conversations in several runs: their lines stream through a hash, a run at a time."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, any_line, audit = hashlib.sha256(), False, []
        for batch in lean(batches, 4):
            for r in batch.to_pylist():
                lines, _ = repaired(r["audit"], r["entry"], r["roles"], r["texts"])
                audit.append(r["audit"])
                if lines:
                    sha.update(("\n" * any_line + "\n".join(lines)).encode("utf-8", "surrogatepass"))
                    any_line = True
                if r["is_last"]:
                    row = {n: r[n] for n in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
                    yield pa.RecordBatch.from_pylist([row | {"audit": "".join(audit), "repaired_sha256": sha.hexdigest()}], RESULT_ARROW)
                    sha, any_line, audit = hashlib.sha256(), False, []

    own = walked.join(entries, "run").withColumn("audit", F.element_at("audits", F.col("entry") + 1)).drop("audits", "exits")
    texts = matrices.select("run", "roles", "texts")
    return own.join(texts, "run").repartition("conv_id").sortWithinPartitions("conv_id", "run").mapInArrow(stream, RESULT)


def repair(rows: DataFrame, *, run_rows: int = 4096, run_bytes: int = 4 << 20) -> DataFrame:
    """RESULT, one row a conversation. rows: conv_id, turn, role, text, and present where rows can tell no more than that their conversation exists."""
    if "present" not in rows.columns:
        rows = rows.withColumn("present", F.lit(True))
    every = stored(runs(rows, run_rows=run_rows, run_bytes=run_bytes), "runs", compression="zstd")
    matrices = stored(_matrices(every.where("is_open")), "matrices", compression="zstd")
    walked = stored(_walked(matrices, _folded(matrices)), "walks", compression="zstd")
    return _finished(every.where("NOT is_open")).unionByName(_joined_up(matrices, walked, _entries(walked)))
