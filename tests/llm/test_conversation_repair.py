import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from corpuslens.llm import conversation_repair as C

LEGAL = re.compile("(s?(ua)+)?")


def order(rows):
    import xxhash

    signed = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(t.encode(), 42))
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:64].encode(), signed(r[2]), r[2].encode()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        own = text.strip(" \t\n\v\f\r")
        out.append("b" if not own else "d" if (role, text) in seen else "t" if own[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """By least-cost search over (rows consumed, roles so far, audit), shorter role strings known by their shape alone."""
    kinds, best = faults(rows), {}
    heap = [(0, "", 0, "", ())]
    while heap:
        cost, audit, i, shape, lines = heapq.heappop(heap)
        if i == len(rows) and shape in ("", "a"):
            return cost, audit, "\n".join(lines)
        if best.get((i, shape), (cost, audit)) < (cost, audit):
            continue
        best[i, shape] = (cost, audit)
        nexts = {"": "su", "s": "u", "u": "a", "a": "u"}[shape]
        for c, name in (("u", "user"), ("a", "assistant")):
            if c in nexts:
                heapq.heappush(heap, (cost + 2, audit + "I", i, c, (*lines, f"{name}:")))
        if i < len(rows):
            _, role, text = rows[i]
            late = kinds[i] == "t"
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, shape, lines))
            if kinds[i] in ("", "t"):
                if role[:1] and role[:1] in nexts:
                    heapq.heappush(heap, (cost + late, audit + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))
                for c, name in (("u", "user"), ("a", "assistant")):
                    if c in nexts:
                        heapq.heappush(heap, (cost + 2 + late, audit + "R", i + 1, c, (*lines, f"{name}:{text}")))
    raise AssertionError


def expected(rows):
    """rows: (turn, role, text) of one conversation, nulls as given."""
    rows = order([(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows])
    kinds, turns = faults(rows), [r[0] for r in rows if r[0] is not None]
    cost, audit, text = cheapest(rows)
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, kinds.count("b"), kinds.count("d"), kinds.count("t"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def harmed(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def by_conversation(rows):
    groups = {}
    for conv, *rest in rows:
        groups.setdefault(conv, []).append(tuple(rest))
    return groups


def result(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[1:]) for r in rows}


SCHEMA = "conv_id long, turn long, role string, text string"


def random_rows(seed, conversations, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "", " \t", "Why?", "Stop!  ", None, "a.b", "x" * 70 + ".", "x" * 70 + "."]
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, longest)):
            rows.append((conv if rng.random() < 0.98 else None, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "assist"]), rng.choice(texts) if rng.random() < 0.6 else f"text {rng.random()}."))
    return rows


@pytest.mark.parametrize("run_rows", [4096, 3, 1])
def test_against_search(spark, run_rows):
    rows = random_rows(run_rows, 60, 9)
    got = result(C.repair(spark.createDataFrame(rows, SCHEMA).repartition(5), run_rows=run_rows))
    assert got == {conv: expected(own) for conv, own in by_conversation(rows).items()}


@pytest.mark.parametrize("run_rows", [4096, 16])
def test_long_conversation(spark, run_rows):
    rng = random.Random(9)
    rows = [(7, t // 2, rng.choice(["user", "assistant", "system"]), f"t{rng.randint(0, 200)}" + rng.choice(".!?x")) for t in range(600)] + [(8, 0, "user", "Hi."), (8, 1, "assistant", "Hi.")]
    got = result(C.repair(spark.createDataFrame(rows, SCHEMA).repartition(7), run_rows=run_rows))
    assert got == {conv: expected(own) for conv, own in by_conversation(rows).items()}


def test_bytes_cut_runs(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"{t} " + "word " * 2000 + ".") for t in range(30)]
    got = result(C.repair(spark.createDataFrame(rows, SCHEMA), run_bytes=20_000))
    assert got == {1: expected([r[1:] for r in rows])} and got[1][6] == "K" * 30


def test_damage(spark):
    rows = random_rows(4, 150, 8)
    df = C.damaged(spark.createDataFrame(rows, SCHEMA))
    key = lambda r: tuple(map(str, r))
    got = sorted(((r.conv_id, r.turn, r.role, r.text) for r in df.where("present").collect()), key=key)
    assert got == sorted(harmed(rows), key=key)
    want = by_conversation(harmed(rows))
    assert result(C.repair(df)) == {conv: expected(want.get(conv, [])) for conv in {r[0] for r in rows}}


def test_query_against_search(spark, small):
    table = spark.read.parquet(f"{small}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]
    want = by_conversation(harmed(rows))
    assert result(C.repair(C.damaged(table))) == {conv: expected(want.get(conv, [])) for conv in {r[0] for r in rows}}


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.repair(C.damaged(empty)).collect() == []
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, None, None, None), (None, None, None, "x")]
    extra = spark.createDataFrame([(*r, "k", 3) for r in rows], SCHEMA + ", run string, audit int")
    assert result(C.repair(extra)) == {conv: expected(own) for conv, own in by_conversation(rows).items()}
    gone = spark.createDataFrame([(5, 1, "user", "x", False)], SCHEMA + ", present boolean")
    assert result(C.repair(gone)) == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_distances_against_relaxation():
    """Dial's distances equal those of repeated relaxation over all arcs."""
    rng = random.Random(2)
    for _ in range(200):
        codes = bytes(rng.randrange(16) for _ in range(rng.randint(0, 12)))
        ends = [rng.choice([0, 1, 5, 11, C.FAR]) for _ in range(4)]
        n, dist = len(codes), {}
        for i in range(n, -1, -1):
            for s in range(4):
                dist[i, s] = ends[s] if i == n else min((c + dist[i + 1, t] for _, c, t in C.ARCS[codes[i]][s]), default=C.FAR)
            for _ in range(4) if i < n else ():
                for s in range(4):
                    dist[i, s] = min(dist[i, s], 2 + dist[i, C.FITTING[s]])
        assert C.distances(codes, ends) == [min(C.FAR, dist[i, s]) for i in range(n + 1) for s in range(4)]
