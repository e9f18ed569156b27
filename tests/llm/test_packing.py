import collections
import struct
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from corpuslens.llm import packing as P


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(P.default_paths()[0])


def check(rows, texts, tokenizer, size=1024):
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids, at = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == size or at < size and at & (at - 1) == 0
    return by_sequence


def test_query_round_trip(spark, small, tokenizer):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    check(P.pack(docs).collect(), {r.doc_id: r.text for r in docs.collect()}, tokenizer)


def shares(rows, key):
    groups, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for r in rows:
        groups[key(r)][r.source] += r.length
        totals[r.source] += r.length
    return groups, totals


def mixed(spark):
    return spark.range(900).selectExpr("id AS doc_id", "repeat('word and more text ', CAST(1 + id % 37 AS INT)) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 5) END AS source")


def test_windows_hold_the_mixture(spark, tokenizer):
    docs, window = mixed(spark), 4096
    rows = P.pack(docs.repartition(5), window_tokens=window, group_windows=1, quantum=1, chunk_tokens=3000).collect()
    check(rows, {r.doc_id: r.text for r in docs.collect()}, tokenizer)
    groups, totals = shares(rows, lambda r: r.sequence_id >> 32)
    everything = sum(totals.values())
    for g in sorted(groups)[:-1]:
        for s, n in totals.items():
            assert abs(groups[g][s] - window * n / everything) <= 1


def test_every_sequence_holds_the_mixture(spark, tokenizer):
    docs = mixed(spark)
    rows = P.pack(docs.repartition(5), chunk_tokens=3000, quantum=32).collect()
    check(rows, {r.doc_id: r.text for r in docs.collect()}, tokenizer)
    groups, totals = shares(rows, lambda r: r.sequence_id)
    everything = sum(totals.values())
    whole = [g for g in sorted(groups) if sum(groups[g].values()) == 1024][:-1]
    assert len(whole) > 30
    for g in whole:
        for s, n in totals.items():
            assert abs(groups[g][s] - 1024 * n / everything) <= 3 * 32  # a quantum from the schedule, two from where windows end


@pytest.mark.parametrize("quantum", [1, 32])
def test_windows_in_closed_form(quantum):
    """Against deficit round-robin done window by window, with the queue cut into chunks at odd places."""
    rate, n = int(22.7 * P.RATE), 3000
    want, window = [], 0
    while len(want) < n:
        ready = (window + 1) * rate // P.RATE // quantum * quantum  # whole quanta that all credit so far pays for
        want += [window] * (ready - len(want))
        window += 1
    want = want[:n]
    got, place = [], 0
    for length in [1, 5, 90, 3, 250, 22, 23, 24, 700, 1, 1881]:
        cuts, windows = P.schedule(place, length, rate, quantum)
        assert cuts[0] == 0 and (np.diff(cuts) > 0).all()
        for a, b, w in zip(cuts.tolist(), [*cuts[1:].tolist(), length], windows.tolist(), strict=True):
            got += [w] * (b - a)
        place += length
    assert got == want
    # far along a long queue: the same schedule, from exact numbers
    far = 10**13 // quantum * quantum
    cuts, windows = P.schedule(far, 500, rate, quantum)
    for a, w in zip(cuts.tolist(), windows.tolist(), strict=True):
        k = (far + a) // quantum
        assert (w + 1) * rate >= (k + 1) * quantum * P.RATE > w * rate


def test_targets_and_ids(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "repeat('alpha beta ', 20) AS text", "IF(id % 2 = 0, 'a', 'b') AS source")
    rows = P.pack(docs, targets={"a": 3.0, "b": 1.0}, quantum=32, with_ids=True).collect()
    groups, _ = shares(rows, lambda r: r.sequence_id)
    for g in sorted(groups)[:4]:  # until a queue is empty
        assert abs(groups[g]["a"] / sum(groups[g].values()) - 0.75) <= 0.04
    assert all(zlib.crc32(b"".join(struct.pack("<I", x) for x in struct.unpack(f"<{r.length}H", r.ids))) == r.ids_crc32 for r in rows)


def test_fast_encoder_agrees(tokenizer):
    encode = P.encoder(*P.default_paths())
    slow = P.encoder(P.default_paths()[0], None)
    for text in ("", "a", "don't  stop\n\n\tÉté naïve 12345 …", "<|endoftext|> inside", "x" * 5000, " " * 5000 + "y", "日本語 emoji 🙂🙂", "​﻿ a"):
        assert encode(text) == slow(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_added_tokens_as_in_the_file(spark):
    plain = Tokenizer.from_file(P.default_paths()[0])
    texts = {1: "a<|endoftext|>b", 2: "<|endoftext|>", 3: "no mark", 4: "x" * 5000 + " <|endoftext|><|endoftext|> é", 5: "<|endoftext| >"}
    assert plain.encode(texts[1], add_special_tokens=False).ids == [64, 50256, 65]
    docs = spark.createDataFrame([(i, t, "a") for i, t in texts.items()], "doc_id long, text string, source string")
    check(P.pack(docs).collect(), texts, plain)


def test_edges(spark, tokenizer):
    rows = [(1, None, "a"), (2, "", None), (3, "text", None), (None, "null id", "b"), (5, "long " * 30_000, "a")]
    docs = spark.createDataFrame([(*r, "clash", 3) for r in rows], "doc_id long, text string, source string, start string, grp int")
    check(P.pack(docs).collect(), {r[0]: r[1] for r in rows}, tokenizer)
    assert P.pack(docs.limit(0)).count() == 0
    twice = P.pack(docs.where("doc_id = 3").union(docs.where("doc_id = 3"))).collect()
    assert sum(r.length for r in twice) == 2 * twice[0].doc_tokens
