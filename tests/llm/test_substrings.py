import collections
import hashlib
import random
import re

import numpy as np
import pytest
from corpuslens.llm import substrings as S


def brute(docs, window=35):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    seen = collections.Counter(tuple(w[i : i + window]) for _, w in split for i in range(len(w) - window + 1))
    out = []
    for i, w in split:
        covered = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                covered[k : k + window] = [True] * window
        kept = " ".join(x for x, c in zip(w, covered, strict=True) if not c)
        out.append((i, len(w), sum(covered), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passages = [rng.choices(vocabulary, k=k) for k in (34, 35, 36, 60, 200)]
    docs = []
    for i in range(80):
        w = rng.choices(vocabulary, k=rng.randrange(0, 150))
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(0, len(w) + 1)
            w[at:at] = rng.choice(passages)
        docs.append((i, " ".join(w)))
    docs += [(200, None), (201, ""), (202, "a " * 100), (203, "b " * 35), (204, "c " * 36), (205, docs[5][1]), (205, docs[5][1]), (206, "\n\t".join(passages[3]) + " É"), (None, docs[6][1]), (207, " ".join(f"u{i}" for i in range(30_000)))]
    return docs


@pytest.mark.parametrize(("chunk_bytes", "batches", "fan_in"), [(1 << 20, 4, 4), (700, 3, 2)])
def test_against_brute_force(spark, chunk_bytes, batches, fan_in):
    docs = made()
    df = spark.createDataFrame([(i, t, "clash", 5) for i, t in docs], "doc_id long, text string, docs string, n_words_ int").repartition(3)
    out = S.deduplicate(df, keep_sha=True, chunk_bytes=chunk_bytes, batches=batches, fan_in=fan_in)
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()], key=str) == brute(docs)
    assert {r.docs for r in out.collect()} == {"clash"}
    unchanged = {r.doc_id: r.kept_text for r in out.where("n_removed = 0").collect()}
    assert unchanged[200] is None and unchanged[201] == "" and unchanged[207] == dict((i, t) for i, t in docs)[207]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.deduplicate(df, keep_sha=True).count() == 0


def rows(df):
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()], key=str)


def test_batches_meet_an_index_of_another_session(spark, tmp_path, monkeypatch):
    import os
    import subprocess
    import sys

    docs, schema = [(k, t) for k, (_, t) in enumerate(made(2))], "doc_id long, text string"
    parts = [docs[i::4] for i in range(4)]
    code = f"""
from pyspark.sql import SparkSession
from corpuslens.llm import substrings as S
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/other").getOrCreate()
S.SubstringIndex(spark, "file://{tmp_path}/index", fan_in=2).add(spark.createDataFrame({parts[0]!r}, "{schema}"), chunk_bytes=900)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", code], check=True, env=os.environ | {"PYTHONPATH": root})
    for i in (1, 2, 3):
        monkeypatch.setattr(S, "RANGE_BYTES", 4000 // i)  # the number of ranges grows from batch to batch
        index = S.SubstringIndex(spark, f"file://{tmp_path}/index", fan_in=2)
        assert index.add(spark.createDataFrame(parts[i], schema), chunk_bytes=900) == i
        want = brute(sum(parts[: i + 1], []))
        new = {r[0] for r in parts[i]}
        assert rows(index.results(i, keep_sha=True)) == [r for r in want if r[0] in new]
        assert rows(index.results(keep_sha=True)) == want
    assert len({b["parts"] for b in index.state["batches"]}) > 1
    assert len(index.runs) < 4
    index.compact()
    new = {r[0] for p in parts[2:] for r in p}
    assert len(index.runs) == 1 and rows(S.SubstringIndex(spark, f"file://{tmp_path}/index").results(2, keep_sha=True)) == [r for r in want if r[0] in new]


def test_two_sessions_at_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a " * 40)], "doc_id long, text string")
    one, two = (S.SubstringIndex(spark, f"file://{tmp_path}/index") for _ in range(2))
    one.add(docs)
    with pytest.raises(FileExistsError):
        two.add(docs)
    again = S.SubstringIndex(spark, f"file://{tmp_path}/index")
    assert len(again.state["batches"]) == 1 and again.results().first().n_removed == 40


def test_merge_of_an_arriving_batch():
    import pyarrow as pa

    rng = random.Random(3)
    index, history, known_ever = [], collections.Counter(), {}
    for step in range(4):
        groups = [[rng.randrange(60) * 7 for _ in range(9)] for _ in range(3)]
        own = collections.Counter(v for vs in groups for v in vs)
        rows = [(step * 10 + i, step, h, np.array([g.count(int(x)) > 1 for x in h])) for i, g in enumerate(groups) for h in [np.unique(np.array(g, np.uint64))]]
        rows += [(None, None, h, m) for h, m in index]
        t = pa.table({"chunk_id": pa.array([r[0] for r in rows], pa.int64()), "batch": pa.array([r[1] for r in rows], pa.int32()), "part": pa.array([0] * len(rows), pa.int32()), "hashes": pa.array([r[2].tobytes() for r in rows], pa.binary()), "multi": pa.array([np.packbits(r[3]).tobytes() for r in rows], pa.binary())})
        out = S._merge(t).to_pylist()
        for i, g in enumerate(groups):
            (bits,) = [S._flags(r["multi"], r["n"]) for r in out if r["kind"] == S.BITS and r["chunk_id"] == step * 10 + i]
            assert bits.tolist() == [history[v] > 0 or own[v] > 1 for v in sorted(set(g))]
        (known,) = [np.frombuffer(r["hashes"], np.uint64).tolist() for r in out if r["kind"] == S.KNOWN]
        assert known == sorted(v for v in own if history[v])
        (run,) = [r for r in out if r["kind"] == S.RUN]
        index.append((np.frombuffer(run["hashes"], np.uint64), S._flags(run["multi"], run["n"])))
        history.update(own)
    assert S.ranges(0) == 8 and S.ranges(S.RANGE_BYTES * 9) == 16 and S.ranges(S.RANGE_BYTES << 16) == 1 << 16


def test_words_of_one_hash_are_told_apart(monkeypatch):
    """Two words whose first hash is the same: windows that differ in them alone differ in the second."""
    import xxhash

    real = xxhash.xxh64_intdigest
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda w: real(b"same" if w in (b"left", b"right") else w))
    rest = b" ".join(b"w%d" % i for i in range(34))
    w = S.Words([rest + b" left", rest + b" right", rest + b" left"])
    assert len(w.valid) == 3
    own, distinct, repeated = w.anchors()
    assert repeated.any()
    _, number, first, second, multi = w.candidates(np.ones(len(distinct), bool), own, distinct)
    assert len(set(first.tolist())) == 1 and len(set(second.tolist())) == 2
    assert number[0] == number[2] != number[1] and multi.tolist().count(True) == 1
