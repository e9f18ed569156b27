import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpuslens.llm import simhash as S
from corpuslens.operators.graph import connected_components
from corpuslens.llm.queries import op3_simhash_gray


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance=3):
    ids = sorted(fps)
    part = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= distance and part[a] != part[b]:
                low, high = sorted((part[a], part[b]))
                part = {i: low if p == high else p for i, p in part.items()}
    return part


def test_query(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    out = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in op3_simhash_gray(spark, small).collect()}
    parts = brute_components(fps)
    assert out == {i: (fps[i], parts[i]) for i in texts}


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64) * 2 + 1
    out = set()
    while len(out) < n:
        x = int(rng.choice(centres))
        for b in rng.integers(0, 64, rng.integers(0, 6)):
            x ^= 1 << int(b)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("hot", [4096, 3])
def test_links_of_dense_groups(spark, hot):
    fps = clustered(220, 5)
    nodes = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(fps)], "node long, fp long")
    found = {r.node: r.component for r in connected_components(S.near_links(nodes, hot=hot)).collect()}
    want = brute_components(dict(enumerate(fps)))
    assert {i: found.get(i, i) for i in want} == want


def test_index_search_is_exact():
    fps = np.array(clustered(300, 9), np.uint64)
    q, found = S.GrayIndex(fps).search(fps)
    index = S.GrayIndex(fps)
    got = {(int(fps[a]), int(index.fps[b])) for a, b in zip(q, found, strict=True)}
    assert got == {(int(a), int(b)) for a in fps for b in fps if (int(a) ^ int(b)).bit_count() <= 3}


def test_buckets_hold_every_linked_pair():
    masks = [m & (1 << 64) - 1 for m in S._level(1, 3)]
    rng = np.random.default_rng(2)
    for _ in range(300):
        flips = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(not flips & m for m in masks)
    assert len(S._level(2, 3)) == 100 and len(S._level(3, 3)) == 1000


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "A b C"), (4, "a B c"), (4, "a b c"), (5, "one"), (None, "nobody knows"), (7, "w " * 60_000)]
    docs = spark.createDataFrame([(*r, "clash", 3) for r in rows], "doc_id long, text string, fp string, component_id int")
    out = S.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r.component_id for r in out}
    assert got[1] == got[2] == 1 and got[3] == got[4] == 3 and got[5] == 5 and got[None] is None
    assert S.near_duplicates(docs.limit(0)).count() == 0
    kept = S.representatives(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 5, 7]


def test_near_copies_at_similarity(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(3000)]
    base = [words[i] for i in rng.integers(0, 3000, 400)]
    close, far = list(base), list(base)
    close[7] = "changed"
    for i in range(0, 400, 8):
        far[i] = "other"
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(close)), (4, " ".join(far)), (5, " ".join(words[:50])), (6, " ".join(words[:50][::-1]))]
    got = {r.doc_id: r.component_id for r in S.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}


def test_near_copies_through_the_index(spark, monkeypatch):
    """Copies within three bits are linked by the Gray index alone; pairs that it proposes are confirmed."""
    monkeypatch.setattr(S, "_forest_pairs", lambda met, *_: met.where("false").select(F.col("node").alias("a"), F.col("node").alias("b")))
    monkeypatch.setattr(S, "_doubtful", lambda met, *_: met.where("false").select("kind", "key", "node", F.col("node").alias("component")))
    rng = np.random.default_rng(12)
    base = [[f"w{i}" for i in rng.integers(0, 5000, 600)] for _ in range(30)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)] + [(100 + i, " ".join(w[:-1] + ["changed"])) for i, w in enumerate(base)]
    near = {i for i in range(30) if (S.copy_marks(rows[i][1], 5)[S.BANDS] ^ S.copy_marks(rows[30 + i][1], 5)[S.BANDS]).bit_count() <= S.DISTANCE}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in S.near_copies(docs).collect()}
    assert len(near) > 20 and all(got[100 + i] == got[i] == i for i in near)
    assert all(c == i or c == i - 100 for i, c in got.items())
    strict = {r.doc_id: r.component_id for r in S.near_copies(docs, similarity=0.9999).collect()}
    assert all(i == c for i, c in strict.items())


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_appended_cut_and_replaced_copies(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(5000)]
    pick = lambda n: [words[i] for i in rng.integers(0, 5000, n)]
    rows, pairs = [], {}
    for i in range(300):
        n = int(rng.integers(60, 600))
        base, k = pick(n), n // 10
        at = int(rng.integers(0, n - k))
        copy = [base + pick(2 * k - 1), base[: n - 2 * k + 4], base[:at] + pick(max(1, k - 3)) + base[at + max(1, k - 3) :]][i % 3]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
        pairs[2 * i + 1] = jaccard(rows[-2][1], rows[-1][1])
    got = {r.doc_id: r.component_id for r in S.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    alike = [i for i, j in pairs.items() if j >= 0.8]
    assert len(alike) > 200
    assert all(got[i] == (i - 1 if j >= 0.8 else i) for i, j in pairs.items())


def plain_components(texts, similarity=0.8):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    part = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if part[a] != part[b] and both >= similarity * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                low, high = sorted((part[a], part[b]))
                part = [low if p == high else p for p in part]
    return part


@pytest.mark.parametrize("hot", [4096, 7])
def test_groups_of_near_copies_against_brute_force(spark, hot):
    """Chains of edits, so that members are similar to some of their group only; strays between 0.6 and 0.8."""
    rng = np.random.default_rng(4)
    texts = []
    for g in range(4):
        chain = [[f"g{g}w{i}" for i in rng.integers(0, 5000, 200)]]
        for _ in range(40):
            w = list(chain[int(rng.integers(max(0, len(chain) - 6), len(chain)))])
            at, k = int(rng.integers(0, 190)), int(rng.integers(1, 30))
            w[at : at + k] = [f"e{x}" for x in rng.integers(0, 9999, k)]
            chain.append(w)
        texts += [" ".join(w) for w in chain]
    want = plain_components(texts)
    assert 10 < len(set(want)) < len(texts) - 40
    got = {r.doc_id: r.component_id for r in S.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_forests_are_maximal():
    rng = np.random.default_rng(6)
    centres = rng.integers(0, 1 << 63, (12, S.SKETCH), dtype=np.uint64)
    x = np.concatenate([centres[rng.integers(0, 12, 90)] ^ (np.uint64(1) << rng.integers(0, 63, (90, S.SKETCH), dtype=np.uint64)), rng.integers(90, 110, (90, 1), dtype=np.uint64)], 1)
    starts = np.array([0, 1, 3, 6, 9, 40, 90])
    got = [(int(a), int(b)) for p, q in S.forests(x, starts, 0.8) for a, b in zip(p, q, strict=True)]
    for s, e in zip(starts, starts[1:], strict=False):
        def components(pairs):
            part = {i: i for i in range(s, e)}
            for a, b in pairs:
                low, high = sorted((part[a], part[b]))
                part = {i: low if p == high else p for i, p in part.items()}
            return part

        own = [(a, b) for a, b in got if s <= a < e]
        every = [(a, b) for a in range(s, e) for b in range(s, a) if S.estimate(x[a], x[b], 0.8) >= 0.8 - S.SLACK]
        assert components(own) == components(every) and len(own) == (e - s) - len(set(components(every).values()))


def test_many_permutations_of_one_word_set(spark):
    rng = np.random.default_rng(9)
    words = np.array([f"w{i}" for i in range(60)])
    rows = [(i, " ".join(rng.permutation(words))) for i in range(20_000)]
    out = S.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert out.where("component_id <> doc_id").count() == 0


def test_recall_on_copies_in_the_tables(spark):
    """All pairs of documents with a 5-word similarity of 0.8 or more, found by an exact join of shingles, are linked."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    sets = {i: set(S.shingle_set(t, 5).tolist()) for i, t in texts.items()}
    # a pair at 0.8 shares one of the rarest fifth (and one more) of either's shingles
    counts = {}
    for own in sets.values():
        for h in own:
            counts[h] = counts.get(h, 0) + 1
    places, near = {}, set()
    for i, own in sets.items():
        first = sorted(own, key=lambda h: (counts[h], h))[: len(own) - -(-4 * len(own) // 5) + 1]
        for j in {j for h in first for j in places.get(h, ())}:
            both = len(own & sets[j])
            if both >= 0.8 * (len(own) + len(sets[j]) - both) - 1e-9:
                near.add((j, i))
        for h in first:
            places.setdefault(h, []).append(i)
    got = {r.doc_id: r.component_id for r in S.near_copies(docs).collect()}
    part = {i: i for i in texts}

    def root(i):
        while part[i] != i:
            part[i] = part[part[i]]
            i = part[i]
        return i

    for a, b in near:
        a, b = sorted((root(a), root(b)))
        part[b] = a
    assert len(near) > 500
    assert sum(got[a] == got[b] for a, b in near) >= 0.999 * len(near)
    assert all(root(i) == root(c) for i, c in got.items())  # and nothing else is


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert connected_components(edges.where(F.lit(False))).count() == 0
