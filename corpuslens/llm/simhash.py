"""SimHash near-duplicates found through a Gray-order hierarchical index.

1. Fingerprints (narrow): 64-bit SimHash of a text's word shingles; one row of 16 bytes a document is kept.
2. Equal fingerprints collapse to one row each, whose node is the smallest id.
3. Candidate buckets: of distance + 2 bit blocks, two fingerprints within the distance agree on two whole ones, so
   every linked pair meets in a bucket (ten kinds of them for 3 bits). A bucket of more than ``hot`` fingerprints is
   dealt again by two blocks of its remaining bits. For 3 bits each level fixes two fifths of what is left (26, then 15,
   then 9 bits), so after three levels a bucket holds at most 2**14 fingerprints: bounded memory without any cap.
4. Within a bucket: fingerprints sorted by Gray rank form a tree whose nodes keep the bits that all below share. A
   search descends level by level, adds up differences in newly fixed bits and prunes a whole group beyond DISTANCE.
   Only edges that join two parts of a bucket are emitted (fewer than its members), never all pairs.
5. Components over those edges; every document gets the smallest id it can reach.

``near_duplicates`` is that, over repeated 3-word shingles. ``near_copies`` serves filtering at a Jaccard similarity of
0.8 of distinct 5-word shingles. Only exact similarity, of shingle sets made again from the texts, makes a link:

a. The same index proposes links: those of the buckets' forests over a 64-bit SimHash of the shingles.
b. A 64-bit fingerprint would miss most pairs near 0.8, so texts that share one of BANDS keys of ROWS MinHash values meet
   in a bucket too (a pair at 0.8 misses them all once in 38,000 times, one more alike less often); set sizes and
   64 * SKETCH SimHash bits estimate their similarity. Each bucket proposes a spanning forest of its members, the most
   alike first (fewer pairs than members). A bucket of more than ``hot`` members is dealt into parts by a hash, and the
   trees' roots meet again, until they fit. The proposals of both are confirmed.
c. Where a bucket still holds several components, the members outside its largest one are compared with all, in blocks of
   ``hot``. Members that may be similar to one of another component (by four standard errors of the estimate) meet once
   more, with their shingle sets: the exact similarity to all others of a block comes from an inverted list of shingles,
   and only links that join two components leave the task.

So rows stay in proportion to members, however large a group of copies is, no task holds more than a few times ``hot``
members or SET_BYTES of shingle sets, and no pair that may be similar is left unexamined unless it is connected already.

Null and empty texts have fingerprint zero and are linked like any other. Ids are integers. Null ids get a fingerprint; they take part
in no minimum, and a component of null ids only has a null id. Texts are read whole; repeated rows stay repeated.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import doc_columns, lean, stored, unused

DISTANCE = 3
SEED = 42
FAN = 8  # children of an index node
HOT = 4096
QUERIES = 512  # fingerprints searched at once

_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of a text's shingles, repeats included."""
    import xxhash

    tokens = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    n = len(tokens)
    if n <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(t) + 1 for t in tokens]).tolist()
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[words - 1 :], strict=False)], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """id, fp (the 64 bits as a signed long) of every row; narrow."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in lean(batches):
            found = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=[id_col, "fp"])

    return doc_columns(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code word in the binary reflected Gray sequence."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayIndex:
    """Fingerprints in Gray order under nodes of FAN children that hold the bits all below them share."""

    def __init__(self, fps: np.ndarray):
        self.order = np.argsort(gray_rank(fps), kind="stable")
        self.fps = fps[self.order]
        ands, ors = [self.fps], [self.fps]
        while len(ands[-1]) > 1:
            cuts = np.arange(0, len(ands[-1]), FAN)
            ands.append(np.bitwise_and.reduceat(ands[-1], cuts))
            ors.append(np.bitwise_or.reduceat(ors[-1], cuts))
        masks = [~(a ^ o) for a, o in zip(ands, ors, strict=True)]
        #: Per level, leaves first: the shared bits, and which of them no node above has fixed yet.
        self.levels = []
        for k, (bits, mask) in enumerate(zip(ands, masks, strict=True)):
            above = np.repeat(masks[k + 1], FAN)[: len(mask)] if k + 1 < len(masks) else np.uint64(0)
            self.levels.append((bits, mask & ~above))

    def uniform(self, parts: np.ndarray) -> list[np.ndarray]:
        """Per level: the part that all leaves of a node are in, or -1."""
        out = [parts]
        while len(out[-1]) > 1:
            cuts = np.arange(0, len(out[-1]), FAN)
            low, high = np.minimum.reduceat(out[-1], cuts), np.maximum.reduceat(out[-1], cuts)
            out.append(np.where(low == high, low, -1))
        return out

    def search(self, queries: np.ndarray, skip: list[np.ndarray] | None = None, own: np.ndarray | None = None, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, place) within distance. Groups whose leaves are all in the query's own part are skipped."""
        top = len(self.levels) - 1
        q = np.repeat(np.arange(len(queries)), len(self.levels[top][0]))
        node = np.tile(np.arange(len(self.levels[top][0])), len(queries))
        far = np.zeros(len(q), np.int64)
        for k in range(top, -1, -1):
            bits, fresh = self.levels[k]
            if k < top:
                q, far = np.repeat(q, FAN), np.repeat(far, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                there = node < len(bits)
                q, far, node = q[there], far[there], node[there]
            far = far + np.bitwise_count((queries[q] ^ bits[node]) & fresh[node])
            keep = far <= distance
            if skip is not None:
                keep &= skip[k][node] != own[q]
            q, node, far = q[keep], node[keep], far[keep]
        return q, node


def _agree(sketches: np.ndarray | None, a, b, similarity: float) -> np.ndarray | bool:
    """Whether rows a and b are as similar as asked, by their further SimHash bits and (the last column) set sizes."""
    if sketches is None:
        return True
    differ = np.bitwise_count(sketches[a, :-1] ^ sketches[b, :-1]).sum(-1, dtype=np.int64)
    n, m = sketches[a, -1].astype(np.float64), sketches[b, -1].astype(np.float64)
    shared = np.cos(np.pi * differ / (64 * (sketches.shape[1] - 1))) * np.sqrt(n * m)
    return shared >= similarity * (n + m - shared)


def bucket_edges(fps: np.ndarray, sketches: np.ndarray | None = None, *, distance: int = DISTANCE, similarity: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Places of a spanning forest of the links among fingerprints; with sketches, of those links that they confirm."""
    n = len(fps)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if n == 2:
        near = int(np.bitwise_count(fps[0] ^ fps[1])) <= distance and bool(_agree(sketches, 0, 1, similarity))
        return np.arange(near, dtype=np.int64), np.ones(int(near), np.int64)
    index = GrayIndex(fps)
    sketches = None if sketches is None else sketches[index.order]
    parts = list(range(n))
    left, right = [], []

    def root(x: int) -> int:
        while parts[x] != x:
            parts[x] = parts[parts[x]]
            x = parts[x]
        return x

    def link(a: int, b: int) -> None:
        a, b = root(a), root(b)
        if a != b:
            parts[max(a, b)] = min(a, b)
            left.append(a)
            right.append(b)

    neighbours = np.arange(n - 1)
    for i in np.flatnonzero((np.bitwise_count(index.fps[1:] ^ index.fps[:-1]) <= distance) & _agree(sketches, neighbours, neighbours + 1, similarity)).tolist():
        link(i, i + 1)
    step = min(QUERIES, max(16, (1 << 22) // n))
    for at in range(0, n, step):
        labels = np.array([root(i) for i in range(n)], np.int64)
        q, found = index.search(index.fps[at : at + step], index.uniform(labels), labels[at : at + step], distance)
        q = q + at
        good = (q != found) & _agree(sketches, q, found, similarity)
        for a, b in zip(q[good].tolist(), found[good].tolist(), strict=True):
            link(a, b)
    return index.order[np.array(left, np.int64)], index.order[np.array(right, np.int64)]


def _pairs_of_blocks(bits: list[int], distance: int) -> list[list[int]]:
    """All unions of two of distance + 2 blocks of these bit positions."""
    n = distance + 2
    cuts = [round(i * len(bits) / n) for i in range(n + 1)]
    blocks = [bits[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    return [blocks[i] + blocks[j] for i in range(n) for j in range(i)]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def _level(depth: int, distance: int) -> list[int]:
    """The masks of the bits that buckets of a level share, by kind: ten of them for 3 bits, then 100, then 1000."""
    kinds = [[]]
    for _ in range(depth):
        kinds = [done + pair for done in kinds for pair in _pairs_of_blocks([b for b in range(64) if b not in set(done)], distance)]
    return [_mask(k) for k in kinds]


def _dealt(nodes: DataFrame, depth: int, distance: int) -> DataFrame:
    """nodes' columns, kind, key: each fingerprint in all its buckets of a level; beyond the first, nodes have the kind they come from."""
    names = [c for c in nodes.columns if c != "kind"]
    masks, n = _level(depth, distance), (distance + 2) * (distance + 1) // 2
    if depth == 1:
        kinds = F.array(*[F.struct(F.lit(i).alias("kind"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    else:
        own, table = F.col("kind") * n, F.array(*[F.lit(m) for m in masks])
        kinds = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.struct((own + j).cast("int").alias("kind"), F.col("fp").bitwiseAND(F.get(table, (own + j).cast("int"))).alias("key")))
    return nodes.select(*names, F.explode(kinds).alias("b")).select(*names, "b.kind", "b.key")


def _searched(dealt: DataFrame, distance: int, similarity: float) -> DataFrame:
    """a, b: forest edges of every bucket. Rows of a bucket arrive together, in bounded number, and are streamed."""
    sketch = [c for c in dealt.columns if c.startswith("s")]

    def pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
        none = [np.empty(0, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x + none).astype(np.int64)) for x in (a, b)], names=["a", "b"])

    def search(columns: list[np.ndarray], bounds: list[int]) -> pa.RecordBatch:
        _, _, node, fp, *further = columns
        a, b = [], []
        for s, e in zip(bounds, bounds[1:], strict=False):
            if e - s > 1:
                left, right = bucket_edges(fp[s:e], np.stack([x[s:e] for x in further], 1) if further else None, distance=distance, similarity=similarity)
                a.append(node[s:e][left])
                b.append(node[s:e][right])
        return pairs(a, b)

    def run(batches):
        held: list[np.ndarray] = []  # the rows of the bucket that may go on in the next batch
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4 + len(sketch))]
            columns = [c.view(np.uint64) if i > 2 else c for i, c in enumerate(columns)]
            if held:
                columns = [np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)]
            kind, key = columns[:2]
            bounds = [0, *(np.flatnonzero((kind[1:] != kind[:-1]) | (key[1:] != key[:-1])) + 1).tolist()] if len(kind) else [0]
            held = [c[bounds[-1] :].copy() for c in columns]
            yield search(columns, bounds)
        if held:
            yield search(held, [0, len(held[0])])

    rows = dealt.select("kind", "key", "node", "fp", *sketch).repartition("kind", "key").sortWithinPartitions("kind", "key")
    return rows.mapInArrow(run, "a long, b long")


def near_links(nodes: DataFrame, *, distance: int = DISTANCE, similarity: float = 0.0, hot: int = HOT) -> DataFrame:
    """a, b: enough links to connect all (node, fp) within the distance, through any chain. Columns s... are further bits and a set size, by which a link is confirmed."""
    found, todo = None, _dealt(nodes, 1, distance)
    for depth in (1, 2, 3):
        some = False
        if depth < 3:
            sizes = stored(todo.groupBy("kind", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
            # single fingerprints go; a hot bucket is dealt again. Both joins are on the bucket: skew joins may split it.
            large = sizes.where(F.col("n") > hot)
            some = not large.isEmpty()
            edges = _searched(todo.join(sizes.where(F.col("n") <= hot), ["kind", "key"], "left_semi"), distance, similarity)
        else:
            edges = _searched(todo, distance, similarity)
        found = edges if found is None else found.union(edges)
        if not some:
            break
        todo = _dealt(todo.join(large, ["kind", "key"], "left_semi").drop("key"), depth + 1, distance)
    return found


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, hot: int = HOT) -> DataFrame:
    """id, fingerprint (16 hex digits), component_id of every row."""
    marked = stored(fingerprints(docs, id_col=id_col, text_col=text_col, words=words), "fingerprints").withColumn(id_col, F.col(f"`{id_col}`").cast("long"))
    found = _components(marked, id_col, ["fp"], hot=hot)
    return found.select(F.col(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _components(marked: DataFrame, id_col: str, key: list[str], **how) -> DataFrame:
    """marked and component_id. Rows of an equal key are one node, named by their smallest id."""
    nodes = stored(marked.groupBy(*key).agg(F.min(id_col).alias("node")), "nodes")
    parts = connected_components(near_links(nodes.where("node is not null").select("node", *key), **how))
    # only linked nodes are looked up; the rest are components of their own
    named = stored(nodes.join(parts, "node", "left").select(*key, F.coalesce("component", "node").alias("component_id")), "components")
    return marked.join(named, key)


BANDS, ROWS = 20, 4  # a pair at 0.8 misses all bands once in 38,000 times
SKETCH = 8  # words of 64 bits
SLACK = 0.11  # four standard errors of the estimate
SET_BYTES = 16 << 20  # of shingle sets that meet in one task
_BLOCK = 1 << 16  # members compared at once

_MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, i, 1 << 64)) for i in range(64)]


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """64-bit hashes of the distinct shingles, sorted: sums of their words' hashes by place. Of a shorter text, of all its words; none without words."""
    import xxhash

    tokens = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not tokens:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    width = min(words, len(own))
    n = len(own) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out += own[i : i + n] * _POWERS[i]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def copy_marks(text: str | None, words: int) -> list[int]:
    """BANDS keys of ROWS MinHash values each, SKETCH words of SimHash bits of the distinct shingles, and their number."""
    hashes = shingle_set(text, words)
    if not len(hashes):
        return [0] * (BANDS + SKETCH + 1)
    low = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for i in range(0, len(hashes), 4096):
        low = np.minimum(low, (hashes[i : i + 4096] * _MULTIPLIERS[0][:, None] + _MULTIPLIERS[1][:, None]).min(1))
    keys = np.zeros(BANDS, np.uint64)
    for row in low.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(32)
    out = keys.tolist()
    for i in range(SKETCH):
        mixed = (hashes + np.uint64(0x9E3779B97F4A7C15 * i & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
        values = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        counts = np.zeros(64, np.int64)
        for j in range(0, len(values), 4096):
            counts += np.unpackbits(values[j : j + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * counts > len(values), bitorder="little").view(np.uint64)[0]))
    return [*out, len(hashes)]


def estimate(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Jaccard similarity by SimHash bits and set sizes (last in the last axis); -1 where the sizes alone rule ``similarity`` out."""
    differ = np.bitwise_count(x[..., :-1] ^ y[..., :-1]).sum(-1, dtype=np.int64)
    n, m = x[..., -1].astype(np.float64), y[..., -1].astype(np.float64)
    shared = np.cos(np.pi * differ / (64 * (x.shape[-1] - 1))) * np.sqrt(n * m)
    return np.where(np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9, shared / np.maximum(n + m - shared, 1), -1)


def forests(sketches: np.ndarray, starts: np.ndarray, similarity: float):
    """Yields (a, b), places of the pairs of a maximum spanning forest of each bucket: Prim's algorithm, all buckets of one size side by side. starts: of the buckets, and the end."""
    sizes = np.diff(starts)
    for m in np.unique(sizes[sizes > 1]).tolist():
        own = starts[:-1][sizes == m]
        for i in range(0, len(own), max(1, _BLOCK // m)):
            place = own[i : i + max(1, _BLOCK // m), None] + np.arange(m)
            x, row = sketches[place], np.arange(len(place))
            best, before = estimate(x[:, :1], x, similarity), np.zeros(place.shape, np.int64)
            best[:, 0] = -2  # in the tree
            for _ in range(m - 1):
                pick = best.argmax(1)
                good = np.flatnonzero(best[row, pick] >= similarity - SLACK)
                yield place[good, before[good, pick[good]]], place[good, pick[good]]
                near = estimate(x[row, pick][:, None], x, similarity)
                best[row, pick] = -2
                closer = (near > best) & (best > -2)
                best[closer] = near[closer]
                before = np.where(closer, pick[:, None], before)


def across(members: np.ndarray, parts: np.ndarray, outside: np.ndarray, own: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Which outside rows and which members may be similar to one of another part on the other side."""
    left, right = np.zeros(len(outside), bool), np.zeros(len(members), bool)
    step = max(1, _BLOCK // max(1, len(members)))
    for i in range(0, len(outside), step):
        near = estimate(outside[i : i + step, None], members[None], similarity) >= similarity - SLACK
        near &= own[i : i + step, None] != parts[None]
        left[i : i + step] |= near.any(1)
        right |= near.any(0)
    return left, right


def linking(sets: list[np.ndarray], parts: np.ndarray, outside: list[np.ndarray], own: np.ndarray, similarity: float):
    """Yields (i, j): outside row i and member j whose sets have the similarity and whose parts nothing yielded before joins."""
    shingles = np.concatenate([*sets, np.empty(0, np.uint64)])
    sizes = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(shingles, kind="stable")
    shingles, owner = shingles[order], owner[order]
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    for i, x in enumerate(outside):
        low, high = np.searchsorted(shingles, x, "left"), np.searchsorted(shingles, x, "right")
        n = high - low
        at = np.arange(n.sum()) + np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        both = np.bincount(owner[at], minlength=len(sets))
        for j in np.flatnonzero((both >= similarity * (len(x) + sizes - both) - 1e-9) & (parts != own[i])).tolist():
            a, b = root(int(own[i])), root(int(parts[j]))
            if a != b:
                above[max(a, b)] = min(a, b)
                yield i, j


def _buckets(batches, n: int):
    """Whole buckets from sorted batches, as lists of n + 1 columns and the places where buckets begin (and the end). The first n columns are the bucket's key."""

    def begun(columns):
        new = np.zeros(len(columns[0]), bool)
        new[:1] = True
        for c in columns[:n]:
            new[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(new)

    held: list[list[np.ndarray]] = []  # the rows of the bucket that may go on in the next batch
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        if not len(columns[0]):
            continue
        if held and any(h[-1] != c[0] for h, c in zip(held[0][:n], columns, strict=False)):
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            yield whole, np.array([0, len(whole[0])])
            held = []
        cuts = begun(columns)
        last = int(cuts[-1])
        if last:
            whole = [np.concatenate([*[h[k] for h in held], c[:last]]) for k, c in enumerate(columns)]
            yield whole, np.append(begun(whole), len(whole[0]))
            held = []
        held.append([c[last:].copy() for c in columns])
    if held:
        whole = [np.concatenate(x) for x in zip(*held, strict=True)]
        yield whole, np.array([0, len(whole[0])])


def _pairs_of(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _sub(n: str, hot: int):
    """How many blocks of ``hot`` rows so many make."""
    return F.ceil(F.col(n) / hot).cast("int")


def _forest_pairs(met: DataFrame, sizes: DataFrame, sketches: DataFrame, similarity: float, hot: int) -> DataFrame:
    """a, b: proposals of step b. met: kind, key, node; sizes: kind, key, n; sketches: node, s0 ..."""
    names, out = [c for c in sketches.columns if c != "node"], None

    def search(batches):
        for columns, starts in _buckets(batches, 3):
            node, large = columns[3], columns[4]
            x = np.stack([c.view(np.uint64) for c in columns[5:]], 1)
            root = np.ones(len(node), bool)
            for a, b in forests(x, starts, similarity):
                root[b] = False  # Prim's trees grow from their roots: each later member is a pair's second
                empty = np.zeros(len(a), np.int32)
                yield pa.RecordBatch.from_arrays([*_pairs_of(node[a], node[b]).columns, pa.array(empty - 1, pa.int32()), pa.array(empty, pa.int64())], names=["a", "b", "kind", "key"])
            again = root & large
            yield pa.RecordBatch.from_arrays([pa.array(node[again]), pa.array(node[again]), pa.array(columns[0][again], pa.int32()), pa.array(columns[1][again], pa.int64())], names=["a", "b", "kind", "key"])

    while True:
        parts = _sub("n", hot)
        dealt = met.join(sizes.select("kind", "key", parts.alias("parts")), ["kind", "key"]).select("kind", "key", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("sub"), "node", (F.col("parts") > 1).alias("large"))
        rows = dealt.join(sketches, "node").select("kind", "key", "sub", "node", "large", *names).repartition("kind", "key", "sub").sortWithinPartitions("kind", "key", "sub")
        found = stored(rows.mapInArrow(search, "a long, b long, kind int, key long"), "forest")
        pairs = found.where("kind = -1").select("a", "b")
        out = pairs if out is None else out.union(pairs)
        roots = found.where("kind >= 0").select("kind", "key", F.col("a").alias("node"))
        fewer = stored(roots.groupBy("kind", "key").agg(F.count("*").alias("n")).join(sizes.withColumnRenamed("n", "before"), ["kind", "key"]).where("n > 1 AND n < before").select("kind", "key", "n"), "roots")
        if fewer.isEmpty():  # none was dealt, or what is left of it has nothing in common
            return out
        met, sizes = roots, fewer


def _in_blocks(own: DataFrame, weight: str, most: int, keep: list[str], hot: int) -> DataFrame:
    """kind, key, sub, block, out, and the kept columns: in buckets (kind, key) of several components, each member in a part (sub) and, marked out, those outside of the largest component in a block; every part meets every block. weight: summed up, no more than about ``most`` in either."""
    counts = own.groupBy("kind", "key", "component").agg(F.count("*").alias("c"), F.sum(weight).alias("w"))
    mixed = counts.groupBy("kind", "key").agg(F.max(F.struct("c", "component", "w")).alias("main"), F.sum("c").alias("n"), F.sum("w").alias("w"), F.count("*").alias("parts")).where("parts > 1")
    pieces = lambda n, w: F.greatest(F.lit(1), F.ceil(n / hot), F.ceil(w / most)).cast("int")
    mixed = stored(mixed.select("kind", "key", F.col("main.component").alias("main"), pieces(F.col("n"), F.col("w")).alias("subs"), pieces(F.col("n") - F.col("main.c"), F.col("w") - F.col("main.w")).alias("blocks")), "mixed")
    rows = own.join(mixed, ["kind", "key"])
    number = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = rows.select("kind", "key", *keep, number("subs").alias("sub"), "blocks").select("kind", "key", "sub", every("blocks").alias("block"), F.lit(False).alias("out"), *keep)
    outside = rows.where(F.col("component") != F.col("main")).select("kind", "key", *keep, number("blocks").alias("block"), "subs").select("kind", "key", every("subs").alias("sub"), "block", F.lit(True).alias("out"), *keep)
    return members.unionByName(outside)


def _doubtful(met: DataFrame, parts: DataFrame, sketches: DataFrame, similarity: float, hot: int) -> DataFrame:
    """kind, key, node, component: members that may be similar to one of another component in the bucket. parts: node, component of linked nodes."""
    names = [c for c in sketches.columns if c != "node"]
    own = met.join(parts, "node", "left").select("kind", "key", "node", F.coalesce("component", "node").alias("component"), F.lit(0).alias("weight"))

    def search(batches):
        for columns, starts in _buckets(batches, 4):
            out, node, part = columns[4:7]
            x = np.stack([c.view(np.uint64) for c in columns[7:]], 1)
            found = np.zeros(len(node), bool)
            for s, e in zip(starts.tolist(), starts[1:].tolist(), strict=False):
                m, o = s + np.flatnonzero(~out[s:e]), s + np.flatnonzero(out[s:e])
                found[o], found[m] = across(x[m], part[m], x[o], part[o], similarity)
            yield pa.RecordBatch.from_arrays([pa.array(c[found]) for c in (columns[0], columns[1], node, part)], names=["kind", "key", "node", "component"])

    rows = _in_blocks(own, "weight", 1, ["node", "component"], hot).join(sketches, "node").select("kind", "key", "sub", "block", "out", "node", "component", *names)
    return rows.repartition("kind", "key", "sub", "block").sortWithinPartitions("kind", "key", "sub", "block").mapInArrow(search, "kind int, key long, node long, component long").distinct()


def _settled(doubtful: DataFrame, sets: DataFrame, similarity: float, hot: int) -> DataFrame:
    """a, b: exact links that join the components of doubtful members. sets: node, shingles."""

    def search(batches):
        for columns, starts in _buckets(batches, 4):
            out, node, part, data = columns[4:8]
            for s, e in zip(starts.tolist(), starts[1:].tolist(), strict=False):
                m, o = s + np.flatnonzero(~out[s:e]), s + np.flatnonzero(out[s:e])
                own = {i: np.frombuffer(data[i], np.uint64) for i in range(s, e)}
                found = np.array([(o[i], m[j]) for i, j in linking([own[i] for i in m.tolist()], part[m], [own[i] for i in o.tolist()], part[o], similarity)], np.int64).reshape(-1, 2)
                yield _pairs_of(node[found[:, 0]], node[found[:, 1]])

    own = doubtful.join(sets.select("node", F.octet_length("shingles").cast("long").alias("weight")), "node")
    rows = _in_blocks(own, "weight", SET_BYTES, ["node", "component"], hot).join(sets, "node").select("kind", "key", "sub", "block", "out", "node", "component", "shingles")
    return rows.repartition("kind", "key", "sub", "block").sortWithinPartitions("kind", "key", "sub", "block").mapInArrow(search, "a long, b long").distinct()


def _sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node, shingles (the sorted 64-bit hashes) of the nodes' texts; stored. docs: node, text."""

    def run(batches):
        for batch in lean(batches):
            found = [shingle_set(t, words).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["node", "shingles"])

    wanted = stored(nodes.select("node").distinct(), "wanted")
    return stored(docs.join(wanted, "node", "left_semi").mapInArrow(run, "node long, shingles binary").dropDuplicates(["node", "shingles"]), "shingles")


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs whose texts' sets of shingles have the similarity, exactly. docs: node, text."""

    def compare(batches):
        for batch in lean(batches):
            x, y = ([np.frombuffer(v.as_py(), np.uint64) for v in batch.column(i)] for i in (2, 3))
            both = np.array([len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(x, y, strict=True)], np.int64)
            total = np.array([len(a) + len(b) for a, b in zip(x, y, strict=True)], np.int64) - both
            yield batch.select([0, 1]).filter(pa.array(both >= similarity * total - 1e-9))

    own = _sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("node")), words)
    left = pairs.join(own.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(own.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, hot: int = HOT) -> DataFrame:
    """id, component_id of every row: near copies by Jaccard similarity of word shingles, through any chain."""
    kind = docs.schema[id_col].dataType.simpleString()
    bands, sketch = [f"k{i}" for i in range(BANDS)], [f"s{i}" for i in range(SKETCH + 1)]
    names = [*bands, *sketch]

    def run(batches):
        for batch in lean(batches):
            found = np.array([copy_marks(t, words) for t in batch.column(1).to_pylist()], np.uint64).reshape(-1, len(names)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(found[:, i])) for i in range(len(names))]], names=[id_col, *names])

    own = doc_columns(docs, id_col, text_col)
    made = own.mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{n} long" for n in names))
    # rows of equal marks are one node; the marks' hashes name it
    mark = [F.xxhash64(*names).alias("mark"), F.hash(*names).alias("mark2")]
    marked = stored(made.select(F.col(f"`{id_col}`").cast("long").alias(id_col), *mark, *names), "marks")
    nodes = stored(marked.groupBy("mark", "mark2").agg(F.min(id_col).alias("node"), *[F.first(n).alias(n) for n in names]), "nodes")
    known = nodes.where("node is not null")
    texts = own.select(F.col(f"`{id_col}`").cast("long").alias("node"), F.col(f"`{text_col}`").alias("text"))
    # thin rows first: most nodes share no band with any other, and their sketches need not move
    kinds = F.array(*[F.struct(F.lit(i).alias("kind"), F.col(c).alias("key")) for i, c in enumerate(bands)])
    dealt = known.select("node", F.explode(kinds).alias("b")).select("b.kind", "b.key", "node")
    sizes = stored(dealt.groupBy("kind", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    met = stored(dealt.join(sizes, ["kind", "key"], "left_semi"), "met")
    sketches = known.select("node", *sketch)
    near = near_links(known.select("node", F.col("s0").alias("fp")), hot=hot).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = stored(near.union(_forest_pairs(met, sizes, sketches, similarity, hot)).distinct(), "pairs")
    links = stored(_confirmed(pairs, texts, words, similarity), "links")
    parts = stored(connected_components(links), "parts")
    doubtful = stored(_doubtful(met, parts, sketches, similarity, hot), "doubtful")
    if not doubtful.isEmpty():
        further = stored(_settled(doubtful, _sets(texts, doubtful, words), similarity, hot), "further")
        if not further.isEmpty():
            parts = stored(connected_components(parts.select(F.col("component").alias("a"), F.col("node").alias("b")).union(further)), "parts")
    named = stored(nodes.select("mark", "mark2", "node").join(parts, "node", "left").select("mark", "mark2", F.coalesce("component", "node").alias("component_id")), "components")
    return marked.select(id_col, "mark", "mark2").join(named, ["mark", "mark2"]).select(id_col, "component_id")


def representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents whose id is their component's smallest, all columns; of rows that repeat an id one stays, the first by a hash of all columns.

    Rows with a null id are kept: no decision can name them."""
    found = near_copies(docs, id_col=id_col, text_col=text_col, words=words, similarity=similarity)
    key = unused("_id", docs)
    ids = found.groupBy(F.col(id_col).alias(key)).agg(F.max(F.col(id_col) == F.col("component_id")).alias("kept"), F.count("*").alias("rows")).where(F.col(key).isNotNull())
    ids = stored(ids.where("NOT kept OR rows > 1"), "decisions")
    # the fewer ids: those that go or repeat. Small enough, they are broadcast, and no text is shuffled
    own = F.col(f"`{id_col}`").cast("long")
    single = docs.join(ids.select(key), own == F.col(key), "left_anti")
    again = docs.join(ids.where("kept AND rows > 1").select(key), own == F.col(key), "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = again.groupBy(own.alias(key)).agg(F.min_by(row, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).alias("_row"))
    return single.unionByName(one.select("_row.*"))
