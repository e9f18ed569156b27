"""Benchmark decontamination by winnowing, in DataFrame functions only.

1. Winnowing: of every ``w`` neighbouring k-word hashes the smallest is a fingerprint (all places of it, where it stands
   more than once). With k + w - 1 = the window's length, any shared window holds a shared fingerprint at the same
   place in both texts: the guarantee of Schleimer, Wilkerson and Aiken (2003).
2. Documents' fingerprints are semi-joined with the distinct ones of the items, so a hit is a place in a document, however
   many items hold it. A fingerprint of the index is one long, so counting them (``broadcast_rows``) bounds the bytes of
   its broadcast; beyond that both sides are shuffled and skewed hashes may be split.
3. Extension: documents with hits are read again; around each hit the whole windows that hold it are spelled out and
   joined with the items' distinct windows. Words, not hashes, decide.
4. A document's matched windows are merged into covered words by a running maximum, streamed per document: its windows
   are at most as many as its words, whatever repeats in it or in the items.

Items of fewer words than the window are one window each; every length that occurs among them has a pass of its own with
a k and w of its own, planned only where such items exist.

Null and empty texts have no words and no hits; an item without words never matches. An item is what its id names: rows
that share an id are one item, found if any of their texts is; a null id is an item named by the empty string. Rows of
documents that repeat an id are judged each by its own text; a null id is an id like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, unused

WINDOW = 10
# What separates words once A-Z is lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_ROWS = 1_000_000  # of one long each, about 40 bytes when hashed


def _words(text: Column) -> Column:
    """A-Z lower-cased only: what becomes of other letters may depend on their neighbours (a capital sigma does)."""
    plain = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    # a separator at either end makes the first and the last piece empty, always
    pieces = F.split(F.concat(F.lit(" "), F.coalesce(plain, F.lit("")), F.lit(" ")), SEPARATORS)
    return F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0)))


def _spans(df: DataFrame, column: str, length: int, f) -> DataFrame:
    """Replaces column by f over every run of length neighbours, by doubling; f may see neighbours twice.

    Each step is a projection of its own, so that no array is computed twice."""
    have = 1
    while have < length:
        step = min(have, length - have)
        n = F.greatest(F.size(column) - step, F.lit(0))
        df = df.withColumn(column, F.zip_with(F.slice(column, 1, n), F.slice(column, step + 1, n), f))
        have += step
    return df


def fingerprints(texts: DataFrame, k: int, w: int) -> DataFrame:
    """texts' columns but words, then place and h: the winnowed k-word hashes."""
    keys = [c for c in texts.columns if c != "words"]
    df = texts.select(*keys, F.transform("words", lambda x: F.xxhash64(x)).alias("gram"))
    df = _spans(df, "gram", k, lambda a, b: F.xxhash64(a, b)).withColumn("low", F.col("gram"))
    df = _spans(df, "low", w, lambda a, b: F.least(a, b))
    # the largest of the minima of all windows that hold a place equals its own hash where it is one of them
    edge = F.array_repeat(F.lit(-(1 << 63)).cast("long"), w - 1)
    df = df.withColumn("low", F.when(F.size("low") > 0, F.concat(edge, "low", edge)).otherwise(F.col("low")))
    df = _spans(df, "low", w, lambda a, b: F.greatest(a, b))
    marks = df.select(*keys, F.posexplode(F.arrays_zip("gram", "low")).alias("place", "x")).where("x.gram = x.low")
    return marks.select(*keys, "place", F.col("x.gram").alias("h"))


def _lengths(n: int) -> tuple[int, int]:
    """k and w of a guarantee for windows of n words."""
    k = max(1, n // 2)
    return k, n - k + 1


def items_of(benchmark: DataFrame, item_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """cls, words, n (of its windows), item_ids: equal word sequences are one class."""
    rows = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item_id"), _words(F.col(f"`{text_col}`")).alias("words")).where(F.size("words") > 0)
    return rows.groupBy("words").agg(F.collect_set("item_id").alias("item_ids")).select(F.md5(F.array_join("words", " ")).alias("cls"), "words", F.least(F.size("words"), F.lit(window)).alias("n"), "item_ids")


def _spelled(words: Column, start: Column, n: int) -> Column:
    """n words from a place (from 0) as text; no word holds a space."""
    return F.array_join(F.slice(words, start + 1, n), " ")


def _extended(texts: DataFrame, items: DataFrame, n: int, broadcast_rows: int) -> DataFrame:
    """doc, mark, start, n, win: windows of n words that documents share with items. texts: doc, mark, text."""
    k, w = _lengths(n)
    index = stored(fingerprints(items.select("words"), k, w).select("h").distinct(), "benchmark")
    small = index.count() <= broadcast_rows
    marks = fingerprints(texts.select("doc", "mark", _words(F.col("text")).alias("words")), k, w)
    hits = stored(marks.join(F.broadcast(index) if small else index, "h", "left_semi").select("doc", "mark", "place"), "hits")
    places = hits.groupBy("doc", "mark").agg(F.collect_set("place").alias("places"))  # no more than the document has words
    wanted = stored(hits.select("doc", "mark").distinct(), "wanted")
    read = texts.join(wanted, _same_row(texts, wanted), "left_semi").dropDuplicates(["doc", "mark"])
    read = read.join(places, _same_row(read, places)).select(read["doc"], read["mark"], _words(F.col("text")).alias("words"), "places")
    # the windows that hold a place; a text with a hit has n words
    around = F.transform("places", lambda p: F.sequence(F.greatest(p - (w - 1), F.lit(0)), F.least(p, F.size("words") - n)))
    read = read.select("doc", "mark", "words", F.array_distinct(F.flatten(around)).alias("starts"))
    spelled = F.transform("starts", lambda s: F.struct(s.alias("start"), _spelled(F.col("words"), s, n).alias("win")))
    found = read.select("doc", "mark", F.explode(spelled).alias("x")).select("doc", "mark", "x.start", F.lit(n).alias("n"), "x.win")
    return found.join(_windows(items, n).select("win").distinct(), "win", "left_semi").select("doc", "mark", "start", "n", "win")


def _windows(items: DataFrame, n: int) -> DataFrame:
    """win, cls: the windows of n words of every class."""
    each = F.transform(F.sequence(F.lit(0), F.size("words") - n), lambda s: _spelled(F.col("words"), s, n))
    return items.select("cls", F.explode(F.array_distinct(each)).alias("win"))


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    """Rows are known by their id (null included) and a hash of their text."""
    return a["doc"].eqNullSafe(b["doc"]) & (a["mark"] == b["mark"])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("doc"), F.xxhash64(F.col(f"`{text_col}`")).alias("mark"), F.col(f"`{text_col}`").alias("text"))


def _contaminated(own: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, window: int, broadcast_rows: int) -> DataFrame | None:
    """doc, mark, n_hit, item_ids (sorted) of the rows (doc, mark, text) with hits; None if no item has words."""
    items = stored(items_of(benchmark, item_col, item_text_col, window), "items")
    matched, windows = None, None
    for n in sorted(r["n"] for r in items.select("n").distinct().collect()):  # at most ``window`` lengths
        of_length = items.where(F.col("n") == n)
        more, own_windows = _extended(own, of_length, n, broadcast_rows), _windows(of_length, n)
        matched = more if matched is None else matched.union(more)
        windows = own_windows if windows is None else windows.union(own_windows)
    if matched is None:
        return None
    matched = stored(matched, "matched")
    order = Window.partitionBy("doc", "mark").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    fresh = matched.select("doc", "mark", F.greatest(end - F.greatest("start", F.coalesce(F.max(end).over(order), F.lit(0))), F.lit(0)).alias("fresh"))
    hit = fresh.groupBy("doc", "mark").agg(F.sum("fresh").cast("long").alias("n_hit"))
    classes = matched.select("doc", "mark", "win").distinct().join(windows, "win").select("doc", "mark", "cls").distinct()
    named = classes.join(items.select("cls", "item_ids"), "cls").groupBy("doc", "mark").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    return stored(hit.join(named, _same_row(hit, named)).select(hit["doc"], hit["mark"], "n_hit", "item_ids"), "contaminated")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """id, n_words, n_hit, n_items, item_ids (distinct, sorted as strings), contaminated of every row."""
    own = _rows(docs, id_col, text_col)
    counted = own.select("doc", "mark", F.size(_words(F.col("text"))).cast("long").alias("n_words"))
    done = _contaminated(own, benchmark, item_col, item_text_col, window, broadcast_rows)
    none, zero = F.array().cast("array<string>"), F.lit(0).cast("long")
    if done is None:
        return counted.select(F.col("doc").alias(id_col), "n_words", zero.alias("n_hit"), zero.alias("n_items"), none.alias("item_ids"), F.lit(False).alias("contaminated"))
    joined = counted.join(done, _same_row(counted, done), "left")
    return joined.select(counted["doc"].alias(id_col), "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", none).alias("item_ids"), F.col("n_hit").isNotNull().alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs (all columns) without any hit."""
    done = _contaminated(_rows(docs, id_col, text_col), benchmark, item_col, item_text_col, window, broadcast_rows)
    if done is None:
        return docs
    doc, mark = unused("_doc", docs), unused("_mark", docs)
    bad = stored(done.select(F.col("doc").alias(doc), F.col("mark").alias(mark)), "bad")  # its size is known when the join is planned
    return docs.join(bad, docs[f"`{id_col}`"].eqNullSafe(bad[doc]) & (F.xxhash64(docs[f"`{text_col}`"]) == bad[mark]), "left_anti")
