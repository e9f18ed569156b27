"""Timelines: dated events, confidence, density, similarity and merging."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import lexicons as L
from ..functions import text as T
from ..sources.scratch import stored
from .graph import connected_components

REACH = 200


def _mentions(docs: DataFrame, id_col: str, text_col: str, loose: bool = False, contexts: bool = False) -> DataFrame:
    """id, text, m: distinct mentions in pattern order, each with what it parses to and, if asked, its context; a document's are in its row. loose: dates in words and Roman years come after those of the patterns, and the grammar reads what the patterns leave unknown."""
    text = F.col(text_col)
    found = F.array_distinct(F.concat(D.mentions(text), D.loose_mentions(text)) if loose else D.mentions(text))
    one = lambda x: F.struct(x.alias("date_str"), (D.parse_any(x) if loose else D.parse_date(x)).alias("p"), *([context(text, x).alias("context")] if contexts else []))
    return docs.select(id_col, text.alias("_text"), F.transform(found, one).alias("m"))


def _each(m: DataFrame) -> DataFrame:
    """m's columns but m, seq, x: a row for each element. The explosion is an outer one, as Spark filters by the array's size before an inner one and makes the array for that once more."""
    return m.select(*[c for c in m.columns if c != "m"], F.posexplode_outer("m").alias("seq", "x")).where("seq IS NOT NULL")


def date_mentions(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", loose: bool = False) -> DataFrame:
    """id, seq, date_str, date, precision, year: distinct mentions in pattern order, the first of equals; narrow."""
    rows = _each(_mentions(docs, id_col, text_col, loose).drop("_text"))
    return rows.select(id_col, "seq", "x.date_str", F.col("x.p.date").alias("date"), F.col("x.p.precision").alias("precision"), F.col("x.p.year").alias("year"))


def context(text: Column, date_str: Column) -> Column:
    """Up to 200 characters on either side of the first occurrence."""
    at = F.instr(text, date_str) - 1
    start = F.greatest(at - REACH, F.lit(0))
    return F.substring(text, start + 1, at + F.length(date_str) + REACH - start)


def description(own: Column, date_str: Column) -> Column:
    """The first sentence with the date and an event's word, else the context's beginning."""
    pieces = F.transform(F.split(own, "[.!?]+"), lambda s: F.regexp_replace(F.trim(s), r"\s+", " "))
    fits = F.filter(pieces, lambda s: F.contains(s, date_str) & T.has_any(F.lower(s), L.EVENT_KEYWORDS))
    return F.coalesce(F.get(fits, 0), F.concat(F.trim(F.substring(own, 1, 200)), F.lit("...")))


def confidence(text: Column, date_str: Column, n_entities: Column) -> Column:
    """.5, .2 for five words or more, up to .3 for entities, -.1 for vague dates or else .1 for a four-digit number; within .1 and 1."""
    low = F.lower(date_str)
    score = 0.5 + F.when(F.size(F.split(F.trim(text), r"\s+")) >= 5, 0.2).otherwise(0.0) + F.least(F.lit(0.3), 0.05 * n_entities)
    vague = T.has_any(low, ["century", "decade", "circa"])
    score = score + F.when(vague, -0.1).when(date_str.rlike("[0-9]{4}"), 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), score))


def events(docs: DataFrame, entities: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", most: int = 10) -> DataFrame:
    """event_id, id, seq, description, date, precision, year, decade, century, date_str, context, entities, confidence."""
    kind = "array<struct<entity:string,label:string>>"
    own_context = F.col("x.context")
    if entities is None:
        # contexts are cut behind the explosion, so that queries without them don't make any
        m, own_context = _mentions(docs, id_col, text_col).withColumn("_e", F.array().cast(kind)), context(F.col("_text"), F.col("date_str"))
    else:
        m = _mentions(docs, id_col, text_col, contexts=True).drop("_text")
        # contexts and entities meet, texts don't move; rows that repeat an id each meet that id's entities
        own = entities.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", F.struct("entity", "label").alias("x")))), lambda s: s["x"]).alias("_e"))
        m = m.join(own, id_col, "left").withColumn("_e", F.coalesce("_e", F.array().cast(kind)))
    e = _each(m).withColumn("date_str", F.col("x.date_str"))
    e = e.select(id_col, "seq", "date_str", F.col("x.p.date").alias("date"), F.col("x.p.precision").alias("precision"), F.col("x.p.year").alias("year"), own_context.alias("context"), "_e")
    e = e.withColumn("entities", F.slice(F.filter("_e", lambda x: F.contains(F.lower("context"), F.lower(x["entity"]))), 1, most)).drop("_e")
    e = e.withColumn("description", description(F.col("context"), F.col("date_str")))
    e = e.withColumn("decade", D.decade(F.col("year"))).withColumn("century", D.century(F.col("year")))
    e = e.withColumn("confidence", confidence(F.col("description"), F.col("date_str"), F.size("entities")))
    return e.withColumn("event_id", F.concat_ws("_", F.col(id_col).cast("string"), F.col("seq").cast("string")))


def sorted_events(e: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """By date, undated ones last, then by document and place."""
    return e.orderBy(F.col("date").asc_nulls_last(), id_col, "seq")


def year_range(e: DataFrame) -> DataFrame:
    known = F.when(F.col("year") != 0, F.col("year"))
    return e.agg(F.coalesce(F.min(known), F.lit(1900)).alias("first_year"), F.coalesce(F.max(known), F.lit(2000)).alias("last_year"))


def density(e: DataFrame) -> DataFrame:
    return e.where("year != 0").groupBy("year").agg(F.count("*").cast("double").alias("density"))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


DATED = "coalesce(year, 0) != 0"


def _keyed_events(e: DataFrame, id_col: str) -> DataFrame:
    """Dated events with what equal ones share (year, date, precision, description, entities) and a hash of it."""
    names = F.array_sort(F.array_distinct(F.transform("entities", lambda x: F.lower(x["entity"]))))
    when = F.coalesce("date", F.to_date(F.concat(F.lpad(F.col("year").cast("string"), 4, "0"), F.lit("-06-15"))))
    d = e.where(DATED).select("year", "date", when.alias("time"), "precision", "description", F.array_sort(word_set(F.col("description"))).alias("words"), names.alias("names"), "entities", "confidence", F.col(id_col).cast("string").alias("source"), "event_id")
    return d.withColumn("key", F.sha2(F.to_json(F.struct("year", "date", "precision", "description", "names"), {"ignoreNullFields": "false"}), 256))


def _distinct_events(keyed: DataFrame) -> DataFrame:
    """One row for equal events, named by the smallest id, with their number and confidence."""
    shared = ["year", "date", "time", "precision", "description", "words", "names"]
    return keyed.groupBy("key").agg(*[F.min(c).alias(c) for c in shared], F.min_by("entities", "event_id").alias("entities"), F.min("event_id").alias("event_id"), F.count("*").alias("n"), F.sum("confidence").alias("confidence"))


CLOSE = ((1, 0.4), (5, 0.2), (10, 0.1))  # years apart, what that counts
WORDS, NAMES = 0.4, 0.2  # what equal words and equal entities count


def _candidates(one: DataFrame, threshold: float) -> DataFrame:
    """a, b, similarity of rows (year, words, names, event_id) at or above the threshold, each pair once.

    How far apart the years are, and whether entities are shared at all, says what Jaccard t of the word sets is still
    needed. Two such sets share a word among the first n - ceil(t * n) + 1 of each, with rare words first: for each case
    the join is on that word (and a shared entity) and the time, so what all events have in common brings none together."""
    if threshold <= CLOSE[0][1] + NAMES:
        raise ValueError("pairs without shared words can reach the threshold")
    often = one.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("c"))
    ordered = one.select("event_id", F.explode("words").alias("w")).join(often, "w").groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "w"))), lambda x: x["w"]).alias("rare"))
    rows, found = stored(one.join(ordered, "event_id"), "rare"), None
    for years, counts in CLOSE:
        for shared in (False, True):
            least = (threshold - counts - NAMES * shared) / WORDS
            if least > 1 + 1e-9:
                continue
            word = F.explode(F.slice("rare", 1, (F.size("words") - F.ceil(F.size("words") * least - 1e-9) + 1).cast("int")))
            keyed = rows.select("event_id", "year", "words", "names", word.alias("word"))
            keyed = keyed.withColumn("name", F.explode("names") if shared else F.lit(""))
            bucket = F.floor(F.col("year") / (years + 1))
            a = keyed.select("word", "name", F.col("event_id").alias("a"), F.col("year").alias("y1"), F.col("words").alias("w1"), F.col("names").alias("n1"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
            b = keyed.select("word", "name", F.col("event_id").alias("b"), F.col("year").alias("y2"), F.col("words").alias("w2"), F.col("names").alias("n2"), bucket.alias("bucket"))
            gap = F.abs(F.col("y1") - F.col("y2"))
            pairs = a.join(b, ["word", "name", "bucket"]).where((F.col("a") < F.col("b")) & (gap <= years))
            closeness = F.lit(0.0)
            for limit, value in reversed(CLOSE):
                closeness = F.when(gap <= limit, value).otherwise(closeness)
            both = (F.size("n1") > 0) & (F.size("n2") > 0)
            score = closeness + WORDS * jaccard(F.col("w1"), F.col("w2")) + F.when(both, NAMES * jaccard(F.col("n1"), F.col("n2"))).otherwise(0.0)
            # a cheap bound first: word sets whose sizes alone rule the threshold out never get compared
            bound = closeness + WORDS * F.least(F.size("w1"), F.size("w2")) / F.greatest(F.size("w1"), F.size("w2"), F.lit(1)) + F.when(both, NAMES).otherwise(0.0)
            near = pairs.where(bound >= threshold - 1e-12).select("a", "b", score.alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)
            found = near if found is None else found.union(near)
    return found.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def similarity_pairs(e: DataFrame, *, threshold: float = 0.7) -> DataFrame:
    """a, b, similarity of events at or above the threshold: .4, .2 or .1 for years within 1, 5 or 10, .4 Jaccard of words, .2 of entities.

    Equal (year, words, entities) are collapsed first and named by their smallest id: a group of copies has one row here."""
    names = F.array_sort(F.array_distinct(F.transform("entities", lambda x: F.lower(x["entity"]))))
    base = e.where("year != 0").select("year", F.array_sort(word_set(F.col("description"))).alias("words"), names.alias("names"), "event_id")
    return _candidates(base.groupBy("year", "words", "names").agg(F.min("event_id").alias("event_id")), threshold)


def _leaders(batches):
    """Rows (component, later's date and id, earlier's date and id), sorted, to (event_id, leader): an event follows the earliest similar one that follows none itself.

    What is held are the followers of the last REACH_YEARS in one component, whatever its size."""
    followers: dict[str, int] = {}
    part = event = None
    for batch in batches:
        out = []
        for component, days, later, earlier in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if component != part:
                part, event = component, None
                followers.clear()
            if later != event:
                event = later
                while followers and days - followers[oldest := next(iter(followers))] > 366 * (REACH_YEARS + 1):
                    del followers[oldest]
            if event not in followers and earlier not in followers:
                followers[event] = days
                out.append((event, earlier))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], names=["event_id", "leader"])


REACH_YEARS = 10
ENTITIES = pa.list_(pa.struct([("entity", pa.string()), ("label", pa.string())]))
COMBINED = [("leader", pa.string()), ("event_id", pa.string()), ("year", pa.int32()), ("date", pa.date32()), ("precision", pa.string()), ("description", pa.string()), ("entities", ENTITIES), ("merged_from", pa.int64()), ("confidence", pa.float64())]


def _combined(batches):
    """Rows (leader, event_id, year, date, precision, description, words, entities, n, confidence), sorted by leader and time, to one event per leader: nothing but its sums, its best event, three descriptions and its distinct entities is held."""
    now: dict | None = None

    def closed(m: dict) -> tuple:
        return (m["leader"], *m["best"][1], "; ".join(d for _, d in m["kept"]), list(m["entities"].values()), m["n"], m["confidence"] / m["n"])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(COMBINED)], names=[n for n, _ in COMBINED])

    for batch in batches:
        done = []
        for leader, event, year, date, precision, description, words, entities, n, confidence in zip(*(batch.column(i).to_pylist() for i in range(10)), strict=True):
            if now is None or now["leader"] != leader:
                if now is not None:
                    done.append(closed(now))
                now = {"leader": leader, "best": None, "kept": [], "entities": {}, "n": 0, "confidence": 0.0}
            rank, own = D.RANK.get(precision, 0), set(words)
            if now["best"] is None or rank > now["best"][0]:
                now["best"] = (rank, (event, year, date, precision))
            if len(now["kept"]) < 3 and not any(own & w for w, _ in now["kept"]):
                now["kept"].append((own, description))
            for x in entities or ():
                if x["entity"]:
                    now["entities"].setdefault(x["entity"].lower(), x)
            now["n"] += n
            now["confidence"] += confidence
        yield made(done)
    if now is not None:
        yield made([closed(now)])


def merge(e: DataFrame, *, threshold: float = 0.7, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Merged events, and (event_id, source): the documents that each stands for.

    Leader clustering in timeline order, then one event per leader: the earliest event of the best precision with its
    date, up to three descriptions without a shared word, the members' distinct entities (by lower case, the first
    spelling stays), number of merged events and of sources, mean confidence. Events without a year, or of year 0, are
    like no other: they stay as they are.

    Only similar pairs decide, so what follows what is a pass over each connected component's pairs in time order; the
    pass is sequential by definition, but holds no more than the last years' followers. Equal events are one row."""
    keyed = _keyed_events(e, id_col)
    one = stored(_distinct_events(keyed), "events")
    pairs = stored(_candidates(one.select("year", "words", "names", "event_id"), threshold).select("a", "b"), "pairs")
    parts = connected_components(pairs.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")))
    a, b = (one.select(F.col("event_id").alias(n), F.struct("time", "event_id").alias(f"k{n}")) for n in ("a", "b"))
    ordered = pairs.join(a, "a").join(b, "b").select(F.least("ka", "kb").alias("first"), F.greatest("ka", "kb").alias("second"))
    rows = ordered.withColumn("node", F.xxhash64("second.event_id")).join(parts, "node").select("component", F.unix_date("second.time").alias("days"), F.col("second.event_id").alias("later"), F.col("first.event_id").alias("earlier"), F.unix_date("first.time").alias("before"))
    sorted_ = rows.repartition("component").sortWithinPartitions("component", "days", "later", "before", "earlier").drop("before")
    led = stored(sorted_.mapInArrow(_leaders, "event_id string, leader string"), "leaders")
    of = one.join(led, "event_id", "left").withColumn("leader", F.coalesce("leader", "event_id"))
    heads = led.select("leader").distinct()
    grouped = of.join(heads, "leader", "left_semi").repartition("leader").sortWithinPartitions("leader", "time", "event_id")
    schema = "leader string, event_id string, year int, date date, precision string, description string, entities array<struct<entity:string,label:string>>, merged_from long, confidence double"
    combined = grouped.select("leader", "event_id", "year", "date", "precision", "description", "words", "entities", "n", "confidence").mapInArrow(_combined, schema)
    alone = of.join(heads, "leader", "left_anti").select("leader", "event_id", "year", "date", "precision", "description", "entities", F.col("n").alias("merged_from"), (F.col("confidence") / F.col("n")).alias("confidence"))
    dated = stored(combined.unionByName(alone), "merged")
    sources = keyed.select("key", "source").distinct().join(of.select("key", "leader"), "key").join(dated.select("leader", F.col("event_id").alias("named")), "leader").select(F.col("named").alias("event_id"), "source").distinct()
    numbers = sources.groupBy("event_id").agg(F.count("source").alias("n_sources"))
    undated = e.where(f"NOT ({DATED})").select("event_id", F.col("year").cast("int").alias("year"), "date", "precision", "description", "entities", F.lit(1).cast("long").alias("merged_from"), F.col("confidence").cast("double").alias("confidence"), F.when(F.col(id_col).isNull(), 0).otherwise(1).cast("long").alias("n_sources"))
    out = dated.drop("leader").join(numbers, "event_id", "left").fillna({"n_sources": 0}).unionByName(undated)
    members = sources.union(e.where(f"NOT ({DATED})").select("event_id", F.col(id_col).cast("string").alias("source"))).where("source IS NOT NULL")
    return out.select("event_id", "year", "date", "precision", "description", "entities", "merged_from", "n_sources", "confidence"), members


def merged(e: DataFrame, *, threshold: float = 0.7, id_col: str = "doc_id") -> DataFrame:
    return merge(e, threshold=threshold, id_col=id_col)[0]
