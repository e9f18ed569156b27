"""Entities: gazetteer and rule matches with offsets, resolution, counts, co-occurrence, network.

Offsets come from the matches and the pieces between them, so no Python is needed. A statistical recogniser can be
plugged in as a DataFrame of the same columns (id, entity, label, start, end, confidence, source)."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L

# Rule patterns. Names are runs of capitalised words.
RULE_DATES = [
    r"(?i)\b[0-9]{1,2}(?:st|nd|rd|th)\s+century\b",
    r"\b(?:1[0-9]{3}|20[0-9]{2})[-–—](?:1[0-9]{3}|20[0-9]{2})\b",
    r"(?i)\b(?:circa|c\.?|approx\.?|approximately|around|about)\s+[0-9]{3,4}\b",
    r"(?i)\b(?:Spring|Summer|Autumn|Fall|Winter)(?:\s+of)?\s+[0-9]{4}\b",
    r"(?i)\b(?:early|mid|middle|late)\s+(?:[0-9]{1,2}(?:st|nd|rd|th)\s+)?century\b",
    r"\b(?:[Rr]eign|[Rr]ule|[Ee]ra)\s+of\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b",
]
RULE_EVENTS = [
    (r"\b(?:Battle|Siege|War|Revolution|Treaty|Conference)\s+of\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b", "EVENT"),
    (r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:War|Revolution|Treaty|Alliance)\b", "EVENT"),
    (r"\b(?:Proclamation|Declaration|Manifesto|Charter|Constitution)\s+of\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b", "DOCUMENT"),
]
TITLED = rf"\b(?:{'|'.join(L.TITLES)})(?:\s+[A-Z]\w+)+"
ENTITY = "array<struct<entity: string, start: int, end: int>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once: it is bound as the only element of an array."""
    return F.get(F.transform(F.array(value), use), 0)


def spans(text: Column, pattern: str) -> Column:
    """Matches with half-open character offsets: a fold over the pieces between matches, which are cut only where there is one."""
    start = F.struct(F.array().cast(ENTITY).alias("out"), F.lit(0).alias("at"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + F.length(x["m"])
        return F.struct(F.concat(state["out"], F.array(F.struct(x["m"].alias("entity"), begin.alias("start"), end.alias("end")))).alias("out"), end.alias("at"))

    def folded(found: Column) -> Column:
        zipped = F.zip_with(found, F.slice(F.split(text, pattern, -1), 1, F.size(found)), lambda m, p: F.struct(m.alias("m"), F.length(p).alias("gap")))
        return F.when(F.size(found) > 0, F.aggregate(zipped, start, step, lambda s: s["out"]))

    return F.coalesce(_let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), folded), F.array().cast(ENTITY))


def _each(rows: DataFrame, id_col: str, made: Column) -> DataFrame:
    """id and the fields of each element. The explosion is an outer one: before an inner one Spark filters by the array's size, and makes the array for that once more."""
    return rows.select(id_col, F.explode_outer(made).alias("e")).where("e IS NOT NULL").select(id_col, "e.*")


def rule_entities(docs: DataFrame, rules: list[tuple[str, str] | tuple[str, str, float]], confidence: float = 1.0, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, entity, label, start, end, confidence, source of every rule's matches; narrow. A rule is a pattern and a label, and may have a confidence of its own."""

    def labelled(pattern: str, label: str, sure: float = confidence) -> Column:
        return F.transform(spans(F.col(text_col), pattern), lambda s: F.struct(s["entity"].alias("entity"), F.lit(label).alias("label"), s["start"].alias("start"), s["end"].alias("end"), F.lit(sure).alias("confidence")))

    each = [labelled(*rule) for rule in rules]
    return _each(docs, id_col, F.concat(*each)).withColumn("source", F.lit("rule"))


def gazetteer_entities(docs: DataFrame, gazetteer: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", confidence: float = 0.95, block: int = 200_000) -> DataFrame:
    """Case-insensitive occurrences of terms (term, category), anywhere in the text; of overlapping ones the first, then the longest, stays.

    One automaton looks for all terms at once. A gazetteer of more than about ``block`` terms is dealt into blocks by a hash,
    and each has a pass of its own: the driver and a task hold one block, and results are the same at every size. Null and
    empty terms match nothing."""
    kind = docs.schema[id_col].dataType.simpleString()
    terms = gazetteer.select(F.lower("term").alias("low"), "category").where("low <> ''").distinct()
    blocks = max(1, -(-terms.count() // block))
    texts = docs.select(id_col, F.col(text_col).alias("_text"), F.lower(text_col).alias("_low")).where("_low IS NOT NULL")
    found = None
    for i in range(blocks):
        own: dict[str, list[str]] = {}
        for r in terms.where(F.pmod(F.xxhash64("low"), F.lit(blocks)) == i).collect():
            own.setdefault(r["low"], []).append(r["category"])
        rows = texts.mapInArrow(_matcher(docs.sparkSession.sparkContext.broadcast(own), id_col), f"`{id_col}` {kind}, entity string, category string, start int, end int")
        found = rows if found is None else found.union(rows)
    e = found.select(id_col, "entity", label_of(F.col("category")).alias("label"), "start", "end")
    return first_longest(e, id_col).withColumn("confidence", F.lit(confidence)).withColumn("source", F.lit("gazetteer"))


def _matcher(terms, id_col: str):
    """Batches of (id, text, lower-case text) to a row for every place of every term; offsets count characters."""

    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for low, categories in terms.value.items():
            automaton.add_word(low, (len(low), categories))
        if terms.value:
            automaton.make_automaton()
        for batch in batches:
            at, entities, names, starts, ends = [], [], [], [], []
            if terms.value:
                for i, (text, low) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                    if len(low) != len(text):  # a letter whose lower case is longer: such letters stay as they are, so that offsets hold
                        low = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
                    for end, (n, categories) in automaton.iter(low):
                        for category in categories:
                            at.append(i)
                            entities.append(text[end - n + 1 : end + 1])
                            names.append(category)
                            starts.append(end - n + 1)
                            ends.append(end + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(entities, pa.string()), pa.array(names, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[id_col, "entity", "category", "start", "end"])

    return run


def label_of(category: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in L.GAZETTEER_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, category), F.upper(category))


def _rows(e: DataFrame, id_col: str, key: list[Column]) -> DataFrame:
    names = [c for c in e.columns if c != id_col]
    return e.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(*key, F.struct(*names).alias("e")))).alias("all"))


def first_longest(e: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Greedy choice of disjoint spans by start, then length, then label."""
    rows = _rows(e, id_col, [F.col("start").alias("k1"), (-F.col("end")).alias("k2"), F.col("label").alias("k3")])
    kind = rows.schema["all"].dataType.simpleString()
    fold = F.aggregate("all", F.array().cast(kind), lambda out, x: F.when((F.size(out) == 0) | (F.element_at(out, -1)["e"]["end"] <= x["e"]["start"]), F.concat(out, F.array(x))).otherwise(out))
    return rows.select(id_col, F.explode(F.transform(fold, lambda x: x["e"])).alias("e")).select(id_col, "e.*")


def resolve(e: DataFrame, *, id_col: str = "doc_id", compat: bool = False) -> DataFrame:
    """Disjoint entities. Spans are taken by start, longest first; the kept ones are disjoint, so only the last can overlap.

    On overlap the more confident, then the longer, stays. compat: the new span is dropped, and if it is longer or more
    confident than 0.8 it takes the kept one with it."""
    rows = _rows(e, id_col, [F.col("start").alias("k1"), (-F.col("end")).alias("k2"), (-F.col("confidence")).alias("k3"), F.col("label").alias("k4")])
    kind = rows.schema["all"].dataType.simpleString()

    def step(out: Column, x: Column) -> Column:
        last = F.element_at(out, -1)["e"]
        clear = (F.size(out) == 0) | (last["end"] <= x["e"]["start"])
        longer = (x["e"]["end"] - x["e"]["start"]) > (last["end"] - last["start"])
        shorter_out = F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))
        if compat:
            return F.when(clear, F.concat(out, F.array(x))).when((x["e"]["confidence"] > 0.8) | longer, shorter_out).otherwise(out)
        better = (x["e"]["confidence"] > last["confidence"]) | ((x["e"]["confidence"] == last["confidence"]) & longer)
        return F.when(clear, F.concat(out, F.array(x))).when(better, F.concat(shorter_out, F.array(x))).otherwise(out)

    fold = F.aggregate("all", F.array().cast(kind), step)
    return rows.select(id_col, F.explode(F.transform(fold, lambda x: x["e"])).alias("e")).select(id_col, "e.*")


def valid(e: DataFrame) -> DataFrame:
    """At least two characters, half of them letters or digits."""
    return e.where((F.length("entity") >= 2) & (F.length(F.regexp_replace("entity", r"[^\p{L}\p{N}]", "")) >= 0.5 * F.length("entity")))


def cooccurrence(e: DataFrame, *, id_col: str = "doc_id", gap: int = 100) -> DataFrame:
    """label_a, label_b, n: pairs of a document's entities of which the later starts at most gap characters after the first one's end.

    A range join by buckets: an entity looks only into its own bucket of starts and those within reach."""
    width = gap
    a = e.select(F.col(id_col).alias("d"), F.col("start").alias("s1"), F.col("end").alias("e1"), F.col("label").alias("l1"), F.col("entity").alias("n1"))
    reach = a.select("*", F.explode(F.sequence(F.floor(F.col("s1") / width), F.floor((F.col("e1") + gap) / width))).alias("bucket"))
    b = e.select(F.col(id_col).alias("d"), F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("label").alias("l2"), F.col("entity").alias("n2"), F.floor(F.col("start") / width).alias("bucket"))
    later = (F.col("s2") > F.col("s1")) | ((F.col("s2") == F.col("s1")) & (F.struct("e2", "l2", "n2") > F.struct("e1", "l1", "n1")))
    pairs = reach.join(b, ["d", "bucket"]).where(later & (F.col("s2") - F.col("e1") <= gap))
    return pairs.groupBy(F.least("l1", "l2").alias("label_a"), F.greatest("l1", "l2").alias("label_b")).agg(F.count("*").alias("n"))


def network_edges(e: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """node_a, node_b, weight over pairs of entities of a document, both named 'text (label)'. Equal nodes are counted per document first, so repeats in a document cost nothing."""
    nodes = e.select(id_col, F.concat("entity", F.lit(" ("), "label", F.lit(")")).alias("node")).groupBy(id_col, "node").agg(F.count("*").alias("c"))
    a, b = nodes.select(id_col, F.col("node").alias("node_a"), F.col("c").alias("ca")), nodes.select(id_col, F.col("node").alias("node_b"), F.col("c").alias("cb"))
    same = F.col("node_a") == F.col("node_b")
    n = F.when(same, F.expr("ca * (ca - 1) div 2")).otherwise(F.col("ca") * F.col("cb"))
    return a.join(b, id_col).where("node_a <= node_b").select("node_a", "node_b", n.alias("n")).where("n > 0").groupBy("node_a", "node_b").agg(F.sum("n").alias("weight"))


def top_by_label(e: DataFrame, k: int = 10) -> DataFrame:
    counts = e.groupBy("label", "entity").agg(F.count("*").alias("n"))
    order = Window.partitionBy("label").orderBy(F.desc("n"), "entity")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def network_summary(e: DataFrame, *, id_col: str = "doc_id", most: int = 50) -> DataFrame:
    """section, name, value: totals (entities, distinct texts, documents, entities a document), entities by label, and the ``most`` frequent nodes 'text (label)'."""
    totals = e.agg(F.count("*").alias("n"), F.countDistinct("entity").alias("texts"), F.countDistinct(id_col).alias("documents"))
    pairs = (("entities", F.col("n")), ("distinct texts", F.col("texts")), ("documents", F.col("documents")), ("entities a document", F.try_divide("n", "documents")))
    each = F.array(*[F.struct(F.lit("total").alias("section"), F.lit(name).alias("name"), value.cast("double").alias("value")) for name, value in pairs])
    labels = e.groupBy("label").agg(F.count("*").alias("n")).select(F.lit("label").alias("section"), F.col("label").alias("name"), F.col("n").cast("double").alias("value"))
    nodes = e.groupBy(F.concat("entity", F.lit(" ("), "label", F.lit(")")).alias("name")).agg(F.count("*").cast("double").alias("value")).orderBy(F.desc("value"), "name").limit(most)
    return totals.select(F.explode(each).alias("x")).select("x.*").unionByName(labels).unionByName(nodes.select(F.lit("node").alias("section"), "name", "value"))


def by_period(e: DataFrame, periods: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """period, documents (with an entity), entities. periods: id, period; a document without one is of an unknown period."""
    own = e.groupBy(id_col).agg(F.count("*").alias("n")).join(periods.select(id_col, "period"), id_col, "left")
    return own.groupBy(F.coalesce("period", F.lit("Unknown")).alias("period")).agg(F.count("*").alias("documents"), F.sum("n").alias("entities"))
