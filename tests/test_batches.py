"""Batches that resume, quarantine, and a run that does each step once."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslens.operators import cleaning
from corpuslens.plans import batches, run

SCHEMA = "doc_id long, text string"


class Killed(BaseException):
    pass


def steps(seen):
    def upper(t):
        def f(rows):
            for b in rows:
                texts = b.column(1).to_pylist()
                seen.add(len(texts))
                if any(x and "poison" in x for x in texts):
                    raise ValueError("bad text")
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x and x.upper() for x in texts], pa.string())], names=["doc_id", "text"])

        return t["documents"].select("doc_id", "text").mapInArrow(f, SCHEMA)

    return {"upper": upper, "length": lambda t: t["upper"].select("doc_id", F.length("text").alias("n"))}


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_resumes_after_a_kill(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], SCHEMA).repartition(3)
    whole = batches.process(docs, f"file://{tmp_path}/whole", steps(spark.sparkContext.accumulator(0)), batch_docs=9)
    count, committed = spark.sparkContext.accumulator(0), []

    def stop(number):
        committed.append(number)
        if len(committed) == 2:
            raise Killed

    with pytest.raises(Killed):
        batches.process(docs, f"file://{tmp_path}/b", steps(count), batch_docs=9, after=stop)
    store = batches.Store(spark, f"file://{tmp_path}/b")
    before = store.finished().count()
    assert 0 < before < 40 and len(store.commits()) == 2 and count.value == before
    # what a killed run leaves without a commit is not read
    spark.range(3).write.parquet(f"file://{tmp_path}/b/data/upper/orphan")
    store = batches.process(docs, f"file://{tmp_path}/b", steps(count), batch_docs=9)
    assert count.value == 40  # no document twice
    for table in ("upper", "length"):
        assert rows_of(store.load(table)) == rows_of(whole.load(table))
    done = len(store.commits())
    batches.process(docs, f"file://{tmp_path}/b", steps(count), batch_docs=9)
    assert count.value == 40 and len(store.commits()) == done


def test_poisoned_rows_end_in_quarantine(spark, tmp_path):
    docs = spark.createDataFrame([(i, "poison" if i in (7, 23) else f"text {i}") for i in range(30)] + [(7, "poison")], SCHEMA)
    store = batches.process(docs, f"file://{tmp_path}/b", steps(spark.sparkContext.accumulator(0)))
    held = store.load("quarantine").collect()
    assert sorted(r.doc_id for r in held) == [7, 23] and all("bad text" in r.error for r in held)
    assert {r.doc_id for r in store.load("length").collect()} == set(range(30)) - {7, 23}
    assert batches.process(docs, f"file://{tmp_path}/b", steps(spark.sparkContext.accumulator(0))).load("quarantine").count() == 2
    # mended, it is done again
    mended = docs.withColumn("text", F.replace("text", F.lit("poison"), F.lit("cure")))
    store = batches.process(mended, f"file://{tmp_path}/b", steps(spark.sparkContext.accumulator(0)))
    assert store.load("quarantine").count() == 0 and {r.doc_id: r.text for r in store.load("upper").collect()}[23] == "CURE"


def test_changed_documents_replace_their_rows(spark, tmp_path):
    first = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n"), (3, None)], SCHEMA)
    batches.process(first, f"file://{tmp_path}/b", steps(spark.sparkContext.accumulator(0)))
    second = spark.createDataFrame([(1, "aa"), (4, "d")], SCHEMA)
    store = batches.process(second, f"file://{tmp_path}/b", steps(spark.sparkContext.accumulator(0)))
    assert rows_of(store.load("upper")) == sorted([(1, "AA"), (2, "B"), (None, "N"), (3, None), (4, "D")], key=str)


def test_nothing_to_do(spark, tmp_path):
    store = batches.process(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/b", steps(spark.sparkContext.accumulator(0)))
    assert store.commits() == [] and not store.has("upper")
    with pytest.raises(FileNotFoundError):
        store.load("upper")
    with pytest.raises(ValueError):
        batches.process(spark.createDataFrame([], SCHEMA + ", _key string"), f"file://{tmp_path}/b", {})


def history(spark, n=8):
    texts = [f"In {1700 + i} the Treaty of Paris ended the war. King Louis Quinze spoke of freedom and the crown. Workers asked for reform number {i}. The empire sent its navy. Nothing more was said." for i in range(n)]
    return spark.createDataFrame([(i, t, 1700 + i) for i, t in enumerate(texts)], "doc_id long, text string, year int")


def test_every_document_is_cleaned_once(spark, tmp_path, monkeypatch):
    count, original = spark.sparkContext.accumulator(0), cleaning.cleaned

    def counted(docs, **how):
        def f(rows):
            for b in rows:
                count.add(b.num_rows)
                yield b

        return original(docs.mapInArrow(f, docs.schema), **how)

    monkeypatch.setattr(cleaning, "cleaned", counted)
    log = run.StepLog()
    tables = run.write_outputs(spark, run.analyse(spark, history(spark)), f"file://{tmp_path}/out", log)
    assert count.value == 8
    assert {"tfidf_top", "bag_of_words", "document_vectors", "topics", "document_topics", "coherence", "entities", "report_evidence"} <= set(tables)
    assert "statistical" in {r.source for r in tables["entities"].select("source").collect()}
    assert {r.section for r in spark.read.json(f"file://{tmp_path}/out/report_json/findings").collect()} >= {"entities by label", "events by century", "most common ideology"}


def test_run_resumes(spark, tmp_path):
    folder = f"file://{tmp_path}/resume"
    first = run.analyse(spark, history(spark, 5), only="summarize", resume=folder, batch_docs=3)
    assert first["summaries"].count() == 5
    count = len(batches.Store(spark, folder).commits())
    again = run.analyse(spark, history(spark, 8), only="summarize", resume=folder, batch_docs=3)
    assert again["summaries"].count() == 8 and len(batches.Store(spark, folder).commits()) > count
    assert rows_of(again["summaries"].select("doc_id", "summary")) == rows_of(run.analyse(spark, history(spark, 8), only="summarize")["summaries"].select("doc_id", "summary"))
