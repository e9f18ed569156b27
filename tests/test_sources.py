import json
import zipfile

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import sql
from corpuslens.plans import run
from corpuslens.sources import files, sinks
from corpuslens.streaming import documents as S

LONG = "The Treaty of Paris was signed in 1783 and ended the war. " * 4


def folder(path):
    (path / "bar-1980.txt").write_text("By John Smith.\n" + LONG)
    (path / "latin.txt").write_bytes(("é " + LONG).encode("latin-1"))
    (path / "short.txt").write_text("too short")
    (path / "page.html").write_text(f"<html><head><style>x</style></head><body><nav>menu</nav><p>First &amp; only</p><script>y</script><p> {LONG} </p></body></html>")
    (path / "broken.pdf").write_bytes(b"%PDF")
    (path / "other.doc").write_text("ignored")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    with zipfile.ZipFile(path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hello there</w:t></w:r></w:p><w:p/><w:tbl><w:tr>{cell("a")}{cell("b")}</w:tr></w:tbl></w:body></w:document>')


def test_load(spark, tmp_path):
    folder(tmp_path)
    rows = {r.filename: r for r in files.load(files.discover(spark, str(tmp_path))).collect()}
    assert set(rows) == {"bar-1980.txt", "latin.txt", "short.txt", "page.html", "broken.pdf", "d.docx"}
    notes = rows["bar-1980.txt"]
    assert (notes.year, notes.period, notes.author, notes.source_type) == (1980, "Cold War", "John Smith", "Treaty")
    assert rows["latin.txt"].text.startswith("é ") and rows["latin.txt"].year == 1783 and len(notes.document_id) == 12
    assert rows["short.txt"].error and rows["broken.pdf"].error and rows["short.txt"].text is None
    assert rows["page.html"].text.splitlines()[0] == "First & only" and "menu" not in rows["page.html"].text
    assert rows["d.docx"].text == "Hello there\na | b"
    assert files.usable(files.load(files.discover(spark, str(tmp_path)))).count() == 4


def test_gazetteer(spark, tmp_path):
    (tmp_path / "movements.txt").write_text("# comment\nChartism\n\n")
    (tmp_path / "cities.txt").write_text("Rome\nRome\n")
    (tmp_path / "own.txt").write_text("Thing\n")
    got = sorted(tuple(r) for r in files.gazetteer(spark, str(tmp_path)).collect())
    assert got == [("Chartism", "historical_events"), ("Chartism", "historical_organizations"), ("Rome", "historical_locations"), ("Thing", "own")]


def test_config_merges_deeply(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"a": {"x": 1}}))
    assert files.read_config(str(tmp_path / "c.json"), {"a": {"x": 0, "y": 2}, "b": 3}) == {"a": {"x": 1, "y": 2}, "b": 3}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'line\n"two"', ["a", "b"])], "doc_id long, summary string, tags array<string>")
    sinks.write_csv(df, f"{tmp_path}/csv")
    assert spark.read.options(**sinks.CSV).csv(f"{tmp_path}/csv").first().summary == 'line\n"two"'
    sinks.write_json(df, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").first().tags == ["a", "b"]
    sinks.write_tables({"t": df}, str(tmp_path))
    assert sinks.read_tables(spark, str(tmp_path), ["t"])["t"].collect() == df.collect()
    assert "<td>&lt;b&gt;</td>" in sinks.html_page("t", [{"a": "<b>"}])
    assert "n: 1.50" in sinks.report_text("R", {"s": spark.createDataFrame([(1.5,)], "n double")})


def test_full_run(spark, tmp_path):
    (tmp_path / "in").mkdir()
    folder(tmp_path / "in")
    out = run.analyse(spark, files.usable(files.load(files.discover(spark, str(tmp_path / "in")))).select(F.col("document_id").alias("doc_id"), "text", "year"))
    assert out["summaries"].count() == 4 and out["events"].where("year = 1783").count() >= 3 and out["scores"].count() == 4
    assert out["merged_events"].count() < out["events"].count()
    sinks.summaries_csv(summaries_of(out)).collect()
    page = sinks.timeline_html(out["events"])
    assert "1783-06-15" in page
    charts = sinks.chart_data(out["events"], spark.createDataFrame([("a", "b", 3), ("a", "c", 1)], "node_a string, node_b string, weight long"))
    assert {r.node: r["size"] for r in charts["nodes"].collect()} == {"a": 4, "b": 3, "c": 1}
    assert set(run.analyse(spark, out["cleaned"].limit(1), only="timeline")) == {"cleaned", "entities", "events", "merged_events", "merged_sources"}


def summaries_of(out):
    from corpuslens.operators import summaries as Z

    return Z.tfidf_summaries(out["cleaned"])


def test_command_line_without_documents(spark, tmp_path):
    (tmp_path / "x.txt").write_text("short")
    assert run.main(["--input", str(tmp_path), "--output", f"{tmp_path}/out"]) == 1


def test_sql_functions(spark):
    sql.register(spark)
    assert spark.sql("SELECT period_of(1650) AS p, nfkc('ﬁ') AS n, text_words('A b-C') AS w").first() == ("Early Modern", "fi", ["a", "b", "c"])
    assert [r.entity for r in spark.sql("SELECT * FROM date_spans('in August 1945 or 1960s')").collect()] == ["August 1945", "1945", "1960s"]


def test_streaming(spark, tmp_path, small):
    spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").repartition(3).write.parquet(f"{tmp_path}/in")
    q = S.write_batches(S.document_stream(spark, f"{tmp_path}/in", max_files=1), S.scored, f"{tmp_path}/out", f"{tmp_path}/state")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 200
    events = spark.read.parquet(f"{small}/events.parquet")
    events.write.parquet(f"{tmp_path}/events")
    stream = S.windowed_counts(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events"))
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(n) FROM counts").first()[0] == events.count()
    assert S.sessions(events).agg(F.sum("n")).first()[0] == events.count()


@pytest.mark.parametrize("gone", [("corpuslens/llm", "tests/llm"), ("corpuslens/llm", "tests/llm", "corpus_pipeline.py")])
def test_engine_works_without_the_llm_package(tmp_path, gone):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        (shutil.rmtree if os.path.isdir(tmp_path / "repo" / name) else os.remove)(tmp_path / "repo" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(n.startswith('op') for n in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env=os.environ | {"PYTHONPATH": ""})


def test_shared_folder(spark, tmp_path):
    from corpuslens.sources import scratch

    path = f"file://{tmp_path}/notes/1.json"
    scratch.write_text(spark, path, '{"é": 1}')
    assert scratch.read_text(spark, path) == '{"é": 1}' and scratch.names_in(spark, f"file://{tmp_path}/notes") == ["1.json"]
    with pytest.raises(FileExistsError):
        scratch.write_text(spark, path, "again")
    assert scratch.names_in(spark, f"file://{tmp_path}/none") == []

    class Cluster:
        sparkContext = type("Context", (), {"master": "spark://host:7077"})
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})

    with pytest.raises(RuntimeError):
        scratch.shared_dir(Cluster)


def test_outputs_of_a_run(spark, tmp_path):
    texts = [f"In {1700 + i} the Treaty of Paris ended the war. King Louis Quinze spoke of freedom and the crown. Workers asked for reform number {i}. The empire sent its navy. Nothing more was said." for i in range(8)]
    docs = spark.createDataFrame([(i, t, 1700 + i) for i, t in enumerate(texts)], "doc_id long, text string, year int")
    log = run.StepLog()
    tables = run.write_outputs(spark, run.analyse(spark, docs), f"file://{tmp_path}/out", log)
    assert {"summaries", "entities", "merged_events", "report_clusters", "report_evidence", "report_trend"} <= set(tables)
    report = (tmp_path / "out" / "report.txt").read_text()
    assert "documents: 8" in report and "methodology" in report and "limitations" in report and "ideology" in report
    assert "Treaty of Paris" in (tmp_path / "out" / "entities.txt").read_text() and "1700" in (tmp_path / "out" / "timeline.html").read_text()
    steps = spark.read.json(f"file://{tmp_path}/out/steps").collect()
    assert {r.step for r in steps} >= {"cleaned", "files", "report", "merged_events"} and all(r.done and r.duration > 0 for r in steps)
    with pytest.raises(ZeroDivisionError), log.step("broken"):
        1 / 0
    assert log.rows[-1][0] == "broken" and not log.rows[-1][2]
