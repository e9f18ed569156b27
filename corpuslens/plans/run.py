"""The whole analysis: load, clean, features, summaries, entities, timeline, comparison, reports."""

from __future__ import annotations

import argparse
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cleaning, compare, embeddings, entities, features, ml, pos, recognise, report, summaries, timeline
from ..sources import files, sinks
from ..sources.scratch import stored
from . import batches

STEPS = ("summarize", "ner", "timeline", "analysis")
DEFAULTS = {"summary": {"method": "textrank"}, "timeline": {"threshold": 0.7}, "entities": {"gazetteers": None, "statistical": True, "patterns": True}, "features": {"topics": 10, "stop_words": None}}


def listed_entities(spark: SparkSession, clean: DataFrame, config: dict) -> DataFrame:
    """Rule and gazetteer entities, valid ones, overlapping."""
    found = entities.rule_entities(clean, [(p, "DATE") for p in entities.RULE_DATES], 0.8).unionByName(entities.rule_entities(clean, entities.RULE_EVENTS, 0.7)).unionByName(entities.rule_entities(clean, [(entities.TITLED, "PERSON")], 0.9))
    if config["entities"]["gazetteers"]:
        found = found.unionByName(entities.gazetteer_entities(clean, files.gazetteer(spark, config["entities"]["gazetteers"])))
    return entities.valid(found)


def document_steps(spark: SparkSession, config: dict, only: str | None = None) -> dict[str, batches.Step]:
    """The steps that judge each document by itself, in order; a step reads what earlier ones stored."""
    wanted, method = {only} if only else set(STEPS), config["summary"]["method"]

    def summarised(t: dict[str, DataFrame]) -> DataFrame:
        if method == "tfidf":
            return summaries.tfidf_summaries(t["cleaned"])
        return summaries.ranked(t["cleaned"], method).withColumn("n_chosen", F.size("picks")).withColumn("ratio", F.try_divide("n_chosen", "n_sentences"))

    steps: dict[str, batches.Step] = {"cleaned": lambda t: cleaning.cleaned(t["documents"], keep=("year",))}
    if not only:
        steps |= {"basic_stats": lambda t: features.basic_stats(t["cleaned"]), "readability": lambda t: features.readability(t["cleaned"]), "sentiment": lambda t: features.sentiment(t["cleaned"]), "temporal": lambda t: features.temporal(t["cleaned"])}
    if "summarize" in wanted:
        steps["summaries"] = summarised
    if wanted & {"ner", "timeline"}:
        steps["listed"] = lambda t: listed_entities(spark, t["cleaned"], config)
    if "analysis" in wanted:
        steps["judged"] = lambda t: report.judged(t["cleaned"], keep=("year",))
    return steps


def corpus_steps(spark: SparkSession, tables: dict[str, DataFrame], config: dict, only: str | None = None) -> dict[str, DataFrame]:
    """What takes all documents together, from the stored tables of ``document_steps``; entities, events and scores are stored on the way."""
    wanted, out, clean = {only} if only else set(STEPS), {}, tables["cleaned"]
    if not only:
        topics, stops = config["features"]["topics"], config["features"]["stop_words"]
        out |= {"tfidf_top": features.tfidf(clean, max_n=3, stop_words=stops, top=20), "bag_of_words": features.bag_of_words(clean, stop_words=stops)}
        out["document_vectors"] = embeddings.embed(clean, embeddings.fit(clean, stop_words=stops), stop_words=stops)
        out["topics"], out["document_topics"] = ml.lda(clean, topics=topics)
        out["nmf_topics"] = stored(ml.nmf(clean, topics=topics), "topics")
        out["coherence"] = ml.coherence(clean, out["nmf_topics"])
    if wanted & {"ner", "timeline"}:
        found = tables["listed"]
        if config["entities"]["statistical"]:
            known = entities.resolve(found)
            names = [r.label for r in known.select("label").distinct().collect()]  # labels are few
            found = found.unionByName(recognise.recognise(clean, recognise.fit(recognise.labelled(clean, known), names)))
        if config["entities"]["patterns"]:
            found = found.unionByName(pos.proper_noun_entities(pos.tag(clean, pos.fit(clean))))
        out["entities"] = stored(entities.resolve(entities.valid(found)), "entities")
    if "timeline" in wanted:
        out["events"] = stored(timeline.events(clean, out["entities"]), "events")
        out["merged_events"], out["merged_sources"] = timeline.merge(out["events"], threshold=config["timeline"]["threshold"])
    if "analysis" in wanted:
        judged = tables["judged"]
        out["scores"] = stored(compare.with_overall(judged).select("doc_id", "year", *compare.DIMENSIONS, "overall_score"), "scores")
        out["correlations"] = compare.correlations(out["scores"])
        out["evolution"] = compare.evolution(out["scores"])
        out |= {f"report_{n}": f(judged) for n, f in (("executive", report.executive), ("ideology", report.ideology), ("socioeconomic", report.socioeconomic), ("governance", report.governance), ("social_impact", report.social_impact), ("time_period", report.time_period))}
        vectors = compare.scaled(judged)
        made, _ = ml.kmeans(ml.as_vectors(vectors, "doc_id", "features"), id_col="doc_id")
        out["clusters"] = stored(made, "clusters")
        out["report_clusters"] = report.clusters(judged.join(out["clusters"], "doc_id"), "cluster")
        out["report_trend"] = compare.trend(out["evolution"])
    if {"entities", "scores"} <= set(out) and "summaries" in tables:
        out["report_evidence"] = report.evidence(out["scores"], tables["summaries"], out["entities"])
    return out


def analyse(spark: SparkSession, docs: DataFrame, *, config: dict | None = None, only: str | None = None, resume: str | None = None, batch_docs: int = 100_000) -> dict[str, DataFrame]:
    """Named results of documents (doc_id, text, year): all of them, or those of one step.

    Every step's table is stored once and read by those after it. resume: a folder whose finished batches are left out
    and to which others are committed; its quarantine is a result too."""
    config, tables = files.merged_config(DEFAULTS, config or {}), {}
    steps = document_steps(spark, config, only)
    if resume:
        store = batches.process(docs.select("doc_id", "text", "year"), resume, steps, batch_docs=batch_docs)
        tables = {name: store.load(name) for name in steps}
        if store.has("quarantine"):
            tables["quarantine"] = store.load("quarantine")
    else:
        known = {"documents": docs}
        for name, step in steps.items():
            known[name] = tables[name] = stored(step(known), name)
    return {n: df for n, df in tables.items() if n not in ("listed", "judged")} | corpus_steps(spark, tables, config, only)


class StepLog:
    """Steps with their seconds, as they end."""

    def __init__(self):
        self.rows: list[tuple[str, float, bool]] = []

    @contextmanager
    def step(self, name: str):
        began, done = time.perf_counter(), False
        try:
            yield
            done = True
        finally:
            self.rows.append((name, time.perf_counter() - began, done))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "step string, duration double, done boolean")


def write_outputs(spark: SparkSession, results: dict[str, DataFrame], folder: str, log: StepLog) -> dict[str, DataFrame]:
    """Tables first, each as a step of the log; files, charts' data and the report are made from the tables as written."""
    for name, df in results.items():
        with log.step(name):
            sinks.write_tables({name: df}, folder)
    tables = sinks.read_tables(spark, folder, list(results))
    with log.step("files"):
        if "summaries" in tables:
            sinks.write_csv(sinks.summaries_csv(tables["summaries"]), f"{folder}/summaries_csv")
            sinks.write_json(tables["summaries"], f"{folder}/summaries_json")
        if "entities" in tables:
            sinks.write_json(tables["entities"], f"{folder}/entities_json")
            sinks.write_csv(tables["entities"], f"{folder}/entities_csv")
            sinks.write_json(entities.network_summary(tables["entities"]), f"{folder}/entity_network")
            if "cleaned" in tables:
                periods = tables["cleaned"].select("doc_id", T.period(F.col("year")).alias("period"))
                sinks.write_json(entities.by_period(tables["entities"], periods), f"{folder}/entities_by_period")
            sinks.write_report(spark, f"{folder}/entities.txt", sinks.entities_text(entities.top_by_label(tables["entities"])))
        if "events" in tables:
            sinks.write_csv(sinks.timeline_csv(tables["events"]), f"{folder}/timeline_csv")
            sinks.write_json(tables["events"], f"{folder}/timeline_json")
            sinks.write_report(spark, f"{folder}/timeline.html", sinks.timeline_html(tables["events"]))
            for name, df in sinks.chart_data(tables["events"], entities.network_edges(tables["entities"])).items():
                sinks.write_json(df, f"{folder}/charts/{name}")
        if "scores" in tables:
            sinks.write_json(tables["scores"], f"{folder}/analysis_json")
            sinks.write_csv(tables["scores"], f"{folder}/analysis_csv")
    with log.step("report"):
        sections = {n.removeprefix("report_").replace("_", " "): df for n, df in tables.items() if n.startswith("report_") and n != "report_evidence"}
        sections["statistics"], sections["findings"] = report.final_statistics(tables), report.findings(tables)
        for name, df in sections.items():
            sinks.write_json(df, f"{folder}/report_json/{name.replace(' ', '_')}")
        sinks.write_report(spark, f"{folder}/report.txt", sinks.report_text("Corpus report", sections, {"methodology": report.METHODOLOGY, "limitations": report.LIMITATIONS}))
    sinks.write_json(log.frame(spark), f"{folder}/steps")
    sinks.write_json(report.step_performance(log.frame(spark)), f"{folder}/performance")
    return tables


def main(args: list[str] | None = None) -> int:
    own = argparse.ArgumentParser(description=__doc__)
    own.add_argument("--input", required=True)
    own.add_argument("--output", required=True)
    own.add_argument("--config")
    own.add_argument("--only", choices=STEPS)
    own.add_argument("--resume", help="folder of finished batches: they are left out, new ones are added")
    a = own.parse_args(args)
    spark = SparkSession.builder.appName("corpuslens").getOrCreate()
    loaded = files.usable(files.load(files.discover(spark, a.input)))
    if loaded.isEmpty():
        print("no documents found")
        return 1
    docs = loaded.select(F.col("document_id").alias("doc_id"), "text", "year")
    log = StepLog()
    with log.step("metadata"):
        sinks.write_json(loaded.drop("text"), f"{a.output}/metadata")
    write_outputs(spark, analyse(spark, docs, config=files.read_config(a.config, DEFAULTS) if a.config else None, only=a.only, resume=a.resume), a.output, log)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
