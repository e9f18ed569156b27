"""Sinks: JSON, CSV, Parquet, text and HTML. Large results are written by Spark; reports of a few rows are rendered by the driver."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import remove, write_text

CSV = {"header": True, "multiLine": True, "escape": '"', "quoteAll": True}


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Nested columns become JSON text."""
    flat = [F.to_json(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name) for f in df.schema]
    df.select(*flat).write.mode(mode).options(**CSV).csv(path)


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Named results as Parquet, nothing cut off, to be read again by later steps."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_tables(spark, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def summaries_csv(summaries: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The CSV's columns; its summary column holds at most 500 characters by definition."""
    cut = F.when(F.length("summary") > 500, F.concat(F.substring("summary", 1, 500), F.lit("..."))).otherwise(F.col("summary"))
    return summaries.select(F.col(id_col).alias("document_id"), cut.alias("summary"), F.col("n_chosen").alias("sentence_count"), F.col("ratio").alias("compression_ratio"), F.size(F.split(F.trim("summary"), r"\s+")).alias("word_count"))


def timeline_csv(events: DataFrame) -> DataFrame:
    """The CSV's columns, with at most five entities an event by definition."""
    names = F.array_join(F.slice(F.transform("entities", lambda x: x["entity"]), 1, 5), "; ")
    return events.select("event_id", F.coalesce(F.col("date").cast("string"), "date_str").alias("date"), "year", "decade", "century", "description", F.size("entities").alias("entity_count"), names.alias("entities"), "confidence", "precision")


def html_page(title: str, rows: list[dict]) -> str:
    """A small table as a page; for top-k results."""
    names = list(rows[0]) if rows else []
    cell = lambda tag, x: f"<{tag}>{html.escape(str(x))}</{tag}>"
    head = "<tr>" + "".join(cell("th", n) for n in names) + "</tr>"
    body = "".join("<tr>" + "".join(cell("td", "" if r[n] is None else r[n]) for n in names) + "</tr>" for r in rows)
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table>{head}{body}</table>"


def timeline_html(events: DataFrame, most: int = 500) -> str:
    """The first events as a page."""
    top = events.orderBy(F.col("date").asc_nulls_last(), "event_id").limit(most)
    return html_page("Timeline", [r.asDict() for r in timeline_csv(top).collect()])


def report_text(title: str, sections: dict[str, DataFrame], notes: dict[str, tuple[str, ...]] | None = None) -> str:
    """Sections of a few rows each as plain text, then notes."""
    lines = [title, "=" * len(title)]
    for name, df in sections.items():
        lines += ["", name, "-" * len(name)]
        lines += ["  ".join(f"{k}: {v:.2f}" if isinstance(v, float) else f"{k}: {v}" for k, v in r.asDict().items()) for r in df.collect()]
    for name, texts in (notes or {}).items():
        lines += ["", name, "-" * len(name), *[f"- {t}" for t in texts]]
    return "\n".join(lines) + "\n"


def entities_text(top: DataFrame) -> str:
    """The most frequent entities of each label (label, entity, n, rank) as plain text."""
    lines: list[str] = []
    for r in top.orderBy("label", "rank").collect():
        if not lines or r["rank"] == 1:
            lines += ["", r["label"], "-" * len(r["label"])]
        lines.append(f"{r['rank']:>3}  {r['entity']}  ({r['n']})")
    return "\n".join(lines[1:]) + "\n"


def write_report(spark, path: str, text: str) -> None:
    """A small text file in any store that Spark reaches; an older one is replaced."""
    remove(spark, path)
    write_text(spark, path, text)


def chart_data(events: DataFrame, edges: DataFrame, most: int = 50) -> dict[str, DataFrame]:
    """The datasets behind the charts: counts by year and by decade, heaviest edges and sizes of their nodes."""
    top = edges.orderBy(F.desc("weight"), "node_a", "node_b").limit(most)
    nodes = top.select(F.col("node_a").alias("node"), "weight").union(top.select("node_b", "weight")).groupBy("node").agg(F.sum("weight").alias("size"))
    known = events.where("year != 0")
    return {"years": known.groupBy("year").agg(F.count("*").alias("n")), "decades": known.groupBy("decade").agg(F.count("*").alias("n")), "edges": top, "nodes": nodes}
