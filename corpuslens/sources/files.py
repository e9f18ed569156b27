"""File sources: documents (txt, html, docx, pdf), gazetteers, configuration.

Files are read by Spark (binaryFile), so any store Spark reaches will do. Parsing runs row by row on executors. A file
that can't be read gives a row with ``error`` set; nothing is raised.
"""

from __future__ import annotations

import io
import json
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T

EXTENSIONS = ("pdf", "txt", "docx", "html", "htm")
ENCODINGS = ("utf-8", "latin-1", "iso-8859-1", "cp1252")
SKIPPED = {"script", "style", "header", "footer", "nav"}
WORDML = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """path, modificationTime, length, content of the folder's own documents, by case-sensitive extension."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{','.join(EXTENSIONS)}}}").load(folder)


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in SKIPPED

    def handle_endtag(self, tag):
        if tag in SKIPPED and self.skip:
            self.skip -= 1

    def handle_data(self, data):
        if not self.skip and data.strip():
            self.parts.append(data.strip())


def html_text(content: bytes) -> str:
    """Text outside of scripts, styles, headers, footers and navigation, a piece a line; UTF-8 only."""
    parser = _Text()
    parser.feed(content.decode("utf-8"))
    parser.close()
    return "\n".join(line.strip() for part in parser.parts for line in part.splitlines() if line.strip())


def docx_text(content: bytes) -> str:
    """Non-blank paragraphs, then table rows with cells joined by a bar."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{WORDML}body")
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{WORDML}t"))
    lines = [t for p in body.findall(f"{WORDML}p") if (t := text(p).strip())]
    for row in body.iter(f"{WORDML}tr"):
        cells = [text(c).strip() for c in row.findall(f"{WORDML}tc")]
        if any(cells):
            lines.append(" | ".join(cells))
    return "\n".join(lines)


def pdf_text(content: bytes) -> str:
    """Page texts under page marks, by an optional library."""
    try:
        import fitz
    except ImportError as e:
        raise RuntimeError("no PDF library is installed") from e
    pages = fitz.open(stream=content, filetype="pdf")
    return "\n".join(f"--- Page {i + 1} ---\n{t}" for i, p in enumerate(pages) if (t := p.get_text()).strip())


def is_valid(text: str) -> bool:
    return len(text.strip()) >= 100 and sum(c.isprintable() or c.isspace() for c in text) > 0.9 * len(text)


def plain_text(content: bytes) -> str:
    """The first encoding whose result looks like text."""
    for encoding in ENCODINGS:
        try:
            text = content.decode(encoding)
        except UnicodeDecodeError:
            continue
        if is_valid(text):
            return text
    raise ValueError("not valid text")


def parsed(name: str, content: bytes) -> str:
    extension = name.rpartition(".")[2].lower()
    reader = {"txt": plain_text, "html": html_text, "htm": html_text, "docx": docx_text, "pdf": pdf_text}.get(extension)
    if reader is None:
        raise ValueError(f"no reader for .{extension}")
    return reader(content)


def load(files: DataFrame) -> DataFrame:
    """path, text, error and document metadata of every discovered file."""

    def run(batches):
        for batch in batches:
            texts, errors = [], []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    texts.append(parsed(path, content))
                    errors.append(None)
                except Exception as e:  # whatever a broken file makes its parser raise
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string()), batch.column(2), batch.column(3), batch.column(4)], names=["path", "text", "error", "file_hash", "file_size", "modified"])

    rows = files.select("path", "content", F.md5("content").alias("file_hash"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"))
    return metadata(rows.mapInArrow(run, "path string, text string, error string, file_hash string, file_size long, modified timestamp"))


def metadata(rows: DataFrame) -> DataFrame:
    """Adds what is inferred from name and text: id, year, period, type, title, author, counts."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    year = F.coalesce(T.first_year(stem), T.first_year(F.col("text")))
    named = F.initcap(F.regexp_replace(stem, "[_-]", " "))
    lines = F.filter(F.transform(F.slice(F.split("text", "\n"), 1, 5), lambda x: F.trim(x)), lambda x: (F.length(x) < 100) & x.rlike(r"^[^\p{Ll}]*\p{Lu}\p{Ll}*(?:[^\p{L}]+\p{Lu}\p{Ll}*)*[^\p{L}.!?]*$") & (F.size(F.split(x, r"\s+")) <= 10) & ~x.startswith("--- Page"))
    first = F.substring("text", 1, 2000)
    author = F.coalesce(*[F.nullif(F.trim(F.regexp_extract(first, p, 1)), F.lit("")) for p in (r"\b[Bb]y\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)", r"Author:\s*([^\n]+)", r"Written by\s*([^\n]+)")])
    return rows.select(
        F.substring(F.md5(F.concat_ws("_", F.col("path"), F.col("file_size").cast("string"), F.col("file_hash"))), 1, 12).alias("document_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), "*",
        year.alias("year"), T.period(year).alias("period"), T.source_type(F.col("text")).alias("source_type"), F.coalesce(F.get(lines, 0), named).alias("title"), author.alias("author"),
        F.size(F.regexp_extract_all("text", F.lit(T.NOT_SPACE + "+"), F.lit(0))).alias("word_count"), F.length("text").alias("character_count"), F.lit("en").alias("language"),
    )


def usable(loaded: DataFrame) -> DataFrame:
    return loaded.where("text is not null and text != ''")


def gazetteer(spark: SparkSession, folder: str) -> DataFrame:
    """term, category of all lists in a folder: one term a line, # starts a comment; files outside the fixed lists are categories of their own."""
    rows = spark.read.text(folder, pathGlobFilter="*.txt").select(F.trim("value").alias("term"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"))
    rows = rows.where("term != '' and not startswith(term, '#')")
    pairs = [(f, c) for c, files in L.GAZETTEER_FILES.items() for f in files]
    categories = F.filter(F.array(*[F.struct(F.lit(f).alias("f"), F.lit(c).alias("c")) for f, c in pairs]), lambda x: x["f"] == F.col("file"))
    names = F.when(F.size(categories) > 0, F.transform(categories, lambda x: x["c"])).otherwise(F.array(F.regexp_replace("file", r"\.txt$", "")))
    return rows.select("term", F.explode(names).alias("category")).distinct()


def merged_config(defaults: dict, own: dict) -> dict:
    """Deep merge: naming one key of a section keeps its siblings."""
    out = dict(defaults)
    for key, value in own.items():
        out[key] = merged_config(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def read_config(path: str, defaults: dict) -> dict:
    with open(path, encoding="utf-8") as f:
        return merged_config(defaults, json.load(f))

