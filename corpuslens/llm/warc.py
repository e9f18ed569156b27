"""Seekable Zstandard bundles of WARC records.

Records go into independent Zstandard frames of about ``frame_bytes``; a bundle is some frames and, as a skippable
frame at its end, the seek table of the public seekable format. A record identifier maps to (bundle, frame, offset in
the decompressed frame, length), so one record is read by decompressing one frame. All reading goes through that map, and
a record whose identifier differs from the map's is an error.

Bundles are written by Spark as rows of a Parquet table (one row is one whole .warc.zst file) in the shared folder, so
that the commit protocol decides which attempt of a task counts. ``export`` writes them out as files.

Payloads of at least ``least`` bytes that are equal (length and SHA-1) are stored once, as the response with the
largest page id; the others are revisits of it. Null html is an empty payload; a null id is never referred to; rows
repeated under the largest id are responses each. Record identifiers are unique whatever repeats: a response that others
revisit is named by its page and payload, every other record by the writing run, its task and its place there. Where
several responses share the largest id, revisits name the page and the payload but no record. Control characters in urls
are percent-encoded, a null url is left out. An empty table makes no bundle; extra columns are left out, whatever their
names; texts of any length are written whole, one record at a time. Only per-digest maxima are shuffled beside the one
join; a digest shared by a third of the rows is pre-aggregated, and that join's payload side may be split by adaptive
execution.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, scratch, stored

# Fixed values of the seekable Zstandard format.
SKIPPABLE, SEEKABLE, ENTRY, FOOTER = 0x184D2A5E, 0x8F92EAB1, "<III", "<IBI"
CHECKSUMS = 0x80

_CONTROL = re.compile(r"[\x00-\x20\x7f]")
INDEX = "array<struct<page_id: bigint, record_id: string, frame: int, offset: int, length: int>>"
BUNDLES = f"bundle_id string, data binary, records {INDEX}"


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def response_name(page_id: int, digest: str) -> str:
    """What the identifier of a response that others revisit is made of."""
    return f"page:{page_id}:{digest}"


def record(own_id: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, refers_id: str | None = None) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP head only and names the full payload's length and digest."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {own_id}", f"WARC-Date: {date}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {_CONTROL.sub(lambda m: f'%{ord(m[0]):02X}', url)}")
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {refers_to}", f"X-Payload-Length: {len(payload)}"]
        if refers_id is not None:
            head.append(f"WARC-Refers-To: {refers_id}")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers (lower-case names), block, and where the next record starts."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    start = end + 4
    stop = start + int(headers["content-length"])
    return headers, data[start:stop], stop + 4


class Bundle:
    """Collects records into frames and closes with the seek table."""

    def __init__(self, frame_bytes: int, level: int):
        import zstandard

        self.frame_bytes, self.zip = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.done, self.entries, self.index, self.open = bytearray(), [], [], bytearray()

    def add(self, page_id: int | None, own_id: str, data: bytes) -> None:
        if self.open and len(self.open) + len(data) > self.frame_bytes:
            self.close_frame()
        self.index.append({"page_id": page_id, "record_id": own_id, "frame": len(self.entries), "offset": len(self.open), "length": len(data)})
        self.open += data

    def close_frame(self) -> None:
        import xxhash

        raw = bytes(self.open)
        packed = self.zip.compress(raw)
        self.entries.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.done += packed
        self.open = bytearray()

    def close(self) -> bytes:
        if self.open:
            self.close_frame()
        table = b"".join(struct.pack(ENTRY, *e) for e in self.entries) + struct.pack(FOOTER, len(self.entries), CHECKSUMS, SEEKABLE)
        return bytes(self.done) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(data: bytes) -> list[tuple[int, int, int, int]]:
    """(offset, packed size, size, checksum) of each frame, from the footer alone."""
    n, _, magic = struct.unpack_from(FOOTER, data, len(data) - 9)
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    at, out = 0, []
    for i in range(n):
        packed, size, check = struct.unpack_from(ENTRY, data, len(data) - 9 - 12 * (n - i))
        out.append((at, packed, size, check))
        at += packed
    return out


def read_frame(data: bytes, frame: int, table: list | None = None) -> bytes:
    import xxhash
    import zstandard

    at, packed, size, check = (table or seek_table(data))[frame]
    raw = zstandard.ZstdDecompressor().decompress(data[at : at + packed], max_output_size=size)
    if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
        raise ValueError("a frame doesn't match its seek table entry")
    return raw


def with_revisits(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000) -> DataFrame:
    """page_id, url, html (not null), digest, refers_to, known (others refer to this row, or this row to one row)."""
    base = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"))
    base = base.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    # payloads never enter this shuffle; the largest id comes with the number of rows that have it
    each = base.select("page_id", "digest", F.octet_length("html").alias("n")).where(F.col("n") >= least).groupBy("digest", "n", "page_id").agg(F.count("*").alias("rows"))
    first = each.groupBy("digest", "n").agg(F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "rows"))).alias("top"), F.sum("rows").alias("copies")).where("copies > 1 and top is not null")
    first = first.select("digest", "n", F.col("top.page_id").alias("original"), (F.col("top.rows") == 1).alias("single"))
    found = base.withColumn("n", F.octet_length("html")).join(first, ["digest", "n"], "left")
    return found.select("page_id", "url", "html", "digest", F.when(~F.col("original").eqNullSafe(F.col("page_id")), F.col("original")).alias("refers_to"), F.coalesce("single", F.lit(False)).alias("known"))


def write_bundles(records: DataFrame, *, frame_bytes: int = 1 << 20, bundle_bytes: int = 4 << 20, level: int = 3, date: str = "1970-01-01T00:00:00Z", path: str | None = None) -> DataFrame:
    """Writes the bundles as a table (bundle_id, data, records) and returns it as read back."""
    salt = uuid.uuid4().hex

    def run(batches):
        from pyspark import TaskContext

        bundle, task, place = Bundle(frame_bytes, level), TaskContext.get().partitionId(), 0

        def closed():
            data = bundle.close()
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha1(data).hexdigest()]), pa.array([data], pa.binary()), pa.array([bundle.index], pa.list_(pa.struct([("page_id", pa.int64()), ("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())])))], names=["bundle_id", "data", "records"])

        for batch in lean(batches):
            for i in range(batch.num_rows):
                page_id, url, html, digest, refers_to, known = (batch.column(c)[i].as_py() for c in range(6))
                own = record_id(response_name(page_id, digest) if known and refers_to is None else f"{salt}:{task}:{place}")
                place += 1
                refers_id = record_id(response_name(refers_to, digest)) if known and refers_to is not None else None
                bundle.add(page_id, own, record(own, page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers_to, date, refers_id))
                if len(bundle.done) >= bundle_bytes:
                    yield closed()
                    bundle = Bundle(frame_bytes, level)
        if bundle.index:
            yield closed()

    path = path or scratch(records.sparkSession, "warc")
    records.select("page_id", "url", "html", "digest", "refers_to", "known").mapInArrow(run, BUNDLES).write.option("compression", "uncompressed").parquet(path)
    return records.sparkSession.read.schema(BUNDLES).parquet(path)


FIELDS = [("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("record", pa.binary())]
RECORDS = "record_id string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, record binary"


def _records(batches, with_record: bool):
    """Rows (data, wanted entries of the map) to FIELDS: every frame that holds a wanted record is decompressed once."""
    for batch in lean(batches):
        for i in range(batch.num_rows):
            data, entries = batch.column(0)[i].as_py(), sorted(batch.column(1)[i].as_py(), key=lambda e: (e["frame"], e["offset"]))
            table, frame, rows, raw = seek_table(data), -1, [], b""
            for e in entries:
                if e["frame"] != frame:
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), FIELDS, strict=True)], names=[n for n, _ in FIELDS])
                    frame, rows = e["frame"], []
                    raw = read_frame(data, frame, table)
                own = raw[e["offset"] : e["offset"] + e["length"]]
                h, block, end = parse_record(own)
                if h["warc-record-id"] != e["record_id"] or end != len(own):
                    raise ValueError("a record doesn't match its entry in the map")
                payload = block[block.index(b"\r\n\r\n") + 4 :] if h["warc-type"] == "response" else None
                digest = h["warc-payload-digest"].removeprefix("sha1:")
                if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError("a payload doesn't match its digest")
                number = lambda name, h=h: int(h[name]) if name in h else None
                rows.append((e["record_id"], number("x-page-id"), h.get("warc-target-uri"), number("x-payload-length") if payload is None else len(payload), digest, h["warc-type"], number("x-refers-to-page-id"), payload, own if with_record else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), FIELDS, strict=True)], names=[n for n, _ in FIELDS])


def read_bundles(bundles: DataFrame) -> DataFrame:
    """record_id, page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits) of every record in the map."""
    return bundles.select("data", "records").mapInArrow(lambda batches: _records(batches, False), RECORDS).drop("record")


def lookup(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """RECORDS of the wanted records, named by the column record_id or page_id (all records of the page).

    The map alone, without data, meets what is wanted; then each bundle that holds any is read once, with its entries."""
    key = "record_id" if "record_id" in wanted.columns else "page_id"
    entries = bundles.select("bundle_id", F.explode("records").alias("r"))
    names = wanted.select(F.col(key).alias("_wanted")).distinct()
    found = entries.join(names, F.col(f"r.{key}") == F.col("_wanted"), "left_semi").groupBy("bundle_id").agg(F.collect_list("r").alias("entries"))
    found = stored(found, "places")  # its size is known when the bundles are joined: few entries are broadcast, so that no bundle is shuffled
    return bundles.select("bundle_id", "data").join(found, "bundle_id").select("data", "entries").mapInArrow(lambda batches: _records(batches, True), RECORDS)


def export(bundles: DataFrame, uri: str) -> DataFrame:
    """Writes each bundle as <uri>/<bundle_id>.warc.zst through any file system pyarrow knows (file, hdfs, s3): bundle_id, file, bytes. Names follow contents, so a repeated task writes the same file."""

    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(uri)
        store.create_dir(base, recursive=True)
        for batch in batches:
            names, sizes = [], []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_output_stream(f"{base}/{key}.warc.zst", compression=None) as f:
                    f.write(data)
                names.append(f"{key}.warc.zst")
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["bundle_id", "file", "bytes"])

    return bundles.select("bundle_id", "data").mapInArrow(run, "bundle_id string, file string, bytes long")
