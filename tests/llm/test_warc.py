import hashlib
import os

from corpuslens.llm import warc as W


def test_bundle_layout():
    b = W.Bundle(frame_bytes=2000, level=3)
    payloads = {i: os.urandom(700) for i in range(10)}
    for i, p in payloads.items():
        b.add(i, W.record_id(str(i)), W.record(W.record_id(str(i)), i, "http://x/\r\ny", p, hashlib.sha1(p).hexdigest(), None, "1970-01-01T00:00:00Z"))
    data = b.close()
    table = W.seek_table(data)
    assert len(table) > 3 and sum(t[1] for t in table) < len(data)
    for entry in b.index:
        raw = W.read_frame(data, entry["frame"], table)[entry["offset"] : entry["offset"] + entry["length"]]
        headers, block, _ = W.parse_record(raw)
        assert headers["x-page-id"] == str(entry["page_id"]) and headers["warc-record-id"] == entry["record_id"]
        assert block.endswith(payloads[entry["page_id"]]) and headers["warc-target-uri"] == "http://x/%0D%0Ay"
    import zstandard

    assert b"".join(zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read1(1 << 20) for _ in range(1)).startswith(b"WARC/1.1")


def test_round_trip_and_revisits(spark, tmp_path):
    big, other = "b" * 1000, "é" * 500
    rows = [(1, "u1", big), (2, "u2", big), (9, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", other), (None, "u", other), (9, "again", big), (7, "u", "z" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    bundles = W.write_bundles(W.with_revisits(pages), frame_bytes=1500)
    out = {}
    for r in W.read_bundles(bundles).collect():
        out.setdefault(r.page_id, []).append(r)
    assert sum(map(len, out.values())) == len(rows)
    for i in (1, 2):
        assert (out[i][0].record_type, out[i][0].refers_to, out[i][0].payload_bytes, out[i][0].payload) == ("revisit", 9, 1000, None)
        assert out[i][0].payload_digest == hashlib.sha1(big.encode()).hexdigest()
    assert [r.record_type for r in out[9]] == ["response", "response"]
    assert out[3][0].record_type == out[4][0].record_type == "response" and bytes(out[3][0].payload) == b"small"
    assert out[5][0].payload_bytes == 0 and out[6][0].record_type == "response" and out[None][0].refers_to == 6
    assert out[7][0].payload_bytes == 3_000_000
    wanted = spark.createDataFrame([(2,), (3,), (77,)], "page_id long")
    found = {r.page_id: bytes(r.record) for r in W.lookup(bundles, wanted).collect()}
    assert set(found) == {2, 3} and b"WARC-Type: revisit" in found[2] and found[3].endswith(b"small\r\n\r\n")
    ids = [x.record_id for r in out.values() for x in r]
    assert len(set(ids)) == len(rows)
    for r in W.lookup(bundles, spark.createDataFrame([(ids[0],), (ids[-1],), ("none",)], "record_id string")).collect():
        own = next(x for v in out.values() for x in v if x.record_id == r.record_id)
        assert (r.page_id, r.payload_digest, r.payload) == (own.page_id, own.payload_digest, own.payload)
    heads = {r.page_id: bytes(r.record) for r in W.lookup(bundles, spark.createDataFrame([(1,), (6,)], "page_id long")).collect()}
    # page 9 has two responses with this payload, so revisits name no record of it
    assert b"WARC-Refers-To" not in heads[1] and out[6][0].record_id in ids
    null = W.lookup(bundles, spark.createDataFrame([(out[None][0].record_id,)], "record_id string")).first()
    assert f"WARC-Refers-To: {out[6][0].record_id}".encode() in bytes(null.record)
    files = W.export(bundles, f"file://{tmp_path}/out").collect()
    assert {f.file for f in files} == set(os.listdir(tmp_path / "out")) and all(os.path.getsize(tmp_path / "out" / f.file) == f.bytes for f in files)


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert W.read_bundles(W.write_bundles(W.with_revisits(pages))).count() == 0


def test_lookup_moves_no_other_bundle(spark):
    pages = spark.range(400).selectExpr("id AS page_id", "CAST(NULL AS STRING) AS url", "repeat(CAST(id AS STRING), 3000) AS html").repartition(4)
    bundles = W.write_bundles(W.with_revisits(pages), frame_bytes=4000, bundle_bytes=2000)
    assert bundles.count() > 20
    found = W.lookup(bundles, spark.createDataFrame([(5,), (250,)], "page_id long"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert {r.page_id: r.payload_bytes for r in found.collect()} == {5: 3000, 250: 9000}
