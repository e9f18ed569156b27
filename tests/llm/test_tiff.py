import hashlib
import random
import struct
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslens.llm import tiff as T
from corpuslens.llm.queries import op2_tiff_pages


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_codecs_round_trip(data):
    assert T.unpack_bits(T.pack_bits(data), len(data)) == data
    assert T.unpack_lzw(T.pack_lzw(data), len(data)) == data


def test_lzw_over_full_tables():
    random.seed(1)
    data = bytes(random.randrange(40) for _ in range(60_000))
    assert T.unpack_lzw(T.pack_lzw(data), len(data)) == data


def test_known_bytes():
    assert T.unpack_bits(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA"), 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    # clear, 7, 258, 8, 8, 258, 6, 6, end: the specification's example of LZW
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    assert T.unpack_lzw(T._bits(np.array(codes), np.full(9, 9)), 10) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_pages_strips_tiles_predictors():
    rng = np.random.default_rng(0)
    pages = [rng.integers(0, 50, (17, 64), dtype=np.uint8), rng.integers(0, 256, (5, 33), dtype=np.uint8)]
    for compression in (T.NONE, T.LZW, T.DEFLATE, T.PACKBITS):
        for predictor in (1, 2):
            for layout in ({}, {"rows_per_strip": 3}, {"tile": 16}):
                got = T.read_tiff(T.write_tiff(pages, compression=compression, predictor=predictor, **layout))
                assert [(p["page"], p["error"]) for p in got] == [(0, None), (1, None)]
                assert all((p["samples"][:, :, 0] == page).all() for p, page in zip(got, pages, strict=True))


def _big_endian(page: np.ndarray, data: bytes, predictor: int, kind: int) -> bytes:
    tags = [(256, page.shape[1]), (257, page.shape[0]), (258, page.dtype.itemsize * 8), (259, 8), (273, 8), (277, 1), (278, page.shape[0]), (279, len(data)), (317, predictor), (339, kind)]
    return b"MM\0*" + struct.pack(">I", 8 + len(data)) + data + struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHII", t, 4, 1, v) for t, v in tags) + b"\0\0\0\0"


def test_wide_samples_and_float_predictor():
    page = np.arange(40, dtype=">u2").reshape(4, 10) * 1000
    data = zlib.compress(np.diff(page, axis=1, prepend=np.uint16(0)).astype(">u2").tobytes())
    assert (T.read_tiff(_big_endian(page, data, 2, 1))[0]["samples"][:, :, 0] == page).all()
    floats = np.linspace(-3, 9, 24).astype(">f4").reshape(3, 8)
    planes = floats.view(np.uint8).reshape(3, 8, 4).transpose(0, 2, 1).reshape(3, 32)
    data = zlib.compress(np.diff(planes, axis=1, prepend=np.uint8(0)).tobytes())
    assert (T.read_tiff(_big_endian(floats, data, 3, 3))[0]["samples"][:, :, 0] == floats).all()


def test_query_round_trip(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    out = op2_tiff_pages(spark, small).collect()
    assert len(out) == len(texts)
    for r in out:
        raw = texts[r.doc_id].encode()
        padded = raw + b"\0" * (-len(raw) % 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "", 7), (4, "é" * 100_000, 7), (None, "x", 7)], "doc_id long, text string, feature int")
    out = {r.doc_id: r for r in T.text_media(df).collect()}
    assert out[1].payload_bytes == 64 and out[1].n_bytes == 0 and out[1].media_sha256 == out[2].media_sha256 == out[3].media_sha256
    assert out[4].n_bytes == 200_000 and out[None].n_bytes == 1
    assert T.text_media(df.limit(0)).count() == 0
    files = spark.createDataFrame([(1, None, 0), (2, b"", 0), (3, b"junk", 0), (4, bytearray(T.write_tiff([np.zeros((2, 2), np.uint8)] * 3)), 0), (5, bytearray(T.write_tiff([np.zeros((9, 9), np.uint8)])[:40]), 0)], "id long, content binary, page int")
    rows = T.tiff_pages(files, "content", "id").collect()
    assert T.tiff_pages(files.limit(0), "content", "id").count() == 0
    assert sorted((r.id, r.page, r.error is None) for r in rows) == [(3, 0, False), (4, 0, True), (4, 1, True), (4, 2, True), (5, 0, False)]


def test_long_texts_have_several_pages(spark):
    df = spark.createDataFrame([(1, "ab" * 100_000), (1, "ab" * 100_000), (2, "x")], "doc_id long, text string")
    files = T.text_files(df)
    pages = T.tiff_pages(files, "media", "doc_id", "n_bytes").collect()
    assert sorted((r.doc_id, r.page, r.height, r.n_bytes) for r in pages) == sorted([(1, i, 1024 if i < 3 else 3125 - 3 * 1024, 200_000) for i in range(4)] * 2 + [(2, 0, 1, 1)])
    out = T.text_media(df).collect()
    assert sorted((r.doc_id, r.payload_sha256) for r in out) == sorted([(1, hashlib.sha256(b"ab" * 100_000).hexdigest())] * 2 + [(2, hashlib.sha256(b"x" + b"\0" * 63).hexdigest())])


def _file(tags: list[tuple[int, int, int]], data: bytes = b"") -> bytes:
    return b"II*\0" + struct.pack("<I", 8 + len(data)) + data + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, n, v) for t, n, v in tags) + b"\0\0\0\0"


def test_few_bits(spark):
    rng = np.random.default_rng(3)
    for bits in (1, 2, 4):
        page = rng.integers(0, 1 << bits, (5, 13), dtype=np.uint8)
        single = (page[:, :, None] >> np.arange(bits - 1, -1, -1) & 1).astype(np.uint8).reshape(5, -1)
        raw = np.packbits(single, axis=1).tobytes()
        tags = [(256, 1, 13), (257, 1, 5), (258, 1, bits), (259, 1, 8), (273, 1, 8), (278, 1, 5), (279, 1, 0)]
        for fill in (1, 2):
            data = zlib.compress(raw)
            data = bytes(int(f"{b:08b}"[::-1], 2) for b in data) if fill == 2 else data
            own = [*tags[:-1], (279, 1, len(data)), (266, 1, fill)]
            (got,) = T.read_tiff(_file(sorted(own), data))
            assert got["error"] is None and (got["samples"][:, :, 0] == page).all()


def test_what_a_file_says_is_checked():
    base = {256: (1, 4), 257: (1, 4), 258: (1, 8), 259: (1, 1), 273: (1, 8), 278: (1, 4), 279: (1, 16)}
    good = _file([(t, *v) for t, v in base.items()], bytes(16))
    assert T.read_tiff(good)[0]["error"] is None
    broken = [{339: (1, 3)}, {278: (1, 0)}, {256: (2**32 - 1, 8)}, {256: (1, 2**31), 257: (1, 2**31)}, {277: (1, 0)}, {258: (1, 7)}, {258: (1, 1), 317: (1, 2)}, {322: (1, 0), 323: (1, 0), 324: (1, 8), 325: (1, 16)}, {322: (1, 65535), 323: (1, 65535), 324: (1, 8), 325: (1, 16)}, {273: (1, 2**32 - 1)}, {259: (1, 99)}, {284: (1, 3)}, {339: (1, 9)}, {278: (1, 2)}]
    for change in broken:
        rows = T.read_tiff(_file(sorted((t, *v) for t, v in (base | change).items()), bytes(16)))
        assert rows[-1]["error"] and rows[-1]["samples"] is None, change
    two = bytearray(T.write_tiff([np.zeros((4, 4), np.uint8)] * 2, compression=T.NONE))
    first = struct.unpack_from("<I", two, 4)[0]
    two[first + 2 + 12 * 2 + 8] = 7  # the first page's bits
    assert [r["error"] is None for r in T.read_tiff(bytes(two))] == [False, True]


def test_mutated_files_never_raise():
    import random
    import time

    rng, noise = random.Random(7), np.random.default_rng(7)
    pages = [noise.integers(0, 9, (40, 33), dtype=np.uint8), noise.integers(0, 256, (7, 64), dtype=np.uint8)]
    files = [T.write_tiff(pages, compression=c, predictor=q, **layout) for c in (T.NONE, T.LZW, T.DEFLATE, T.PACKBITS) for q in (1, 2) for layout in ({}, {"rows_per_strip": 3}, {"tile": 16})]
    began, errors = time.process_time(), 0
    for i in range(6000):
        data = bytearray(files[i % len(files)])
        heads = [struct.unpack_from("<I", data, 4)[0], len(data) - 200]
        for _ in range(rng.randrange(1, 6)):
            at = rng.choice([rng.randrange(len(data)), min(len(data) - 1, rng.choice(heads) + rng.randrange(180)), rng.randrange(8)])
            data[at] = rng.choice([0, 1, 255, rng.randrange(256)])
        if rng.random() < 0.2:
            del data[rng.randrange(len(data)) :]
        rows = T.read_tiff(bytes(data), max_page=1 << 22)
        errors += any(r["error"] for r in rows)
        assert all((r["samples"] is None) == (r["error"] is not None) for r in rows)
    assert errors > 1000 and time.process_time() - began < 120
