"""TIFF columns: a writer and a reader that walks image directories, one row per page.

The reader takes classic TIFF in either byte order: strips or tiles, no compression, PackBits, LZW or deflate,
predictors none, horizontal differencing and floating point, chunky or planar samples of 1, 2, 4, 8, 16, 32 or 64 bits
(those of fewer than 8 come out as one byte each), both fill orders.

A null or empty file gives no page. A broken page gives one row with ``error`` set and null samples, and the walk goes on;
a broken directory ends it with such a row. Never an exception: what a file says of itself is checked against its length
(directories and their values may not add up to more than the file, sizes to no more than ``MAX_PAGE`` bytes or than its
compression could hold) before anything is made of that size. Repeated rows give repeated pages. Every row is decoded on
its own: no shuffle, nothing is gathered; pages leave the task one by one, so one page must fit in its memory. Extra
columns ride along where they are asked for; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_columns, lean

# Fixed values of the TIFF 6.0 format.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT, FILL_ORDER = 322, 323, 324, 325, 339, 266
KNOWN_TAGS = {WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT, FILL_ORDER}
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d"}
CLEAR, END, FIRST_CODE, MAX_BITS = 256, 257, 258, 12

MAX_PAGE = 1 << 28  # bytes of samples
MOST_PER_BYTE = 1 << 13  # no compression makes more of a byte
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def pack_bits(data: bytes) -> bytes:
    """PackBits: runs of 3 and more are repeated, all else is literal."""
    a = np.frombuffer(data, np.uint8)
    cuts = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)]]).astype(np.int64) if len(a) else np.zeros(1, np.int64)
    sizes = np.diff(cuts)
    out, at = bytearray(), 0
    for start, size in zip(cuts[:-1][sizes >= 3].tolist(), sizes[sizes >= 3].tolist(), strict=True):
        _literal(out, data, at, start)
        at = start + size
        for left in range(size, 0, -128):
            n = min(left, 128)
            out += bytes((257 - n if n > 1 else 0, data[start]))
    _literal(out, data, at, len(data))
    return bytes(out)


def _literal(out: bytearray, data: bytes, start: int, end: int) -> None:
    for i in range(start, end, 128):
        part = data[i : min(i + 128, end)]
        out.append(len(part) - 1)
        out += part


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    """TIFF's LZW: most significant bit first, code lengths grow one code early."""
    codes, widths = [CLEAR], [9]
    table, width, prefix = {}, 9, -1
    free = FIRST_CODE
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        key = prefix << 8 | byte
        code = table.get(key)
        if code is not None:
            prefix = code
            continue
        codes.append(prefix)
        widths.append(width)
        table[key] = free
        free += 1
        prefix = byte
        if free == (1 << width) - 0 and width < MAX_BITS:
            width += 1
        elif free == (1 << MAX_BITS) - 2:
            codes.append(CLEAR)
            widths.append(width)
            table, width, free = {}, 9, FIRST_CODE
    if prefix >= 0:
        codes.append(prefix)
        widths.append(width)
        if free + 1 == 1 << width and width < MAX_BITS:
            width += 1
    codes.append(END)
    widths.append(width)
    return _bits(np.array(codes, np.int64), np.array(widths, np.int64))


def _bits(codes: np.ndarray, widths: np.ndarray) -> bytes:
    shifts = np.arange(MAX_BITS - 1, -1, -1)
    bits = (codes[:, None] >> shifts & 1).astype(np.uint8)
    return np.packbits(bits[shifts[None, :] < widths[:, None]]).tobytes()


def unpack_lzw(data: bytes, size: int) -> bytes:
    singles = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, out, got = list(singles), [], 0
    width, hold, held, last = 9, 0, 0, None
    for byte in data:
        hold = (hold << 8 | byte) & 0xFFFFFF
        held += 8
        if held < width:
            continue
        held -= width
        code = hold >> held & (1 << width) - 1
        if code == CLEAR:
            table, width, last = list(singles), 9, None
            continue
        if code == END:
            break
        if last is None:
            entry = table[code]
        else:
            if code < len(table):
                entry = table[code]
                fresh = last + entry[:1]
            elif code == len(table):
                entry = fresh = last + last[:1]
            else:
                raise ValueError("LZW code out of range")
            if len(table) < 1 << MAX_BITS:
                table.append(fresh)
            if len(table) + 1 == 1 << width and width < MAX_BITS:
                width += 1
        out.append(entry)
        got += len(entry)
        last = entry
        if got >= size:
            break
    return b"".join(out)


def _decompress(data: bytes, how: int, size: int) -> bytes:
    if how == NONE:
        return data
    if how == PACKBITS:
        return unpack_bits(data, size)
    if how == LZW:
        return unpack_lzw(data, size)
    if how in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    raise ValueError(f"compression {how}")


def _compress(data: bytes, how: int) -> bytes:
    return {NONE: bytes, PACKBITS: pack_bits, LZW: pack_lzw, DEFLATE: lambda d: zlib.compress(d, 1)}[how](data)


def _undo_predictor(block: np.ndarray, predictor: int, order: str) -> np.ndarray:
    """block: rows x columns x samples."""
    if predictor == 1:
        return block
    if predictor == 2:
        whole = block.view(block.dtype.str.replace("f", "u"))
        return np.cumsum(whole, axis=1, dtype=whole.dtype).astype(whole.dtype, copy=False).view(block.dtype)
    if predictor == 3 and block.dtype.kind == "f":
        rows, size = block.shape[0], block.dtype.itemsize
        planes = np.cumsum(np.ascontiguousarray(block).view(np.uint8).reshape(rows, -1, block.shape[2]), axis=1, dtype=np.uint8)
        planes = planes.reshape(rows, size, -1).transpose(0, 2, 1)
        return np.ascontiguousarray(planes).view(f">f{size}").reshape(block.shape).astype(block.dtype)
    raise ValueError(f"predictor {predictor}")


def write_tiff(pages: list[np.ndarray], *, compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int = 0, tile: int = 0) -> bytes:
    """8-bit grey pages to a little-endian file. rows_per_strip 0: one strip; tile: tiles of tile x tile (a multiple of 16)."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        height, width = page.shape
        if tile:
            padded = np.zeros((-(-height // tile) * tile, -(-width // tile) * tile), np.uint8)
            padded[:height, :width] = page
            blocks = [padded[y : y + tile, x : x + tile] for y in range(0, padded.shape[0], tile) for x in range(0, padded.shape[1], tile)]
        else:
            step = rows_per_strip or height
            blocks = [page[y : y + step] for y in range(0, height, step)]
        offsets, counts = [], []
        for block in blocks:
            if predictor == 2:
                block = np.diff(block, axis=1, prepend=np.uint8(0))
            data = _compress(np.ascontiguousarray(block, np.uint8).tobytes(), compression)
            offsets.append(len(out))
            counts.append(len(data))
            out += data
            out += b"\0" * (len(out) & 1)
        tags = {WIDTH: [width], HEIGHT: [height], BITS: [8], COMPRESSION: [compression], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [predictor], SAMPLE_FORMAT: [1]}
        tags |= {TILE_WIDTH: [tile], TILE_HEIGHT: [tile], TILE_OFFSETS: offsets, TILE_COUNTS: counts} if tile else {STRIP_OFFSETS: offsets, ROWS_PER_STRIP: [rows_per_strip or height], STRIP_COUNTS: counts}
        fields = []
        for tag, values in sorted(tags.items()):
            data = struct.pack(f"<{len(values)}I", *values)
            if len(data) > 4:
                at, data = len(out), out.extend(data) or struct.pack("<I", len(out) - len(data))
                assert at == struct.unpack("<I", data)[0]
            fields.append(struct.pack("<HHI", tag, 4, len(values)) + data)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + b"".join(fields)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _directories(data: bytes):
    """Each image directory as tag -> values, in file order; a loop of links ends the walk."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(f"{order}I", data, 4)[0], set()
    walked = valued = 0
    while at and at not in seen:
        seen.add(at)
        n, tags = struct.unpack_from(f"{order}H", data, at)[0], {}
        walked += 6 + 12 * n
        if walked > len(data):
            raise ValueError("directories overlap or go beyond the file")
        for i in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * i)
            if tag not in KNOWN_TAGS or tag in tags or kind not in TYPES or not count:
                continue
            size = struct.calcsize(order + TYPES[kind]) * count
            place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(f"{order}I", data, at + 10 + 12 * i)[0]
            valued += size
            if place + size > len(data) or valued > 4 * len(data):
                raise ValueError(f"values of tag {tag} go beyond the file")
            tags[tag] = struct.unpack_from(f"{order}{count * len(TYPES[kind])}{TYPES[kind][0]}", data, place)
        yield order, tags
        at = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)[0]


def _whole(tags: dict, tag: int, default: int) -> int:
    value = tags.get(tag, (default,))[0]
    if not isinstance(value, int):
        raise ValueError(f"tag {tag} is no number")
    return value


def read_page(data: bytes, order: str, tags: dict, max_page: int = MAX_PAGE) -> np.ndarray:
    """One directory's samples, rows x columns x samples."""
    width, height, samples = (_whole(tags, t, d) for t, d in ((WIDTH, 0), (HEIGHT, 0), (SAMPLES, 1)))
    how, predictor, planar = (_whole(tags, t, 1) for t in (COMPRESSION, PREDICTOR, PLANAR))
    bits, form = _whole(tags, BITS, 1), _whole(tags, SAMPLE_FORMAT, 1)
    if min(width, height, samples) <= 0 or len(set(tags.get(BITS, (bits,)))) > 1 or len(set(tags.get(SAMPLE_FORMAT, (form,)))) > 1:
        raise ValueError(f"{width} x {height} x {samples} samples of {tags.get(BITS)} bits")
    kind = {1: "u", 2: "i", 3: "f", 4: "u"}.get(form)
    if kind is None or bits not in ((16, 32, 64) if kind == "f" else (8, 16, 32, 64) if kind == "i" else (1, 2, 4, 8, 16, 32, 64)):
        raise ValueError(f"samples of {bits} bits in format {form}")
    if bits < 8 and predictor != 1:
        raise ValueError(f"predictor {predictor} on {bits} bits")
    dtype = np.dtype(f"{order if bits > 8 else '|'}{kind}{max(bits, 8) // 8}")
    tiled = TILE_OFFSETS in tags
    block_w, block_h = (_whole(tags, TILE_WIDTH, 0), _whole(tags, TILE_HEIGHT, 0)) if tiled else (width, min(_whole(tags, ROWS_PER_STRIP, height), height))
    if min(block_w, block_h) <= 0 or planar not in (1, 2):
        raise ValueError(f"blocks of {block_w} x {block_h}, planar {planar}")
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
    planes, per_block = (samples, 1) if planar == 2 else (1, samples)
    across, down = -(-width // block_w), -(-height // block_h)
    whole, one = width * height * samples * dtype.itemsize, block_w * block_h * per_block * dtype.itemsize
    if max(whole, one) > min(max_page, MOST_PER_BYTE * len(data)):
        raise ValueError(f"a page of {whole} bytes, blocks of {one}, in a file of {len(data)}")
    n = planes * across * down
    if min(len(offsets), len(counts)) < n:
        raise ValueError("strips or tiles are missing")
    page = np.zeros((height, width, samples), dtype)
    row = -(-block_w * per_block * bits // 8)  # rows begin at whole bytes
    for i in range(n):
        plane, place = divmod(i, across * down)
        y, x = place // across * block_h, place % across * block_w
        rows = block_h if tiled else min(block_h, height - y)
        raw = data[offsets[i] : offsets[i] + counts[i]]
        raw = _decompress(raw.translate(_REVERSED) if _whole(tags, FILL_ORDER, 1) == 2 else raw, how, rows * row)
        if len(raw) < rows * row:
            raise ValueError("a strip or tile is too short")
        block = _unpacked(raw[: rows * row], rows, block_w * per_block, bits) if bits < 8 else np.frombuffer(raw[: rows * row], dtype)
        part = _undo_predictor(block.reshape(rows, block_w, per_block), predictor, order)[: height - y, : width - x]
        target = page[y : y + part.shape[0], x : x + part.shape[1]]
        if planes == 1:
            target[:] = part
        else:
            target[:, :, plane] = part[:, :, 0]
    return page


def _unpacked(raw: bytes, rows: int, n: int, bits: int) -> np.ndarray:
    """n samples of 1, 2 or 4 bits a row as bytes."""
    single = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, -1), axis=1)[:, : n * bits].reshape(rows, n, bits)
    return (single << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(2, dtype=np.uint8)


def read_pages(data: bytes | None, max_page: int = MAX_PAGE):
    """A row per page, one after another: page, width, height, channels, samples (array), error."""
    if not data:
        return
    at, walk = 0, _directories(data)
    while True:
        row = {"page": at, "width": None, "height": None, "channels": None, "samples": None, "error": None}
        going = False
        try:
            found = next(walk, None)
            if found is None:
                return
            going = True  # whatever is wrong with this page, the next directory may be sound
            page = read_page(data, *found, max_page)
            row |= {"height": page.shape[0], "width": page.shape[1], "channels": page.shape[2], "samples": page}
        except Exception as e:  # noqa: BLE001  whatever a file holds, its row says so
            row["error"] = f"{type(e).__name__}: {e}"
        yield row
        if not going:
            return
        at += 1


def read_tiff(data: bytes | None, max_page: int = MAX_PAGE) -> list[dict]:
    return list(read_pages(data, max_page))


def tiff_pages(df: DataFrame, content: str, *keep: str, max_page: int = MAX_PAGE) -> DataFrame:
    """The kept columns, page, width, height, channels, samples (binary, as stored after decoding), error: one row per page, pages of a file one after another."""
    kinds = [df.schema[k].dataType.simpleString() for k in keep]
    names = [*keep, "page", "width", "height", "channels", "samples", "error"]
    own = (("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("samples", pa.binary()), ("error", pa.string()))

    def run(batches):
        for batch in lean(batches):
            at, rows, size = [], [], 0

            def made(at, rows):
                place = pa.array(at, pa.int64())
                return pa.RecordBatch.from_arrays([*[batch.column(1 + k).take(place) for k in range(len(keep))], *[pa.array([r[n] for r in rows], t) for n, t in own]], names=names)

            for i in range(batch.num_rows):
                for page in read_pages(batch.column(0)[i].as_py(), max_page):
                    if page["samples"] is not None:
                        page["samples"] = page["samples"].tobytes()
                        size += len(page["samples"])
                    at.append(i)
                    rows.append(page)
                    if size >= PAGES_BYTES:
                        yield made(at, rows)
                        at, rows, size = [], [], 0
            yield made(at, rows)

    schema = ", ".join([*[f"`{k}` {t}" for k, t in zip(keep, kinds, strict=True)], "page int, width int, height int, channels int, samples binary, error string"])
    return doc_columns(df, content, *keep).mapInArrow(run, schema)


PAGES_BYTES = 8 << 20  # of samples that leave the task at once

# How payloads are stored: the payload's own digest picks one, so that equal texts are stored alike.
LAYOUTS = ({"compression": DEFLATE, "predictor": 2, "rows_per_strip": 256}, {"compression": PACKBITS, "rows_per_strip": 64}, {"compression": DEFLATE, "predictor": 1, "tile": 64}, {"compression": LZW, "rows_per_strip": 128})


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (-len(raw) % 64 if raw else 64), len(raw)


PAGE_ROWS = 1024


def store(payload: bytes) -> bytes:
    """The payload as grey pages of PAGE_ROWS rows (the last of fewer), 64 samples wide."""
    layout = LAYOUTS[hashlib.sha256(payload).digest()[0] % len(LAYOUTS)]
    grey = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    return write_tiff([grey[i : i + PAGE_ROWS] for i in range(0, len(grey), PAGE_ROWS)], **layout)


def feature(page: np.ndarray) -> str:
    """Size, mean, deviation and an 8 x 8 average hash of a page."""
    grey = page.reshape(page.shape[0], -1).astype(np.float64)
    rows, cols = (np.linspace(0, n, 9).astype(int) for n in grey.shape)
    sums = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    sums[1:, 1:] = grey.cumsum(0).cumsum(1)
    cell = sums[rows[1:]][:, cols[1:]] - sums[rows[:-1]][:, cols[1:]] - sums[rows[1:]][:, cols[:-1]] + sums[rows[:-1]][:, cols[:-1]]
    area = np.maximum(np.outer(np.diff(rows), np.diff(cols)), 1)
    bits = (cell / area > grey.mean()).ravel()
    return f"{page.shape[1]}x{page.shape[0]} mean={grey.mean():.4f} std={grey.std():.4f} ahash={int(''.join('1' if b else '0' for b in bits), 2):016x}"


def text_files(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, media (every text as a TIFF file), n_bytes, media_bytes, media_sha256; narrow."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in lean(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                payload, n = payload_of(text)
                media = store(payload)
                rows.append((media, n, len(media), hashlib.sha256(media).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)]], names=[id_col, "media", "n_bytes", "media_bytes", "media_sha256"])

    return doc_columns(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, media binary, n_bytes long, media_bytes long, media_sha256 string")


def text_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text as a TIFF file, reads its pages back and describes what was read; narrow. The pages of a file follow one another, so they are put together as they stream by."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        held: list[np.ndarray] = []
        last = None

        def described(key, n, size, digest, pages):
            grey = np.concatenate(pages)
            back = grey.tobytes()
            values = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), size, digest, feature(grey))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            return [key, *[pa.array([v], k) for v, k in zip(values, kinds, strict=True)]]

        for batch in lean(batches):
            done = []
            n, size, digest, page, width, height, samples, error = (batch.column(c).to_pylist() for c in range(1, 9))
            for i in range(batch.num_rows):
                if error[i]:
                    raise ValueError(error[i])
                if page[i] == 0:
                    if held:
                        done.append(described(*last, held))
                    held, last = [], (batch.column(0).slice(i, 1), n[i], size[i], digest[i])
                held.append(np.frombuffer(samples[i], np.uint8).reshape(height[i], width[i], 1))
            if done:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([d[c] for d in done]) for c in range(len(names))], names=names)
        if held:
            yield pa.RecordBatch.from_arrays(described(*last, held), names=names)

    pages = tiff_pages(text_files(docs, id_col=id_col, text_col=text_col), "media", id_col, "n_bytes", "media_bytes", "media_sha256")
    pages = pages.select(F.col(f"`{id_col}`"), "n_bytes", "media_bytes", "media_sha256", "page", "width", "height", "samples", "error")
    return pages.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
