"""Media columns, TIFF: image directories are walked, PackBits, LZW and deflate strips and tiles decoded,
predictors undone, and one row comes out per page. A writer for the same formats stores bytes as samples."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from memloom.llm.shared import fields

# Fixed values of the TIFF 6.0 format.
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 284, 317, 322, 323, 324, 325
LZW_CLEAR, LZW_END = 256, 257

#: The query's form: rows of 64 RGB pixels, 64 rows to a strip.
PIXELS, CHANNELS, STRIP_ROWS = 64, 3, 64
UNIT = PIXELS * CHANNELS


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more equal bytes become (1 - n, byte), other stretches (n - 1, bytes)."""
    out, at, n = bytearray(), 0, len(data)
    lone = bytearray()

    def flush() -> None:
        for k in range(0, len(lone), 128):
            piece = lone[k : k + 128]
            out.append(len(piece) - 1)
            out.extend(piece)
        lone.clear()

    while at < n:
        end = at + 1
        while end < n and end - at < 128 and data[end] == data[at]:
            end += 1
        if end - at >= 3:
            flush()
            out.extend(((257 - (end - at)) & 255, data[at]))
        else:
            lone.extend(data[at:end])
        at = end
    flush()
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    """At most ``size`` bytes; a header byte of 128 does nothing."""
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        head = data[at]
        if head < 128:
            out += data[at + 1 : at + 2 + head]
            at += 2 + head
        else:
            if head > 128:
                out += data[at + 1 : at + 2] * (257 - head)
            at += 1 + (head > 128)
    return bytes(out[:size])


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first; the width grows one code early, as the format has it."""
    bits, held, out = 0, 0, bytearray()
    table: dict[bytes, int] = {}
    width, free = 9, 258

    def put(code: int) -> None:
        nonlocal bits, held
        bits, held = (bits << width) | code, held + width
        while held >= 8:
            held -= 8
            out.append((bits >> held) & 255)
        bits &= (1 << held) - 1

    put(LZW_CLEAR)
    own = b""
    code_of = lambda s: s[0] if len(s) == 1 else table[s]
    for k in range(len(data)):
        more = own + data[k : k + 1]
        if len(more) == 1 or more in table:
            own = more
            continue
        put(code_of(own))
        table[more] = free
        free += 1
        if free == 4094:
            put(LZW_CLEAR)
            table, width, free = {}, 9, 258
        elif free + 1 > 1 << width:
            width += 1
        own = data[k : k + 1]
    if own:
        put(code_of(own))
        free += 1
        if free + 1 > 1 << width and width < 12:
            width += 1
    put(LZW_END)
    if held:
        out.append((bits << (8 - held)) & 255)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    """At most ``size`` bytes; stops at the end code, at a code that can't be, or where the data end."""
    base = [bytes((k,)) for k in range(256)] + [b"", b""]
    table, width, last, out, got = list(base), 9, b"", [], 0
    bits = held = 0
    for byte in data:
        bits, held = ((bits << 8) | byte) & 0xFFFFFF, held + 8
        if held < width:
            continue
        held -= width
        code = (bits >> held) & ((1 << width) - 1)
        if code == LZW_END or got >= size:
            break
        if code == LZW_CLEAR:
            table, width, last = list(base), 9, b""
            continue
        if code < len(table):
            piece = table[code]
        elif last and code == len(table):
            piece = last + last[:1]
        else:
            break
        out.append(piece)
        got += len(piece)
        if last:
            table.append(last + piece[:1])
        last = piece
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)[:size]


ENCODE = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 1), OLD_DEFLATE: lambda b: zlib.compress(b, 1), PACKBITS: packbits_encode}


def _unpack(kind: int, data: bytes, size: int) -> bytes:
    if kind == NONE:
        return data[:size]
    if kind in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    if kind == LZW:
        return lzw_decode(data, size)
    if kind == PACKBITS:
        return packbits_decode(data, size)
    raise ValueError(f"compression {kind} isn't supported")


def encode(images: list[np.ndarray], *, compression: int = DEFLATE, predictor: int = 2, strip_rows: int = STRIP_ROWS, tile: tuple[int, int] | None = None, big_endian: bool = False) -> bytes:
    """A TIFF of one page per (rows, columns, channels) array of 8 or 16 bit samples, in strips or in tiles of
    (rows, columns), which are multiples of 16 and filled up with zeros."""
    order = ">" if big_endian else "<"
    out = bytearray((b"MM\0*" if big_endian else b"II*\0") + b"\0\0\0\0")
    link = 4
    for image in images:
        rows, columns, channels = image.shape
        kind = image.dtype.newbyteorder(order)
        height, width = tile or (max(1, strip_rows), columns)
        pieces = []
        for y in range(0, rows, height):
            for x in range(0, columns, width):
                part = image[y : y + height, x : x + width]
                if tile and part.shape[:2] != tile:
                    part = np.pad(part, ((0, height - part.shape[0]), (0, width - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], 1)
                pieces.append(ENCODE[compression](part.astype(kind, copy=False).tobytes()))
        offsets = []
        for piece in pieces:
            offsets.append(len(out))
            out += piece + b"\0" * (len(piece) % 2)
        counts = [len(p) for p in pieces]
        tags = [(WIDTH, 4, [columns]), (LENGTH, 4, [rows]), (BITS, 3, [image.dtype.itemsize * 8] * channels), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if channels >= 3 else 1])]
        tags += [(SAMPLES, 3, [channels]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        tags += [(TILE_WIDTH, 4, [width]), (TILE_LENGTH, 4, [height]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [height]), (STRIP_COUNTS, 4, counts)]
        body = []
        for tag, form, values in sorted(tags):
            packed = struct.pack(f"{order}{len(values)}{TYPES[form]}", *values)
            if len(packed) > 4:
                at = len(out)
                out += packed + b"\0" * (len(packed) % 2)
                packed = struct.pack(f"{order}I", at)
            body.append(struct.pack(f"{order}HHI", tag, form, len(values)) + packed.ljust(4, b"\0"))
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(body)) + b"".join(body)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple] | struct.error]]:
    """(byte order, tag -> values) of each image directory along the chain, or the error in place of the tags if
    one of them points outside; a chain that comes back to a directory ends there."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None:
        raise ValueError("not a TIFF")
    (at,), seen = struct.unpack_from(f"{order}I", data, 4), set()
    while at and at not in seen:
        seen.add(at)
        (count,) = struct.unpack_from(f"{order}H", data, at)
        tags = {}
        for k in range(count):
            entry = at + 2 + 12 * k
            tag, form, n = struct.unpack_from(f"{order}HHI", data, entry)
            if form not in TYPES:
                continue
            size = struct.calcsize(TYPES[form]) * n
            (place,) = (entry + 8,) if size <= 4 else struct.unpack_from(f"{order}I", data, entry + 8)
            try:
                tags[tag] = struct.unpack_from(f"{order}{n}{TYPES[form]}", data, place)
            except struct.error as e:
                tags = e
                break
        yield order, tags
        (at,) = struct.unpack_from(f"{order}I", data, at + 2 + 12 * count)


def page(data: bytes, order: str, tags: dict[int, tuple] | struct.error) -> np.ndarray:
    """The (rows, columns, channels) samples of one directory."""
    if isinstance(tags, struct.error):
        raise tags
    columns, rows = tags[WIDTH][0], tags[LENGTH][0]
    channels, kind, predictor = tags.get(SAMPLES, (1,))[0], tags.get(COMPRESSION, (NONE,))[0], tags.get(PREDICTOR, (1,))[0]
    bits = set(tags.get(BITS, (1,)))
    if bits not in ({8}, {16}) or tags.get(PLANAR, (1,))[0] != 1 or predictor not in (1, 2):
        raise ValueError(f"bits {sorted(bits)}, planar {tags.get(PLANAR, (1,))[0]} or predictor {predictor} isn't supported")
    sample = np.dtype(f"{order}u{bits.pop() // 8}")
    if not all(isinstance(x, int) and x >= 0 for x in (columns, rows, channels)) or rows * columns * channels * sample.itemsize > MOST_EACH * max(1, len(data)):
        raise ValueError(f"{columns!r} x {rows!r} x {channels!r} samples can't be in {len(data)} bytes")
    tiled = TILE_OFFSETS in tags
    width, height = (tags[TILE_WIDTH][0], tags[TILE_LENGTH][0]) if tiled else (columns, min(rows, tags.get(ROWS_PER_STRIP, (rows,))[0]))
    places, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
    out = np.zeros((rows, columns, channels), sample.newbyteorder("="))
    across = -(-columns // width) if width else 1
    for k, (place, count) in enumerate(zip(places, counts)):
        y, x = k // across * height, k % across * width
        if y >= rows:
            break
        deep = height if tiled else min(height, rows - y)
        if deep * width * channels * sample.itemsize > MOST_EACH * max(1, len(data)):
            raise ValueError("a strip or tile is larger than its file can hold")
        raw = _unpack(kind, data[place : place + count], deep * width * channels * sample.itemsize)
        if len(raw) != deep * width * channels * sample.itemsize:
            raise ValueError("a strip or tile is too short")
        part = np.frombuffer(raw, sample).reshape(deep, width, channels)
        if predictor == 2:
            part = np.add.accumulate(part, axis=1, dtype=out.dtype)
        out[y : y + deep, x : x + width] = part[: rows - y, : columns - x]
    return out


def decode(data: bytes) -> list[np.ndarray]:
    """The pages of a TIFF in the order of their directories."""
    return [page(data, order, tags) for order, tags in directories(data)]


def feature(image: np.ndarray) -> str:
    """Size, channel means, and a 64-bit hash of which of 8 x 8 fields are brighter than the mean."""
    rows, columns, channels = image.shape
    sums = image.reshape(-1, channels).sum(0, dtype=np.int64)
    if min(rows, columns) == 0:
        return f"{columns}x{rows}x{channels}"
    lines = image.sum((1, 2), dtype=np.int64) if columns < 8 else np.add.reduceat(image.sum(2, dtype=np.int64), np.arange(8) * columns // 8, axis=1)
    grid = lines.reshape(rows, -1)
    edges = np.arange(8) * rows // 8
    tops = np.unique(edges)
    fields = np.add.reduceat(grid, tops, axis=0) / np.diff(np.append(tops, rows))[:, None]
    bright = (fields > fields.mean()).ravel()
    return f"{columns}x{rows}x{channels};{','.join(f'{s / (rows * columns):.4f}' for s in sums)};{int(''.join('1' if b else '0' for b in bright) or '0', 2):x}"


#: What a broken or unsupported page raises.
ERRORS = (ValueError, KeyError, IndexError, TypeError, OverflowError, struct.error, zlib.error, MemoryError)
#: Bytes that a compressed byte can stand for at most, in any of the forms; a page whose header asks for more than
#: its file can hold isn't tried.
MOST_EACH = 4_096
PAGES = "page int, width int, height int, channels int, bits int, samples binary, error string"


def pages(df: DataFrame, *, content: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per page of each TIFF in a binary column: ``keep``, page (from 0), width, height, channels,
    bits, samples (row by row, big-endian for 16 bits) and error.

    Null gives no row. A page that can't be decoded gives a row with page and error set and the rest null, and the
    pages after it follow; bytes that are no TIFF, or a chain that breaks, give one row with only error set.
    """
    names = list(keep)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                data = batch.column(content)[at].as_py()
                if data is None:
                    continue
                rows, own = [], batch.slice(at, 1).select(names).to_pylist()[0]
                failed = lambda e, k=None: own | {c: None for c in ("width", "height", "channels", "bits", "samples")} | {"page": k, "error": f"{type(e).__name__}: {e}"}  # noqa: B023, E731
                try:
                    for k, (order, tags) in enumerate(directories(data)):
                        try:
                            image = page(data, order, tags)
                        except ERRORS as e:
                            rows.append(failed(e, k))
                            continue
                        rows.append(own | {"page": k, "width": image.shape[1], "height": image.shape[0], "channels": image.shape[2], "bits": image.dtype.itemsize * 8, "samples": image.astype(image.dtype.newbyteorder(">")).tobytes(), "error": None})
                except ERRORS as e:
                    rows.append(failed(e))
                schema = pa.schema([batch.schema.field(c) for c in names] + [("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("bits", pa.int32()), ("samples", pa.binary()), ("error", pa.string())])
                yield pa.RecordBatch.from_pylist(rows, schema)

    return df.select(*dict.fromkeys([*names, content])).mapInArrow(walk, T.StructType([*(df.schema[c] for c in names), *fields(PAGES)]))


def stored(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Every text as the samples of a one-page TIFF (UTF-8, then bytes 32 up to a positive multiple of 192;
    null is empty), read back from the stored bytes; the query's digest columns."""
    schema = T.StructType([docs.schema["doc_id"], *fields("n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(text):
                raw = (value.as_py() or "").encode()
                payload = raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" ")
                media = encode([np.frombuffer(payload, np.uint8).reshape(-1, PIXELS, CHANNELS)])
                (image,) = decode(media)
                back = image.tobytes()
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(image)))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], [f.name for f in schema])

    return docs.select("doc_id", text).mapInArrow(store, schema)
