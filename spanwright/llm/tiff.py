"""TIFF media columns: a writer and a reader of baseline files, and one row per page in Spark.

The reader walks the chain of image directories in either byte order and decodes strips and tiles
that are stored plain, by PackBits, by LZW (most significant bit first, early code change) or by
deflate, undoes the horizontal predictor, and takes 8-bit samples, interleaved or in planes. Other
sample depths and predictors give an error row.

Defined results: null media give no pages; a broken page gives one row with its number, its error and
no pixels, and ends its file; an empty table gives no rows; repeated rows are decoded each; other
columns are carried, but for those named as the result's.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, released

#: Tags, types' sizes and compression codes of the TIFF 6.0 format (fixed values).
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = (
    256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325)
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
PLAIN, LZW, DEFLATE, DEFLATE_OLD, PACKBITS = 1, 5, 8, 32946, 32773
NAMES = {PLAIN: "plain", LZW: "lzw", DEFLATE: "deflate", DEFLATE_OLD: "deflate", PACKBITS: "packbits"}

#: Bytes that a stored byte stands for, at most: a 12-bit LZW code for a word of 3,838.
MOST_UNPACKED = 2560

PAGES = "page int, width int, height int, samples int, compression string, tiled boolean, predictor int, pixels binary, error string"


def packbits_encode(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(upto: int) -> None:
        nonlocal at
        while at < upto:
            n = min(128, upto - at)
            out.append(n - 1)
            out.extend(data[at : at + n])
            at += n

    for run in re.finditer(rb"(.)\1{2,}", data, re.S):
        literal(run.start())
        left = run.end() - run.start()
        while left:
            n = min(128, left)
            out.extend((257 - n, run[1][0])) if n > 1 else out.extend((0, run[1][0]))
            left -= n
        at = run.end()
    literal(len(data))
    return bytes(out)


def packbits_decode(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += 2 + n
        else:
            if n > 128:
                out.append(data[at + 1 : at + 2] * (257 - n))
                at += 1
            at += 1
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, acc, have, bits = bytearray(), 256, 9, 9  # begins with the clear code
    table: dict[int, int] = {}
    free, word = 258, -1
    for byte in data:
        if word < 0:
            word = byte
            continue
        key = word << 8 | byte
        known = table.get(key)
        if known is not None:
            word = known
            continue
        acc = acc << bits | word
        have += bits
        table[key] = free
        free += 1
        if free + 1 > 1 << bits and bits < 12:
            bits += 1
        elif free == 4094:
            acc = acc << bits | 256
            have += bits
            table, free, bits = {}, 258, 9
        word = byte
        if have > 512:
            keep = have & 7
            out += (acc >> keep).to_bytes(have >> 3, "big")
            acc &= (1 << keep) - 1
            have = keep
    if word >= 0:
        acc = acc << bits | word
        have += bits
        free += 1
        if free + 1 > 1 << bits and bits < 12:
            bits += 1
    acc = acc << bits | 257
    have += bits
    pad = -have & 7
    return bytes(out + (acc << pad).to_bytes((have + pad) >> 3, "big"))


def lzw_decode(data: bytes) -> bytes:
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, out, bits, acc, have, last = list(base), [], 9, 0, 0, None
    for byte in data:
        acc = (acc << 8 | byte) & 0xFFFFFF
        have += 8
        if have < bits:
            continue
        have -= bits
        code = acc >> have & (1 << bits) - 1
        if code == 256:
            table, bits, last = list(base), 9, None
            continue
        if code == 257:
            break
        if last is None:
            word = table[code]
        else:
            if code < len(table):
                word = table[code]
            elif code == len(table):
                word = last + last[:1]
            else:
                raise ValueError("LZW code out of range")
            table.append(last + word[:1])
            if len(table) + 1 >= 1 << bits and bits < 12:
                bits += 1
        out.append(word)
        last = word
    return b"".join(out)


def inflate(kind: int, data: bytes, size: int) -> bytes:
    """The `size` bytes that are stored as data (more may come where a row of runs is cut)."""
    if kind == PLAIN:
        return data
    if kind in (DEFLATE, DEFLATE_OLD):
        return zlib.decompressobj().decompress(data, size)
    if kind == PACKBITS:
        return packbits_decode(data)
    if kind == LZW:
        return lzw_decode(data)
    raise ValueError(f"compression {kind} is not supported")


def deflate(kind: int, data: bytes) -> bytes:
    return {PLAIN: bytes, DEFLATE: lambda x: zlib.compress(x, 3), PACKBITS: packbits_encode, LZW: lzw_encode}[kind](data)


def write(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows: int = 64, tile: int = 0, big_endian: bool = False) -> bytes:
    """A file of (height, width[, samples]) uint8 pages, in strips of `rows` rows or square tiles."""
    e = ">" if big_endian else "<"
    out = bytearray(struct.pack(e + "2sHI", b"MM" if big_endian else b"II", 42, 0))
    link = 4
    for page in pages:
        image = page.reshape(page.shape[0], page.shape[1], -1)
        height, width, samples = image.shape
        parts = []
        if tile:
            tall, wide = -height % tile, -width % tile
            padded = np.pad(image, ((0, tall), (0, wide), (0, 0)), mode="edge")
            parts = [padded[y : y + tile, x : x + tile] for y in range(0, height, tile) for x in range(0, width, tile)]
        else:
            parts = [image[y : y + rows] for y in range(0, height, rows)]
        offsets, counts = [], []
        for part in parts:
            if predictor == 2:
                part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
            stored = deflate(compression, np.ascontiguousarray(part).tobytes())
            offsets.append(len(out))
            counts.append(len(stored))
            out += stored + b"\0" * (len(stored) & 1)
        fields = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if samples == 3 else 1]), (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        fields += [(TILE_WIDTH, 4, [tile]), (TILE_HEIGHT, 4, [tile]), (TILE_OFFSETS, 4, offsets), (TILE_BYTES, 4, counts)] if tile else [(STRIP_OFFSETS, 4, offsets), (STRIP_ROWS, 4, [rows]), (STRIP_BYTES, 4, counts)]
        entries = b""
        for tag, kind, values in sorted(fields):
            body = struct.pack(f"{e}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(body) > 4:
                where = len(out)
                out += body + b"\0" * (len(body) & 1)
                body = struct.pack(e + "I", where)
            entries += struct.pack(e + "HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
        struct.pack_into(e + "I", out, link, len(out))
        out += struct.pack(e + "H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def directories(data: bytes) -> Iterator[dict[int, tuple]]:
    """The tags of each image directory, in the order of the chain."""
    if data[:2] not in (b"II", b"MM"):
        raise ValueError("not a TIFF file")
    e = "<" if data[:2] == b"II" else ">"
    magic, at = struct.unpack_from(e + "HI", data, 2)
    if magic != 42:
        raise ValueError("not a classic TIFF file")
    seen = set()
    while at:
        if at in seen:
            raise ValueError("its directories form a loop")
        seen.add(at)
        (n,) = struct.unpack_from(e + "H", data, at)
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(e + "HHI", data, at + 2 + 12 * i)
            if kind not in (1, 3, 4):
                continue
            where = at + 10 + 12 * i
            if SIZES[kind] * count > 4:
                (where,) = struct.unpack_from(e + "I", data, where)
            tags[tag] = struct.unpack_from(f"{e}{count}{ {1: 'B', 3: 'H', 4: 'I'}[kind] }", data, where)
        yield tags
        (at,) = struct.unpack_from(e + "I", data, at + 2 + 12 * n)


def decode(data: bytes, tags: dict[int, tuple]) -> np.ndarray:
    """The (height, width, samples) pixels of one directory."""
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    if not width or not height or set(tags.get(BITS, (1,))) != {8}:
        raise ValueError("only 8-bit samples are supported")
    kind, predictor, planes = one(COMPRESSION, PLAIN), one(PREDICTOR, 1), samples if one(PLANAR, 1) == 2 else 1
    if predictor not in (1, 2):
        raise ValueError(f"predictor {predictor} is not supported")
    deep = 1 if planes > 1 else samples
    tiled = TILE_OFFSETS in tags
    wide = one(TILE_WIDTH) if tiled else width
    tall = one(TILE_HEIGHT) if tiled else min(one(STRIP_ROWS, height), height)
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_BYTES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_BYTES])
    if not wide or not tall:
        raise ValueError("tiles without sides")
    # No stored byte stands for more: sides beyond that are damage, and would ask for any amount of memory.
    if max(height * width * samples, tall * wide * deep) > MOST_UNPACKED * (min(sum(counts), len(data)) + 1):
        raise ValueError("sides are larger than what is stored")
    out = np.empty((height, width, samples), np.uint8)
    k = 0
    for plane in range(planes):
        for y in range(0, height, tall):
            for x in range(0, width, wide):
                rows = tall if tiled else min(tall, height - y)
                raw = inflate(kind, data[offsets[k] : offsets[k] + counts[k]], rows * wide * deep)
                part = np.frombuffer(raw, np.uint8, rows * wide * deep).reshape(rows, wide, deep)
                if predictor == 2:
                    part = np.cumsum(part, axis=1, dtype=np.uint8)
                h, w = min(rows, height - y), min(wide, width - x)
                if planes > 1:
                    out[y : y + h, x : x + w, plane] = part[:h, :w, 0]
                else:
                    out[y : y + h, x : x + w] = part[:h, :w]
                k += 1
    return out


def read(data: bytes) -> Iterator[tuple]:
    """(page, width, height, samples, compression, tiled, predictor, pixels, error) of each page."""
    page = 0
    try:
        for tags in directories(data):
            image = decode(data, tags)
            yield page, image.shape[1], image.shape[0], image.shape[2], NAMES[tags.get(COMPRESSION, (1,))[0]], TILE_OFFSETS in tags, tags.get(PREDICTOR, (1,))[0], image.tobytes(), None
            page += 1
    except (ValueError, KeyError, IndexError, TypeError, OverflowError, MemoryError, struct.error, zlib.error) as error:
        yield page, None, None, None, None, None, None, None, str(error)[:200] or type(error).__name__


def tiff_pages(df: DataFrame, media: str = "media") -> DataFrame:
    """One row per page of the files in `media`, beside the other columns of df (those named as PAGES are replaced)."""
    own_names = [c.split()[0] for c in PAGES.split(", ")]
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in own_names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(media)[i].as_py()
                found = [] if data is None else list(read(data))
                if found:
                    own = batch.slice(i, 1).take(pa.array([0] * len(found)))
                    yield pa.RecordBatch.from_arrays([*own.columns, *[pa.array(v, t) for v, t in zip(zip(*found, strict=True), kinds, strict=True)]], names=names)

    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.binary(), pa.string()]
    names = [*df.columns, *own_names]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + PAGES
    return df.mapInArrow(released(run), schema)


#: How the text payloads are stored: (compression, predictor, tile side or 0), dealt by the payload's CRC-32.
FORMS = ((PACKBITS, 1, 0), (LZW, 1, 64), (DEFLATE, 2, 0), (DEFLATE, 2, 64))


def store_texts(docs: DataFrame, width: int = 192) -> DataFrame:
    """(doc_id, n_bytes, media): each text as UTF-8, padded by spaces to whole rows, as a one-page TIFF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            sizes, media = [], []
            for text in batch.column("text").to_pylist():
                data = (text or "").encode()
                sizes.append(len(data))
                payload = data.ljust(max(width, -(-len(data) // width) * width))
                kind, predictor, tile = FORMS[zlib.crc32(payload) % len(FORMS)]
                media.append(write([np.frombuffer(payload, np.uint8).reshape(-1, width)], kind, predictor, tile=tile))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(run), "doc_id long, n_bytes long, media binary")


def digest(pixels: bytes) -> str:
    """64 equal stretches of the samples, a bit for each brighter than the mean, in hex; then the mean in thousandths."""
    x = np.frombuffer(pixels, np.uint8)
    n = len(x)
    cut = np.arange(64) * n // 64
    sums = np.add.reduceat(x, cut, dtype=np.int64)
    size = np.diff(np.append(cut, n))
    total = int(sums.sum())
    bits = sums * n > total * size
    return np.packbits(bits).tobytes().hex() + f":{total * 1000 // n}"


def op5_media(docs: DataFrame) -> DataFrame:
    """Contract rows: store every text, read it back through tiff_pages, digest what was read."""
    feature = F.pandas_udf(lambda s: s.map(digest), "string")
    pages = tiff_pages(store_texts(docs))
    return pages.select(
        "doc_id", "n_bytes",
        F.length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(pixels, length(pixels) - 15, 16)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature("pixels").alias("feature"),
        "width", "height", "compression", "tiled", "predictor",
    )
