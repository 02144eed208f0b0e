"""TIFF in binary columns: image directories are walked, strips and tiles decoded, predictors undone; a row for each page.

Read: classic TIFF of either byte order; no compression, PackBits, LZW, deflate; strips or tiles; chunky or planar samples
of 8, 16, 32 or 64 bits; horizontal differencing and the floating-point predictor.  Written: 8-bit grey pages.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import kernels as K
from .store import bound_batches

# Fixed values of the TIFF 6.0 format and its supplements.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
TYPES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
CLEAR, END = 256, 257


class TiffError(ValueError):
    """The bytes aren't a TIFF that this module reads."""


# -- codecs ----------------------------------------------------------------------------------------------------------


def packbits_encode(data: bytes) -> bytes:
    x, out = np.frombuffer(data, np.uint8), bytearray()
    if not len(x):
        return b""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(x)) + 1, [len(x)]])
    plain = 0  # start of the bytes that wait for a literal packet

    def flush(upto: int) -> None:
        for i in range(plain, upto, 128):
            part = data[i : min(i + 128, upto)]
            out.append(len(part) - 1)
            out.extend(part)

    lengths = np.diff(cuts)
    for k in np.flatnonzero(lengths >= 3):
        a, b = int(cuts[k]), int(cuts[k + 1])
        flush(a)
        while b - a >= 2:
            n = min(128, b - a)
            out.append(257 - n)
            out.append(data[a])
            a += n
        plain = a
    flush(len(x))
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while len(out) < size and i < len(data):
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Most significant bit first, widths 9 to 12, each width one code early, as the format asks."""
    bits = n_bits = 0
    out = bytearray()
    table: dict[tuple[int, int], int] = {}
    next_, width, have = 258, 9, -1
    codes = [(CLEAR, 9)]
    for c in data:
        if have < 0:
            have = c
            continue
        found = table.get((have, c))
        if found is not None:
            have = found
            continue
        codes.append((have, width))
        table[have, c] = next_
        next_ += 1
        if next_ == 4094:
            codes.append((CLEAR, 12))
            table, next_, width = {}, 258, 9
        elif next_ >= 1 << width:
            width += 1
        have = c
    if have >= 0:
        codes.append((have, width))
        if next_ + 1 >= 1 << width and width < 12:
            width += 1
    codes.append((END, width))
    for code, w in codes:
        bits, n_bits = (bits << w) | code, n_bits + w
        while n_bits >= 8:
            n_bits -= 8
            out.append(bits >> n_bits)
            bits &= (1 << n_bits) - 1
    if n_bits:
        out.append((bits << (8 - n_bits)) & 255)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    single = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, last = list(single), 9, None
    bits = n_bits = at = 0
    out: list[bytes] = []
    made = 0
    while made < size:
        while n_bits < width:
            if at >= len(data):
                return b"".join(out)
            bits, n_bits, at = (bits << 8) | data[at], n_bits + 8, at + 1
        n_bits -= width
        code = bits >> n_bits
        bits &= (1 << n_bits) - 1
        if code == END:
            break
        if code == CLEAR:
            table, width, last = list(single), 9, None
            continue
        if last is None:
            word = table[code]
        else:
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        out.append(word)
        made += len(word)
        last = word
    return b"".join(out)


def decompress(kind: int, data: bytes, size: int) -> bytes:
    if kind == NONE:
        return data
    if kind == PACKBITS:
        return packbits_decode(data, size)
    if kind == LZW:
        return lzw_decode(data, size)
    if kind in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    raise TiffError(f"compression {kind} isn't supported")


def compress(kind: int, data: bytes, level: int = 6) -> bytes:
    return {NONE: lambda: data, PACKBITS: lambda: packbits_encode(data), LZW: lambda: lzw_encode(data), DEFLATE: lambda: zlib.compress(data, level)}[kind]()


# -- pages -----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    data: bytes  # rows from the top, samples of a pixel together, little-endian


def _directory(raw: bytes, at: int, order: str) -> tuple[dict[int, tuple[int, ...]], int]:
    if at + 2 > len(raw):
        raise TiffError("a directory lies outside the file")
    (n,) = struct.unpack_from(order + "H", raw, at)
    if at + 6 + 12 * n > len(raw):
        raise TiffError("a directory is cut off")
    tags = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * k)
        if kind not in TYPES:
            continue
        form = f"{order}{count}{TYPES[kind]}"
        size, place = struct.calcsize(form), at + 10 + 12 * k
        if size > 4:
            (place,) = struct.unpack_from(order + "I", raw, place)
        if place + size > len(raw):
            raise TiffError(f"values of tag {tag} lie outside the file")
        tags[tag] = struct.unpack_from(form, raw, place)
    return tags, struct.unpack_from(order + "I", raw, at + 2 + 12 * n)[0]


def _undo(block: np.ndarray, predictor: int, order: str, bits: int) -> np.ndarray:
    """block: rows x columns x samples in the file's byte order; out in little-endian."""
    native = np.dtype(f"u{bits // 8}")
    if predictor == 3:
        rows, cols, samples = block.shape
        planes = block.reshape(rows, -1).view(np.uint8).reshape(rows, -1, samples)
        planes = np.cumsum(planes, 1, dtype=np.uint8).reshape(rows, bits // 8, cols * samples)
        return np.ascontiguousarray(planes[:, ::-1].transpose(0, 2, 1)).view(native).reshape(rows, cols, samples)
    block = block.astype(native)
    return np.cumsum(block, 1, dtype=native) if predictor == 2 else block


def pages(raw: bytes) -> Iterator[Page]:
    """The pages in the order of the file's directories."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(raw[:4])
    if order is None or len(raw) < 8:
        raise TiffError("not a classic TIFF")
    (at,) = struct.unpack_from(order + "I", raw, 4)
    seen: set[int] = set()
    while at:
        if at in seen:
            raise TiffError("the directories form a ring")
        seen.add(at)
        tags, at = _directory(raw, at, order)
        one = lambda tag, other=None: tags.get(tag, (other,))[0]  # noqa: E731, B023
        width, height, samples, kind, predictor, planar = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1)
        bits = one(BITS, 1)
        if not width or not height or bits not in (8, 16, 32, 64) or len(set(tags.get(BITS, (8,)))) > 1:
            raise TiffError(f"an image of {width} x {height} samples of {tags.get(BITS)} bits isn't supported")
        tiled = TILE_OFFSETS in tags
        w, h = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(height, one(ROWS_PER_STRIP, height)))
        places, counts = tags.get(TILE_OFFSETS if tiled else STRIP_OFFSETS), tags.get(TILE_COUNTS if tiled else STRIP_COUNTS)
        across, down = -(-width // w), -(-height // h)
        planes, each = (samples, 1) if planar == 2 else (1, samples)
        if not places or not counts or len(places) < across * down * planes or len(counts) < len(places):
            raise TiffError("strips or tiles are missing")
        native = np.dtype(f"u{bits // 8}")
        image = np.zeros((down * h, across * w, samples), native)
        for k in range(across * down * planes):
            plane, block = divmod(k, across * down)
            y, x = divmod(block, across)
            rows = h if tiled else min(h, height - y * h)
            size = rows * w * each * native.itemsize
            data = decompress(kind, raw[places[k] : places[k] + counts[k]], size)
            if len(data) < size:
                raise TiffError("a strip or tile is too short")
            part = np.frombuffer(data, native.newbyteorder(order), rows * w * each).reshape(rows, w, each)
            part = _undo(part, predictor, order, bits)
            to = slice(plane, plane + 1) if planes > 1 else slice(None)
            image[y * h : y * h + rows, x * w : x * w + w, to] = part
        yield Page(width, height, samples, bits, kind, image[:height, :width].astype(native.newbyteorder("<")).tobytes())


@dataclass(frozen=True)
class Layout:
    """How a page of ``rows`` rows is written; the first whose ``most_rows`` it doesn't pass holds."""

    most_rows: int
    compression: int
    predictor: int = 1
    tile: tuple[int, int] | None = None  # width and height, multiples of 16
    rows_per_strip: int = 64


#: One-row pages are mostly padding (runs), short ones hold too little for deflate's tables, long ones are tiled.
LAYOUTS = (Layout(1, PACKBITS), Layout(4, LZW, rows_per_strip=2), Layout(1 << 31, DEFLATE, 2, (192, 64)))
ROW = 576
PAGE_ROWS = 192


def encode(payload: bytes, row: int = ROW, page_rows: int = PAGE_ROWS, layouts: tuple[Layout, ...] = LAYOUTS) -> bytes:
    """8-bit grey pages that hold ``payload``, a multiple of ``row`` bytes."""
    if not payload or len(payload) % row:
        raise ValueError("the payload must be a positive multiple of the row length")
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    image = np.frombuffer(payload, np.uint8).reshape(-1, row)
    for top in range(0, len(image), page_rows):
        page = image[top : top + page_rows]
        how = next(x for x in layouts if len(page) <= x.most_rows)
        blocks = []
        if how.tile:
            w, h = how.tile
            for y in range(0, len(page), h):
                for x in range(0, row, w):
                    block = np.zeros((h, w), np.uint8)
                    part = page[y : y + h, x : x + w]
                    block[: part.shape[0], : part.shape[1]] = part
                    blocks.append(block)
        else:
            blocks = [page[y : y + how.rows_per_strip] for y in range(0, len(page), how.rows_per_strip)]
        places, counts = [], []
        for block in blocks:
            if how.predictor == 2:
                block = np.diff(block, axis=1, prepend=np.zeros((len(block), 1), np.uint8))
            data = compress(how.compression, block.tobytes())
            places.append(len(out))
            counts.append(len(data))
            out += data + b"\0" * (len(data) % 2)
        tags = {WIDTH: (row,), HEIGHT: (len(page),), BITS: (8,), COMPRESSION: (how.compression,), PHOTOMETRIC: (1,), SAMPLES: (1,), PREDICTOR: (how.predictor,)}
        tags |= {TILE_WIDTH: (how.tile[0],), TILE_HEIGHT: (how.tile[1],), TILE_OFFSETS: places, TILE_COUNTS: counts} if how.tile else {STRIP_OFFSETS: places, ROWS_PER_STRIP: (how.rows_per_strip,), STRIP_COUNTS: counts}
        entries = b""
        for tag in sorted(tags):
            values = struct.pack(f"<{len(tags[tag])}I", *tags[tag])
            if len(values) > 4:
                values, place = struct.pack("<I", len(out)), values
                out += place
            entries += struct.pack("<HHI", tag, 4, len(tags[tag])) + values
        struct.pack_into("<I", out, link, len(out))
        link = len(out) + 2 + len(entries)
        out += struct.pack("<H", len(tags)) + entries + b"\0\0\0\0"
    return bytes(out)


# -- tables ----------------------------------------------------------------------------------------------------------

CHUNK = 4 << 20
PAGE_COLUMNS = "page int, width int, height int, samples_per_pixel int, bits int, compression int, samples binary, error string"


def text_to_tiff(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as UTF-8, padded by bytes 255 to a positive multiple of 576, as a TIFF.

    Null texts are empty.  One row for each input row, repeated rows and null ids included.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, media, held = [], [], [], 0
            for d, t in zip(K.column(batch, "doc_id").to_pylist(), K.column(batch, "text").cast(pa.large_binary())):
                t = t.as_py() or b""
                ids.append(d)
                sizes.append(len(t))
                media.append(encode(t + b"\xff" * (-len(t) % ROW if t else ROW)))
                held += len(media[-1])
                if held > CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), K.binaries(media)], ["doc_id", "n_bytes", "media"])
                    ids, sizes, media, held = [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), K.binaries(media)], ["doc_id", "n_bytes", "media"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def tiff_pages(table: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each page: the ``keep`` columns, then page (from 0), width, height, samples_per_pixel, bits,
    compression, samples, error.

    Null media give no rows.  Bytes that aren't a readable TIFF give the pages before the fault and one row with a null
    page and the error.  Kept columns whose names clash with these get the suffix ``_in``.  Pages of a file follow each
    other within a partition.
    """
    names = [x.split()[0] for x in PAGE_COLUMNS.split(", ")]
    kept = [F.col(c).alias(f"{c}_in" if c in names or c == "media" else c) for c in keep]
    picked = table.select(*kept, F.col(media).alias("media")).filter("media is not null")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema[:-1]), PAGE_COLUMNS])
    kinds = [pa.int32()] * 6 + [pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            from_, rows, held = [], [], 0

            def made(batch=batch) -> pa.RecordBatch:
                cols = list(zip(*rows)) or [[]] * 8
                head = [batch.column(i).take(pa.array(from_, pa.int64())) for i in range(batch.num_columns - 1)]  # noqa: B023
                return pa.RecordBatch.from_arrays([*head, *(pa.array(c, k) for c, k in zip(cols, kinds))], [*batch.schema.names[:-1], *names])

            for i, raw in enumerate(batch.column(batch.num_columns - 1)):
                try:
                    for p, x in enumerate(pages(raw.as_py())):
                        from_.append(i)
                        rows.append((p, x.width, x.height, x.samples, x.bits, x.compression, x.data, None))
                        held += len(x.data)
                        if held > CHUNK:
                            yield made()
                            from_, rows, held = [], [], 0
                except (TiffError, zlib.error, struct.error, IndexError, ValueError) as e:
                    from_.append(i)
                    rows.append((None, None, None, None, None, None, None, str(e)[:200]))
            if rows:
                yield made()

    return picked.mapInArrow(run, schema)


def payload_features(page_rows: DataFrame) -> DataFrame:
    """Fold the pages of each file, which follow each other, into digests of its payload and a feature string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        now, out = None, []

        def close() -> None:
            head, n, sha, tail, count, many = now
            mean = float((count * np.arange(256)).sum() / max(1, n))
            part = count.reshape(8, 32).sum(1) / max(1, n)
            out.append((head[0], head[1], n, sha.hexdigest(), zlib.crc32(tail), head[2], head[3], f"pages={many};mean={mean:.4f};hist=" + ",".join(f"{x:.4f}" for x in part)))

        for batch in batches:
            for d, nb, mb, ms, p, data, error in zip(*(K.column(batch, c).to_pylist() for c in ("doc_id", "n_bytes", "media_bytes", "media_sha256", "page", "samples", "error"))):
                if error is not None:
                    raise TiffError(error)
                if p == 0:
                    if now:
                        close()
                    now = [(d, nb, mb, ms), 0, hashlib.sha256(), b"", np.zeros(256, np.int64), 0]
                now[1] += len(data)
                now[2].update(data)
                now[3] = (now[3] + data)[-32:]
                now[4] += np.bincount(np.frombuffer(data, np.uint8), minlength=256)
                now[5] += 1
            cols = list(zip(*out)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
            out = []
        if now:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return page_rows.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = text_to_tiff(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    media = media.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    return payload_features(tiff_pages(media, keep=("doc_id", "n_bytes", "media_bytes", "media_sha256")))
