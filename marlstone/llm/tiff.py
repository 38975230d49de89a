"""TIFF media columns: one row for each page of the files in a binary column.

The reader walks the image directories of little- and big-endian files, decodes strips and tiles stored
raw, as PackBits, LZW or deflate, and undoes the horizontal predictor for 8- and 16-bit samples. The
writer makes such files; it also serves the tests' round trips.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import table, tidy

# Fixed values of the format.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES = 322, 323, 324, 325
RAW, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPE_FORMAT = {1: "B", 3: "H", 4: "I", 16: "Q"}
CLEAR, END = 256, 257

#: Layout of the stored documents: rows of ROW bytes, pages of at most PAGE_ROWS rows.
ROW = 64
PAGE_ROWS = 65_536
STRIP_ROWS = 1024


@dataclass(frozen=True)
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    pixels: bytes


def packbits_decode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        k, i = data[i], i + 1
        if k < 128:
            out += data[i:i + k + 1]
            i += k + 1
        elif k > 128:
            out += data[i:i + 1] * (257 - k)
            i += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes([257 - run, data[i]])
            i += run
            continue
        j = i + 1
        while j < n and j - i < 128 and not (j + 1 < n and data[j] == data[j + 1]):
            j += 1
        out += bytes([j - i - 1]) + data[i:j]
        i = j
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """Most significant bit first; the code length grows one code early."""
    out: list[bytes] = []
    table_, bits, held, have, before = [], 9, 0, 0, None
    for byte in data:
        held, have = held << 8 | byte, have + 8
        if have < bits:
            continue
        have -= bits
        code, held = held >> have, held & (1 << have) - 1
        if code == END:
            break
        if code == CLEAR:
            table_, bits, before = [bytes([k]) for k in range(256)] + [b"", b""], 9, None
            continue
        if not table_:
            table_ = [bytes([k]) for k in range(256)] + [b"", b""]
        if before is None:
            entry = table_[code]
        else:
            if code > len(table_):
                raise ValueError("LZW code beyond the table")
            entry = table_[code] if code < len(table_) else before + before[:1]
            table_.append(before + entry[:1])
            bits = min(12, (len(table_) + 1).bit_length())
        out.append(entry)
        before = entry
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, held, have = bytearray(), 0, 0
    known = {bytes([k]): k for k in range(256)}
    size, bits, word = 258, 9, b""

    def put(code: int) -> None:
        nonlocal held, have
        held, have = held << bits | code, have + bits
        while have >= 8:
            have -= 8
            out.append(held >> have)
            held &= (1 << have) - 1

    put(CLEAR)
    for k in range(len(data)):
        more = word + data[k:k + 1]
        if more in known:
            word = more
            continue
        put(known[word])
        known[more] = size
        size += 1
        bits = min(12, size.bit_length())
        if size == 4094:
            put(CLEAR)
            known, size, bits = {bytes([j]): j for j in range(256)}, 258, 9
        word = data[k:k + 1]
    if word:
        put(known[word])
        size += 1
        bits = min(12, size.bit_length())
    put(END)
    if have:
        out.append(held << 8 - have & 255)
    return bytes(out)


def _pack(block: bytes, compression: int) -> bytes:
    if compression == LZW:
        return lzw_encode(block)
    if compression == PACKBITS:
        return packbits_encode(block)
    return zlib.compress(block, 6) if compression in (DEFLATE, OLD_DEFLATE) else block


def _unpack(block: bytes, compression: int, size: int) -> bytes:
    if compression == LZW:
        out = lzw_decode(block)
    elif compression == PACKBITS:
        out = packbits_decode(block)
    elif compression in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(block, size)
    elif compression == RAW:
        out = block
    else:
        raise ValueError(f"compression {compression} is not supported")
    if len(out) < size:
        raise ValueError("a strip or tile is too short")
    return out[:size]


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, strip_rows: int = STRIP_ROWS,
               tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A file of pages of 8- or 16-bit samples, shape (rows, columns) or (rows, columns, samples); tile: (rows, columns), multiples of 16."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8 if not pages else 0))
    link = 4
    for page in pages:
        page = page[..., None] if page.ndim == 2 else page
        rows, columns, samples = page.shape
        bits = page.dtype.itemsize * 8
        if tile:
            blocks = []
            for y in range(0, rows, tile[0]):
                for x in range(0, columns, tile[1]):
                    block = np.zeros((*tile, samples), page.dtype)
                    part = page[y:y + tile[0], x:x + tile[1]]
                    block[:part.shape[0], :part.shape[1]] = part
                    blocks.append(block)
        else:
            blocks = [page[y:y + strip_rows] for y in range(0, rows, strip_rows)]
        offsets, sizes = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
            packed = _pack(block.astype(block.dtype.newbyteorder(order)).tobytes(), compression)
            offsets.append(len(out))
            sizes.append(len(packed))
            out += packed + b"\0" * (len(packed) % 2)
        tags = [(WIDTH, 4, [columns]), (LENGTH, 4, [rows]), (BITS, 3, [bits] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if samples == 3 else 1]), (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        tags += [(TILE_WIDTH, 4, [tile[1]]), (TILE_LENGTH, 4, [tile[0]]), (TILE_OFFSETS, 4, offsets), (TILE_BYTES, 4, sizes)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [strip_rows]), (STRIP_BYTES, 4, sizes)]
        entries = b""
        for tag, kind, values in sorted(tags):
            data = struct.pack(f"{order}{len(values)}{TYPE_FORMAT[kind]}", *values)
            if len(data) > 4:
                at = len(out)
                out += data + b"\0" * (len(data) % 2)
                data = struct.pack(order + "I", at)
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += bytes(4)
    return bytes(out)


def read_pages(data: bytes) -> Iterator[Page]:
    """The pages in the order of the directories; pixels row by row, samples of a pixel together, in the machine's byte order."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind in TYPE_FORMAT:
                form = f"{order}{count}{TYPE_FORMAT[kind]}"
                where = at + 10 + 12 * k
                tags[tag] = struct.unpack_from(form, data, where if struct.calcsize(form) <= 4 else struct.unpack_from(order + "I", data, where)[0])
        yield _page(data, tags, order)
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def _page(data: bytes, tags: dict[int, tuple], order: str) -> Page:
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    width, height, samples, bits, compression, predictor = one(WIDTH), one(LENGTH), one(SAMPLES, 1), one(BITS, 1), one(COMPRESSION, 1), one(PREDICTOR, 1)
    if width is None or height is None or bits not in (8, 16) or len(set(tags.get(BITS, (bits,)))) > 1 or predictor not in (1, 2) or one(PLANAR, 1) != 1 and samples > 1:
        raise ValueError("only chunky pages of 8 or 16 bits are supported")
    kind = np.dtype(f"{order}u{bits // 8}")
    tiled = TILE_OFFSETS in tags
    rows, columns = (one(TILE_LENGTH), one(TILE_WIDTH)) if tiled else (min(one(ROWS_PER_STRIP, height), height), width)
    image = np.zeros((height, width, samples), kind.newbyteorder("="))
    across = -(-width // columns) if width else 1
    for k, (offset, size) in enumerate(zip(tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_BYTES if tiled else STRIP_BYTES])):
        y, x = k // across * rows, k % across * columns
        high = rows if tiled else min(rows, height - y)
        block = np.frombuffer(_unpack(data[offset:offset + size], compression, high * columns * samples * kind.itemsize), kind).reshape(high, columns, samples)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=image.dtype)
        image[y:y + rows, x:x + columns] = block[:height - y, :width - x]
    return Page(width, height, samples, bits, compression, predictor, tiled, image.tobytes())


PAGE_SCHEMA = "page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, error string"


def tiff_pages(files: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """One row for each page: id, page number from 0, geometry, pixels. A null file gives no row; a broken one gives its good pages and then a row with `error`."""
    from pyspark.sql.types import StructType

    schema = StructType([files.schema[id_col], *StructType.fromDDL(PAGE_SCHEMA).fields])
    names = schema.names[1:]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kind = batch.column(0), batch.column(1)
            for k in range(batch.num_rows):
                data, n = kind[k].as_py(), 0
                if data is None:
                    continue
                rows = []
                try:
                    for n, p in enumerate(read_pages(data)):  # noqa: B007
                        rows.append(dict(zip(names, (n, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.tiled, p.pixels, None))))
                except (ValueError, KeyError, IndexError, struct.error, zlib.error, OverflowError) as e:
                    rows.append(dict.fromkeys(names) | {"page": len(rows), "error": str(e)})
                for row in rows:
                    yield pa.RecordBatch.from_arrays([ids.slice(k, 1), *(pa.array([row[f.name]], t) for f, t in zip(schema.fields[1:], _ARROW))], schema.names)

    return files.select(id_col, data_col).mapInArrow(run, schema)


_ARROW = [*[pa.int32()] * 7, pa.bool_(), pa.binary(), pa.string()]


def store_text(text: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of ROW, as deflated pages of 8-bit samples with the horizontal predictor."""
    payload = text + bytes(-len(text) % ROW if text else ROW)
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    return write_tiff([rows[k:k + PAGE_ROWS] for k in range(0, len(rows), PAGE_ROWS)], DEFLATE, predictor=2)


_DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digests(text: bytes) -> tuple:
    media = store_text(text)
    sha, size, pages, height, total, tail, low, high = hashlib.sha256(), 0, 0, 0, 0, b"", 255, 0
    for page in read_pages(media):
        sha.update(page.pixels)
        pixels = np.frombuffer(page.pixels, np.uint8)
        size, pages, height, total = size + len(pixels), pages + 1, height + page.height, total + int(pixels.sum(dtype=np.int64))
        low, high, tail = min(low, int(pixels.min())), max(high, int(pixels.max())), page.pixels[-ROW:]
    feature = f"tiff;pages={pages};width={ROW};height={height};min={low};max={high};mean={total / size:.6f}"
    return len(text), size, sha.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature


def op8_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text is stored as a TIFF file; all figures but n_bytes and those of the file come from the pages read back."""
    from pyspark.sql.types import StructType

    docs = table(spark, sf_dir, "documents")
    fields = StructType.fromDDL(_DIGEST)
    schema = StructType([docs.schema["doc_id"], *fields.fields])
    kinds = [pa.string() if f.dataType.simpleString() == "string" else pa.int64() for f in fields]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_digests(t.as_py() or b"") for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds))], schema.names)

    return docs.select("doc_id", F.col("text")).mapInArrow(run, schema)
