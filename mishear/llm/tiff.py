"""Media columns: TIFF images in a binary column, one row per page.

The reader walks the chain of image directories of a file, in either byte
order, gathers the strips or tiles of each page, undoes PackBits, LZW or
deflate and the horizontal or floating-point predictor, and gives the samples.
The writer stores 8-bit samples losslessly, in either byte order, as strips or
tiles; it serves to make media from other columns. The query stores each text
in a layout that its bytes choose (:func:`layout_of`), so that it reads all of
these back.

Both work row by row on Arrow batches, so memory is bounded by the largest
file, and a page's by what its file can hold: sizes are checked against the
data before anything is allocated (strips that share data count once).

Defined cases: a null or empty file, or one that is no TIFF, gives one
row with page -1, no samples and the reason in ``error``; a page that is damaged
or not of a kind that is read gives a row with its number and the reason, and
the pages before and after it stay, as far as the chain of directories can be
followed; samples of 1, 2 and 4 bits take a byte each, wider ones come low byte
first; repeated rows are read each; very long files are read whole; an empty
table gives no rows; other columns are ignored.
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

from mishear.llm._arrow import slices, tidy

#: Tags, sizes of field types and compression schemes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS = 256, 257, 258, 259, 262, 273
SAMPLES, ROWS_PER_STRIP, STRIP_SIZES, PLANAR, PREDICTOR = 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES, FILL_ORDER = 322, 323, 324, 325, 266
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
NO_COMPRESSION, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
#: What a byte of data can grow to at most, by compression.
MOST_GROWTH = {NO_COMPRESSION: 1, PACKBITS: 64, DEFLATE: 1040, OLD_DEFLATE: 1040, LZW: 4096}
#: What a page that cannot be read raises.
UNREADABLE = (ValueError, KeyError, IndexError, TypeError, ArithmeticError, MemoryError, struct.error, zlib.error)
PAGE_SCHEMA = "media_id long, page int, width int, height int, samples int, bits int, compression int, predictor int, pixels binary, error string"

#: Pixels of a row and rows of a page and a strip that the writer makes of bytes; 64 RGB pixels are 192 bytes.
ROW_PIXELS, PAGE_ROWS, STRIP_ROWS = 64, 4096, 128
#: Width and height of the writer's tiles, and the longest payload that the query stores by LZW, whose coder is the slowest.
TILE, LZW_BYTES = (32, 128), 960


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three or more as runs, all else as literals."""
    out, at, literal = bytearray(), 0, 0
    while at < len(data):
        end = at + 1
        while end < len(data) and end - at < 128 and data[end] == data[at]:
            end += 1
        if end - at >= 3 or end == len(data):
            if end - at < 3:
                at = end
            for a in range(literal, at, 128):
                own = data[a : min(a + 128, at)]
                out += bytes([len(own) - 1]) + own
            if end > at:
                out += bytes([257 - (end - at), data[at]])
            at = literal = end
        else:
            at = end
    return bytes(out)


def literal_bits(rows: np.ndarray) -> bytes:
    """Rows of bytes (n, width) as literal runs that end with their row."""
    parts = []
    for at in range(0, rows.shape[1], 128):
        own = rows[:, at : at + 128]
        parts += [np.full((len(rows), 1), own.shape[1] - 1, np.uint8), own]
    return np.concatenate(parts, axis=1).tobytes()


def unpack_lzw(data: bytes, size: int | None = None) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, widened one code early; stops at ``size`` bytes."""
    clear, end = 256, 257
    table: list[bytes] = []
    out: list[bytes] = []
    width, held, bits, before, made = 9, 0, 0, b"", 0
    for byte in data:
        held = (held << 8) | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == clear:
            table, width, before = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code == end:
            break
        if code < len(table):
            word = table[code]
        elif before:
            word = before + before[:1]
        else:
            raise ValueError("LZW data begins without a clear code")
        out.append(word)
        made += len(word)
        if size is not None and made >= size:
            break
        if before:
            table.append(before + word[:1])
        before = word
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    out, held, bits, width = bytearray(), 0, 0, 9

    def put(code: int) -> None:
        nonlocal held, bits
        held = (held << width) | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    table = {bytes([i]): i for i in range(256)}
    put(256)
    size, word = 258, b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = size
        size += 1
        if size == (1 << width) and width < 12:
            width += 1
        elif size >= 4094:
            put(256)
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
        word = data[i : i + 1]
    if word:
        put(table[word])
        size += 1
        if size == (1 << width) and width < 12:
            width += 1
    put(257)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


def unpack(data: bytes, compression: int, size: int) -> bytes:
    if compression == NO_COMPRESSION:
        return data
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    if compression == LZW:
        return unpack_lzw(data, size)
    if compression == PACKBITS:
        return unpack_bits(data, size)
    raise ValueError(f"compression {compression} is not read")


@dataclass
class Page:
    page: int
    width: int = 0
    height: int = 0
    samples: int = 0
    bits: int = 0
    compression: int = 0
    predictor: int = 0
    pixels: bytes = b""
    error: str | None = None


def following(data: bytes, at: int, order: str) -> int:
    """Where the directory after that at ``at`` is."""
    (n,) = struct.unpack_from(f"{order}H", data, at)
    return struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)[0]


def directory(data: bytes, at: int, order: str) -> dict[int, list[int]]:
    """Integer fields of the image directory at ``at``."""
    (n,) = struct.unpack_from(f"{order}H", data, at)
    found: dict[int, list[int]] = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * i)
        size = TYPE_SIZES.get(kind, 0) * count
        place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(f"{order}I", data, at + 10 + 12 * i)[0]
        letter = {1: "B", 3: "H", 4: "I"}.get(kind)
        if letter:
            found[tag] = list(struct.unpack_from(f"{order}{count}{letter}", data, place))
    return found


def spread_bits(raw: bytes, bits: int, rows: int, row_samples: int) -> np.ndarray:
    """Samples of less than a byte, a byte each; rows begin at whole bytes."""
    every = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, -1), axis=1)[:, : row_samples * bits]
    return np.packbits(every.reshape(rows, row_samples, bits), axis=2)[..., 0] >> np.uint8(8 - bits)


def floats(block: np.ndarray, wide: int) -> np.ndarray:
    """Undoes the floating-point predictor: rows of (bytes of a sample, samples), differences of bytes, high bytes first."""
    rows, width, per = block.shape
    raw = block.view(np.uint8).reshape(rows, width * wide, per)
    planes = np.cumsum(raw, axis=1, dtype=np.uint8).reshape(rows, wide, width * per)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">u{wide}").reshape(rows, width, per)


def read_page(data: bytes, tags: dict[int, list[int]], order: str, number: int) -> Page:
    one = lambda tag, default: tags.get(tag, [default])[0]
    width, height, samples = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    bits, compression, predictor, planar = one(BITS, 1), one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1)
    if bits not in (1, 2, 4, 8, 16, 32) or len(set(tags.get(BITS, [bits]))) > 1:
        raise ValueError(f"{bits}-bit samples are not read")
    wide = max(1, bits // 8)
    kind = np.dtype(f"{order}u{wide}")
    tiled = TILE_OFFSETS in tags
    block_w, block_h = (one(TILE_WIDTH, width), one(TILE_HEIGHT, height)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    offsets, sizes = tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_SIZES if tiled else STRIP_SIZES]
    if min(width, height, samples, block_w, block_h) < 1:
        raise ValueError("a size is 0")
    per = 1 if planar == 2 else samples
    across, down = -(-width // block_w), -(-height // block_h)
    blocks = across * down * (samples if planar == 2 else 1)
    if min(len(offsets), len(sizes)) < blocks:
        raise ValueError(f"{min(len(offsets), len(sizes))} of {blocks} blocks")
    held = len(data) * MOST_GROWTH.get(compression, 1)
    if max(height * -(-width * samples * bits // 8), block_h * -(-block_w * per * bits // 8)) > held:
        raise ValueError("the page is larger than its file can hold")
    image = np.zeros((height, width, samples), kind.newbyteorder("<"))
    for k, (offset, size) in enumerate(zip(offsets[:blocks], sizes)):
        plane, rest = divmod(k, across * down)
        y, x = rest // across * block_h, rest % across * block_w
        rows = block_h if tiled else min(block_h, height - y)
        wanted = rows * -(-block_w * per * bits // 8)
        packed = data[offset : offset + size]
        raw = unpack(packed.translate(REVERSED) if one(FILL_ORDER, 1) == 2 else packed, compression, wanted)
        if len(raw) < wanted:
            raise ValueError(f"block {k} has {len(raw)} of {wanted} bytes")
        block = np.frombuffer(raw[:wanted], kind) if bits >= 8 else spread_bits(raw[:wanted], bits, rows, block_w * per)
        block = block.reshape(rows, block_w, per)
        if predictor == 2 and bits >= 8:
            block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
        elif predictor == 3 and bits >= 16:
            block = floats(block, wide)
        elif predictor != 1:
            raise ValueError(f"predictor {predictor} of {bits}-bit samples is not read")
        part = image[y : y + rows, x : x + block_w, plane if planar == 2 else slice(None)]
        part[...] = block[: part.shape[0], : part.shape[1], 0 if planar == 2 else slice(None)]
    return Page(number, width, height, samples, bits, compression, predictor, image.tobytes())


def read(data: bytes | None) -> Iterator[Page]:
    """The pages of a file."""
    number = -1
    try:
        order = {b"II": "<", b"MM": ">"}[bytes((data or b"")[:2])]
        magic, at = struct.unpack_from(f"{order}HI", data, 2)
        if magic != 42:
            raise ValueError(f"magic number {magic}")
        seen: set[int] = set()
        while at:
            number += 1
            if at in seen:
                raise ValueError("directories form a ring")
            seen.add(at)
            here, at = at, following(data, at, order)
            try:
                page = read_page(data, directory(data, here, order), order, number)
            except UNREADABLE as e:
                page = failed(number, e)
            yield page
    except UNREADABLE as e:
        yield failed(number, e)


def failed(number: int, e: Exception) -> Page:
    return Page(number, error=f"{type(e).__name__}: {e}"[:200])


@dataclass(frozen=True)
class Layout:
    """How the writer stores a page: byte order, compression, and tiles (width, height) or strips."""

    order: str = "<"
    compression: int = DEFLATE
    tile: tuple[int, int] | None = None


#: The layouts of the query, and the one that takes the place of the last for small payloads.
LAYOUTS, SMALL = (Layout(), Layout(">", DEFLATE, TILE), Layout("<", PACKBITS)), Layout(">", LZW)


def layout_of(payload: bytes) -> Layout:
    k = zlib.crc32(payload) % len(LAYOUTS)
    return SMALL if k == len(LAYOUTS) - 1 and len(payload) <= LZW_BYTES else LAYOUTS[k]


def _blocks(page: np.ndarray, tile: tuple[int, int] | None, strip_rows: int) -> Iterator[np.ndarray]:
    """Strips, or tiles filled up with zeros."""
    if tile is None:
        yield from (page[a : a + strip_rows] for a in range(0, len(page), strip_rows))
        return
    w, h = tile
    for y in range(0, page.shape[0], h):
        for x in range(0, page.shape[1], w):
            own = page[y : y + h, x : x + w]
            yield np.pad(own, ((0, h - own.shape[0]), (0, w - own.shape[1]), (0, 0)))


def _packed(block: np.ndarray, compression: int, level: int) -> bytes:
    if compression == PACKBITS:
        return literal_bits(block.reshape(len(block), -1))
    raw = np.diff(block, axis=1, prepend=np.uint8(0)).tobytes()
    return pack_lzw(raw) if compression == LZW else zlib.compress(raw, level)


def write(payload: bytes, row_pixels: int = ROW_PIXELS, samples: int = 3, page_rows: int = PAGE_ROWS, strip_rows: int = STRIP_ROWS, level: int = 1, layout: Layout = Layout()) -> bytes:
    """8-bit samples as pages of strips or tiles, with the horizontal predictor but for PackBits; whole rows only."""
    rows, e = np.frombuffer(payload, np.uint8).reshape(-1, row_pixels, samples), layout.order
    out, link = bytearray((b"II" if e == "<" else b"MM") + struct.pack(f"{e}HI", 42, 0)), 4

    def kept(kind: int, values: list[int]) -> tuple[int, int, bytes]:
        """A field's type, count and four bytes: its values, or where they are."""
        raw = struct.pack(f"{e}{len(values)}{'H' if kind == 3 else 'I'}", *values)
        if len(raw) > 4:
            place = len(out)
            out.extend(raw + b"\0" * (len(raw) % 2))
            raw = struct.pack(f"{e}I", place)
        return kind, len(values), raw.ljust(4, b"\0")

    for first in range(0, len(rows), page_rows):
        page, places, sizes = rows[first : first + page_rows], [], []
        for block in _blocks(page, layout.tile, strip_rows):
            own = _packed(block, layout.compression, level)
            places.append(len(out))
            sizes.append(len(own))
            out.extend(own + b"\0" * (len(own) % 2))
        fields = {
            WIDTH: (4, [row_pixels]), HEIGHT: (4, [len(page)]), BITS: (3, [8] * samples), COMPRESSION: (3, [layout.compression]), PHOTOMETRIC: (3, [2 if samples == 3 else 1]),
            SAMPLES: (3, [samples]), PLANAR: (3, [1]), PREDICTOR: (3, [1 if layout.compression == PACKBITS else 2]),
        }
        if layout.tile is None:
            fields |= {STRIP_OFFSETS: (4, places), ROWS_PER_STRIP: (4, [strip_rows]), STRIP_SIZES: (4, sizes)}
        else:
            fields |= {TILE_WIDTH: (4, [layout.tile[0]]), TILE_HEIGHT: (4, [layout.tile[1]]), TILE_OFFSETS: (4, places), TILE_SIZES: (4, sizes)}
        entries = [(tag, *kept(*fields[tag])) for tag in sorted(fields)]
        struct.pack_into(f"{e}I", out, link, len(out))
        out.extend(struct.pack(f"{e}H", len(entries)))
        for tag, kind, n, raw in entries:
            out.extend(struct.pack(f"{e}HHI", tag, kind, n) + raw)
        link = len(out)
        out.extend(b"\0\0\0\0")
    return bytes(out)


def features(pages: list[Page]) -> str:
    """Size, mean and spread of each channel, and a fingerprint of how rows brighten, in integers."""
    if not pages or pages[0].error is not None:
        return ""
    out = []
    for p in pages:
        if p.error is not None:
            out.append("")
            continue
        image = np.frombuffer(p.pixels, f"<u{max(1, p.bits // 8)}").reshape(p.height, p.width, p.samples).astype(np.int64)
        image >>= max(0, p.bits - 16)  # squares of the high half of 32 bits fit
        n = max(1, p.height * p.width)
        sums, squares = image.sum(axis=(0, 1)), (image * image).sum(axis=(0, 1))
        spread = (n * squares - sums * sums) // (n * n)
        gray = image.sum(axis=2)
        rows = np.add.reduceat(gray, np.arange(0, p.width, max(1, p.width // 8)), axis=1).sum(axis=0)[:8]
        bits = "".join("1" if b > a else "0" for a, b in zip(rows, np.roll(rows, -1)))
        out.append(f"{p.width}x{p.height}x{p.samples}:" + ",".join(f"{s // n}" for s in sums) + ":" + ",".join(map(str, spread)) + f":{bits}")
    return ";".join(out)


def pages(media: DataFrame, id_column: str = "media_id", content: str = "content") -> DataFrame:
    """One row per page of each file, with its samples."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "content"):
                ids, found = [], []
                for media_id, data in zip(part.column("media_id").to_pylist(), part.column("content").to_pylist()):
                    for page in read(data):
                        ids.append(media_id)
                        found.append(page)
                columns = {n: [getattr(p, n) for p in found] for n in ("page", "width", "height", "samples", "bits", "compression", "predictor", "pixels", "error")}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), *(pa.array(v, pa.binary() if n == "pixels" else pa.string() if n == "error" else pa.int32()) for n, v in columns.items())],
                    names=["media_id", *columns],
                )

    rows = media.select(F.col(id_column).cast("long").alias("media_id"), F.col(content).cast("binary").alias("content"))
    return rows.mapInArrow(run, PAGE_SCHEMA)


def payload_of(text: bytes, unit: int = 192) -> bytes:
    """``text`` with spaces up to a positive multiple of ``unit``."""
    return text + b" " * ((unit if not text else 0) + -len(text) % unit)


@tidy
def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stores texts, reads the stored bytes back and digests what was read."""
    for batch in batches:
        for part in slices(batch, "text"):
            rows = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.large_binary()).to_pylist()):
                payload = payload_of(text)
                stored = write(payload, layout=layout_of(payload))
                found = list(read(stored))
                back = b"".join(p.pixels for p in found)
                rows.append((doc_id, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), features(found), len(found)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(v), k) for v, k in zip(zip(*rows), kinds)],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_pages"],
            )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(
        digests,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages long",
    )
