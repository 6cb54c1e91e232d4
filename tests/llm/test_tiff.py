import hashlib
import itertools
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from mishear.llm import tiff


def made(*pages, order="<"):
    """A file of pages: (width, height, bits, compression, other tags, data of the one strip)."""
    out, link = bytearray((b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 0)), 4
    for width, height, bits, compression, other, data in pages:
        place = len(out)
        out += data + b"\0" * (len(data) % 2)
        tags = {tiff.WIDTH: width, tiff.HEIGHT: height, tiff.BITS: bits, tiff.COMPRESSION: compression, tiff.STRIP_OFFSETS: place, tiff.STRIP_SIZES: len(data)} | other
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(tags)) + b"".join(struct.pack(f"{order}HHII", tag, 4, 1, v) for tag, v in sorted(tags.items()))
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def test_pages_after_an_unreadable_one_and_small_samples():
    gray, mask, four = np.arange(6, dtype=np.uint8), np.array([[1, 0] * 5, [0, 1] * 5], np.uint8), np.array([[1, 15, 7]], np.uint8)
    bilevel = np.packbits(mask, axis=1).tobytes()
    plain = (3, 2, 8, 1, {}, gray.tobytes())
    for order in "<>":
        pages = list(tiff.read(made(
            plain, (10, 2, 1, tiff.PACKBITS, {}, tiff.pack_bits(bilevel)), (1, 1, 64, 1, {}, b"abcdefgh"), (3, 1, 4, 1, {}, b"\x1f\x70"),
            (3, 2, 8, 1, {tiff.PREDICTOR: 3}, gray.tobytes()), (0, 0, 8, 1, {}, b""), (3, 2, 8, 4, {}, b"fax"),
            (10, 2, 1, 1, {tiff.FILL_ORDER: 2}, bilevel.translate(tiff.REVERSED)), plain, order=order,
        )))
        assert [p.page for p in pages] == list(range(9))
        assert [p.error is None for p in pages] == [True, True, False, True, False, False, False, True, True]
        assert pages[0].pixels == pages[8].pixels == gray.tobytes()
        assert pages[1].pixels == pages[7].pixels == mask.tobytes() and (pages[1].bits, pages[1].width) == (1, 10)
        assert pages[3].pixels == four.tobytes() and len(tiff.features(pages).split(";")) == 9


def test_a_damaged_field_costs_one_page():
    data = bytearray(made((3, 2, 8, 1, {}, b"abcdef"), (3, 2, 8, 1, {}, b"ghijkl")))
    (first,) = struct.unpack_from("<I", data, 4)
    struct.pack_into("<HHII", data, first + 2, tiff.WIDTH, 4, 1000, 1 << 30)
    assert [(p.page, p.error is None, p.pixels) for p in tiff.read(bytes(data))][1] == (1, True, b"ghijkl")


def tiled(order, width, height, bits, samples, compression, predictor, planar, tile, pixel):
    """A one-page file of tiles, put together sample by sample; ``pixel`` gives the sample at (y, x, channel)."""
    pack = lambda v: int(v).to_bytes(bits // 8, "little" if order == "<" else "big")
    tw, th = tile
    blocks = []
    for plane in range(samples) if planar == 2 else [None]:
        for y0, x0 in itertools.product(range(0, height, th), range(0, width, tw)):
            raw = b""
            channels = [plane] if planar == 2 else range(samples)
            for y in range(y0, y0 + th):
                row = [[pixel(y, x, c) if y < height and x < width else 0 for c in channels] for x in range(x0, x0 + tw)]
                if predictor == 2:
                    row = [row[0]] + [[(b - a) % (1 << bits) for a, b in zip(row[k - 1], row[k])] for k in range(1, tw)]
                if predictor == 3:
                    flat = [int(v).to_bytes(bits // 8, "big") for p in row for v in p]
                    planes = bytes(f[k] for k in range(bits // 8) for f in flat)
                    n = len(list(channels))
                    raw += planes[:n] + bytes((planes[k] - planes[k - n]) % 256 for k in range(n, len(planes)))
                else:
                    raw += b"".join(pack(v) for p in row for v in p)
            blocks.append({1: lambda d: d, 8: zlib.compress, 5: tiff.pack_lzw, 32773: tiff.pack_bits}[compression](raw))
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 0))
    places = []
    for b in blocks:
        places.append(len(out))
        out += b
    tables = len(out)
    out += struct.pack(f"{order}{len(places)}I", *places) + struct.pack(f"{order}{len(blocks)}I", *map(len, blocks))
    many = len(blocks) > 1
    tags = {256: width, 257: height, 259: compression, 277: samples, 284: planar, 317: predictor, 322: tw, 323: th, 258: bits, 324: tables if many else places[0], 325: tables + 4 * len(places) if many else len(blocks[0])}
    struct.pack_into(f"{order}I", out, 4, len(out))
    out += struct.pack(f"{order}H", len(tags))
    for tag, v in sorted(tags.items()):
        out += struct.pack(f"{order}HHII", tag, 4, len(blocks) if tag in (324, 325) else 1, v)
    return bytes(out + b"\0\0\0\0")


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("bits,predictor", [(8, 1), (8, 2), (16, 1), (16, 2), (16, 3), (32, 1), (32, 2), (32, 3)])
def test_tiles_of_an_independent_writer(order, bits, predictor):
    r = random.Random(bits * 7 + predictor)
    values = {k: r.randrange(1 << bits) for k in itertools.product(range(5), range(7), range(3))}
    want = b"".join(values[y, x, c].to_bytes(bits // 8, "little") for y, x, c in itertools.product(range(5), range(7), range(3)))
    for compression, planar in itertools.product((1, 8, 5, 32773), (1, 2)):
        (page,) = tiff.read(tiled(order, 7, 5, bits, 3, compression, predictor, planar, (4, 2), lambda y, x, c: values[y, x, c]))
        assert (page.error, page.pixels) == (None, want), (compression, planar)


def test_packed_bytes_of_the_specification():
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert tiff.unpack_bits(packed, 24).hex() == "aaaaaa80002aaaaaaaaa80002a22" + "aa" * 10
    lzw = "100000000" + "000000111" + "100000010" + "100000010" + "100000001"  # clear, 7, 258, 258, end: 7 7 7 7 7
    assert tiff.unpack_lzw(int(lzw.ljust(48, "0"), 2).to_bytes(6, "big")) == bytes([7] * 5)


def test_sizes_are_checked_before_allocation():
    big = (1 << 31) - 1
    for tags in ({tiff.WIDTH: big, tiff.HEIGHT: big}, {tiff.WIDTH: 0}, {tiff.HEIGHT: 0}, {tiff.ROWS_PER_STRIP: 0}, {tiff.SAMPLES: big}, {tiff.SAMPLES: 0}, {tiff.COMPRESSION: 8, tiff.WIDTH: big}):
        first, after = tiff.read(made((3, 2, 8, 1, tags, b"abcdef"), (3, 2, 8, 1, {}, b"ghijkl")))
        assert first.error and not first.pixels and after.pixels == b"ghijkl", tags
    for name in (tiff.TILE_WIDTH, tiff.TILE_HEIGHT):
        for value in (0, big):
            data = made((3, 2, 8, 1, {tiff.TILE_OFFSETS: 8, tiff.TILE_SIZES: 6, tiff.TILE_WIDTH: 3, tiff.TILE_HEIGHT: 2, name: value}, b"abcdef"))
            assert next(tiff.read(data)).error, (name, value)
    for cut in range(0, 200, 3):
        list(tiff.read(made((3, 2, 8, 1, {}, b"abcdef"), order=">")[:cut]))  # nothing escapes
    r = random.Random(3)
    whole = tiff.write(tiff.payload_of(b"some text " * 40), layout=tiff.Layout(">", tiff.DEFLATE, tiff.TILE))
    for _ in range(300):
        data = bytearray(whole)
        for _ in range(4):
            data[r.randrange(len(data))] = r.randrange(256)
        list(tiff.read(bytes(data)))


def test_missing_blocks_are_an_error():
    data = made((3, 4, 8, 1, {tiff.ROWS_PER_STRIP: 2}, b"abcdef"))
    assert "1 of 2 blocks" in next(tiff.read(data)).error


def brute_feature(pixels, width, height):
    at = lambda y, x, c: pixels[(y * width + x) * 3 + c]
    every = list(itertools.product(range(height), range(width)))
    sums = [sum(at(y, x, c) for y, x in every) for c in range(3)]
    squares = [sum(at(y, x, c) ** 2 for y, x in every) for c in range(3)]
    n = len(every)
    eighths = [sum(at(y, x, c) for y, x in every if x // 8 == k for c in range(3)) for k in range(8)]
    bits = "".join("1" if eighths[(k + 1) % 8] > eighths[k] else "0" for k in range(8))
    return f"{width}x{height}x3:" + ",".join(str(s // n) for s in sums) + ":" + ",".join(str((n * q - s * s) // (n * n)) for s, q in zip(sums, squares)) + f":{bits}"


def test_rows_of_the_query_against_brute_force():
    texts = [None, "", " ", "é😀 ß", "a" * 191, "b" * 192, "c" * 193, *(f"text {k} " * (7 * k + 1) for k in range(40)), "same", "same", "x y " * 9000]
    rows = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts, pa.string())})
    (got,) = tiff.digests(iter([rows]))
    seen = set()
    for row, text in zip(got.to_pylist(), texts):
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        stored = tiff.write(payload, layout=tiff.layout_of(payload))
        seen.add((stored[:2], tiff.layout_of(payload).compression))
        assert (row["n_bytes"], row["payload_bytes"], row["payload_sha256"], row["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (row["media_bytes"], row["media_sha256"], row["n_pages"]) == (len(stored), hashlib.sha256(stored).hexdigest(), 1)
        if len(payload) < 10_000:
            assert row["feature"] == brute_feature(payload, 64, len(payload) // 192), text
    assert got.to_pylist()[-3]["media_sha256"] == got.to_pylist()[-2]["media_sha256"] and len(seen) == 4


def test_no_rows(spark):
    media = spark.createDataFrame([], "media_id long, content binary, page string")
    assert tiff.pages(media).count() == 0
    clash = spark.createDataFrame([(1, bytearray(tiff.write(b"x" * 192)), "kept out")], "media_id long, content binary, page string")
    assert [(r.media_id, r.page, bytes(r.pixels)) for r in tiff.pages(clash).collect()] == [(1, 0, b"x" * 192)]
