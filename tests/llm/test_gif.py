import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from bookloom.llm import gif


def plain_lzw(codes, bits):
    """Packs (code, width) pairs, least bit first."""
    n = at = 0
    for code, width in codes:
        n |= code << at
        at += width
    return n.to_bytes((at + 7) // 8, "little")


@pytest.mark.parametrize("n", [0, 1, 2, 575, 576, 577, 5000, 60000])
def test_lzw_round_trip(n):
    rng = random.Random(n)
    for data in (rng.randbytes(n), bytes(rng.choices(b"ab", k=n)), b"a" * n):
        assert gif.lzw_decode(gif.lzw_encode([data])[0], 8, n) == data
    small = bytes(rng.choices(range(4), k=n))
    assert gif.lzw_decode(gif.lzw_encode([small], 2)[0], 2, n) == small


def test_decodes_streams_of_others():
    # clear, 1, then the code that is being made (6), clear again, 2, 3, end
    stream = plain_lzw([(4, 3), (1, 3), (6, 3), (4, 3), (2, 3), (3, 3), (5, 3)], 2)
    assert gif.lzw_decode(stream, 2, 5) == bytes([1, 1, 1, 2, 3])
    assert gif.lzw_decode(stream[:1], 2, 5) == bytes([1, 0, 0, 0, 0])  # it ends early


def image(x, y, w, h, samples, flags=0, palette=b""):
    return b"\x2c" + struct.pack("<HHHHB", x, y, w, h, flags) + palette + b"\x02" + gif._blocks(gif.lzw_encode([samples], 2)[0])


def control(disposal, clear=None, delay=7):
    return b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (clear is not None), delay, clear or 0, 0)


def test_disposal_transparency_palettes_interlace():
    table = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    own = bytes([9, 9, 9] * 4)
    head = b"GIF89a" + struct.pack("<HHBBB", 4, 4, 0x81, 0, 0) + table
    media = head + b"\x21\xfe\x02hi\x00" + b"".join([
        control(1) + image(0, 0, 4, 4, bytes([1] * 16)),
        control(3, clear=0) + image(1, 1, 2, 2, bytes([2, 0, 0, 2])),
        control(2) + image(0, 0, 2, 2, bytes([3] * 4)),
        image(3, 3, 1, 1, bytes([0]), 0x81, own),
        image(0, 0, 1, 4, bytes([0, 2, 1, 3]), 0x40),
    ]) + b"\x3b"
    f = list(gif.decode(media))
    assert [x.delay_ms for x in f] == [70, 70, 70, 0, 0]
    red, green, blue = ([255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255])
    assert f[0].canvas[2, 2].tolist() == red
    assert f[1].canvas[1, 1].tolist() == green and f[1].canvas[1, 2].tolist() == red  # seen through
    assert f[2].canvas[1, 1].tolist() == blue and f[2].canvas[2, 2].tolist() == red  # the one before was undone
    assert f[3].canvas[0, 0].tolist() == [0, 0, 0, 0] and f[3].canvas[3, 3].tolist() == [9, 9, 9, 255]
    assert f[4].samples[:, 0].tolist() == [0, 1, 2, 3]


def test_payload_round_trip_and_digests(spark, odd_documents, no_documents):
    got = {}
    for r in gif.media_digests(odd_documents).collect():
        got.setdefault(r.doc_id, r)
    for r in odd_documents.collect():
        raw = (r.text or "").encode()
        padded = raw.ljust(max(576, -(-len(raw) // 576) * 576), b"\xff")
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
    assert gif.media_digests(no_documents).count() == 0
    media = gif.to_media(odd_documents)
    rows = gif.frames(media.where("doc_id = 6")).collect()
    assert b"".join(bytes(r.samples) for r in sorted(rows, key=lambda r: r.frame))[:600] == ("é" * 300).encode()
    assert all(sum(r.hist) == 576 for r in rows)


def test_files_that_are_no_gif(spark):
    bad = spark.createDataFrame([(1, bytearray(b"PNG")), (2, None)], "doc_id long, media binary")
    assert [r.error for r in gif.frames(bad).collect()] == ["not a GIF"] * 2
    with pytest.raises(ValueError):
        list(gif.decode(b""))
    assert gif.histogram(np.full((2, 2, 4), 255, np.uint8)) == [0] * 63 + [4]
    some = np.array([[[255, 0, 0, 255], [0, 255, 0, 255]], [[0, 0, 200, 255], [0, 0, 0, 0]]], np.uint8)
    assert {k: n for k, n in enumerate(gif.histogram(some)) if n} == {48: 1, 12: 1, 3: 1}
    huge = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0)
    with pytest.raises(ValueError, match="a screen of"):
        list(gif.decode(huge))
    with pytest.raises(ValueError, match="not in the table"):
        gif.lzw_decode(plain_lzw([(4, 3), (1, 3), (7, 3), (5, 3)], 2), 2, 9)


def test_stored_texts_use_palette_disposal_and_transparency():
    payload = b"abc\0".ljust(3 * gif.TILE, b"\xff")
    media = gif.store(payload)
    f = list(gif.decode(media))
    assert b"".join(x.samples.tobytes() for x in f) == payload and len(f) == 3
    assert f[0].canvas[0, 0].tolist() == [36, 144, 85, 255] and f[0].canvas[0, 3].tolist() == [0, 0, 0, 0]  # colour of a; NUL is seen through
    assert [media[i + 3] for i in range(len(media)) if media[i : i + 3] == b"\x21\xf9\x04"] == [1 << 2 | 1, 2 << 2 | 1, 3 << 2 | 1]
    want = np.zeros(64, int)
    for x in f:
        want += gif.histogram(x.canvas)
    assert gif.media_digest(payload.rstrip(b"\xff").decode("latin1"))[-1].startswith("frames=1;ms=40;hist=") and want.sum() == 3 * gif.TILE - 1
