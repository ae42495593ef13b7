"""GIF as a media column: LZW code streams, palettes, disposal, transparency, timed frames, histograms.

decode() reads any GIF87a/89a: global and local palettes, interlacing, graphic control (delay,
disposal, transparency) and LZW streams of 2 to 12 bit codes with clear codes anywhere. encode() writes
grey frames losslessly as real LZW streams.

Defined results: a null text is empty and stores one frame of filler; a text of any length is one file; repeated rows
keep a row each; a file that isn't a GIF, has a code that its table lacks, or a screen of more than MOST_PIXELS raises
ValueError in decode() and gives no further frames and an error text in frames(); a stream that ends early
leaves the rest of its frame at index 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 24
TILE = SIDE * SIDE
FULL = 4096
#: A screen, and a frame, of more pixels is refused: its size is what the file says, not what it holds.
MOST_PIXELS = 1 << 24


class Frame(NamedTuple):
    delay_ms: int
    #: The frame's own samples (height x width) and the canvas once it is drawn (height x width x RGBA).
    samples: np.ndarray
    canvas: np.ndarray


@lru_cache(maxsize=64)
def _widths(first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    width = np.array([min(12, max((first - 1).bit_length(), (first + j - 1).bit_length() if j else 0)) for j in range(n)], np.int64)
    return np.concatenate([[0], np.cumsum(width)]), (1 << width) - 1


def _layout(first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit offset (and the end of all) and mask of n codes after a clear code; first: the first free code.

    A code's width follows from its place alone: the table has first + j - 1 entries before code j > 0.
    """
    offset, mask = _widths(first, max(1024, 1 << n.bit_length()))
    return offset[: n + 1], mask[:n]


_GREY = bytes(x for i in range(256) for x in (i, i, i))
#: Colours of text bytes: red of the low three bits, green of the middle ones, blue of the high two.
_COLOURS = bytes(x for i in range(256) for x in ((i & 7) * 36, (i >> 3 & 7) * 36, (i >> 6) * 85))
_ROOTS = [bytes((i,)) for i in range(256)]


def _runs(data: bytes, first: int) -> list[list[int]]:
    """Codes of one stream, without the clear code that leads: runs that end in a clear code, the last in the end code."""
    clear = first - 2
    runs, codes, table = [], [], {}
    put, get = codes.append, table.get
    last, room = first - 1, FULL - first - 1
    w = data[0] if data else None
    for b in data[1:]:
        k = w, b
        if (c := get(k)) is not None:
            w = c
            continue
        put(w)
        w = b
        table[k] = last + len(codes)
        if len(codes) > room:  # clear before the table is full
            runs.append(codes + [clear])
            codes = []
            put = codes.append
            table.clear()
    if w is not None:
        put(w)
    put(clear + 1)
    return [*runs, codes]


def lzw_encode(frames: list[bytes], bits: int = 8) -> list[bytes]:
    """A stream of each; the codes of all are packed together."""
    clear, first, width = 1 << bits, (1 << bits) + 2, bits + 1
    by_frame = [_runs(x, first) for x in frames]
    runs = [r for x in by_frame for r in x]
    n = np.fromiter(map(len, by_frame), np.int64, len(by_frame))
    sizes = np.fromiter(map(len, runs), np.int64, len(runs))
    offset, _ = _layout(first, int(sizes.max()))
    length = offset[sizes]
    lead = np.cumsum(n) - n
    total = (width + np.add.reduceat(length, lead) + 7) // 8
    start = np.cumsum(total) - total
    before = np.cumsum(length) - length
    base = before - np.repeat(before[lead], n) + np.repeat(8 * start + width, n)
    codes = np.fromiter(chain.from_iterable(runs), np.int64, int(sizes.sum()))
    index = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = offset[index] + np.repeat(base, sizes)
    value, byte = codes << (place & 7), place >> 3
    whole = sum(np.bincount(byte + i, value >> 8 * i & 255, int(total.sum()) + 3) for i in range(3))
    whole[start] += clear & 255
    whole[start + 1] += clear >> 8
    packed = whole.astype(np.uint8).tobytes()
    return [packed[s:e] for s, e in zip(start.tolist(), (start + total).tolist(), strict=True)]


def lzw_decode(stream: bytes, bits: int, n: int) -> bytes:
    """n samples; what the stream lacks is 0."""
    clear, end, first = 1 << bits, (1 << bits) + 1, (1 << bits) + 2
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    out: list[bytes] = []
    at, limit, done = 0, 8 * len(stream), 0
    while at < limit and done < n:
        # all codes up to the next clear code: at most FULL + what a full table is followed by
        m = min(limit - at, n - done + 2)
        offset, mask = _layout(first, m)
        offset, mask = offset[:m] + at, mask[:m]
        fits = int(np.searchsorted(offset, limit - bits))
        offset, mask = offset[:fits], mask[:fits]
        byte = offset >> 3
        codes = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (offset & 7) & mask
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else len(codes)
        if stop:
            # the table's entry c is what code c - first gave, and the first sample of what came next
            run: list[bytes] = []
            add = run.append
            for c in codes[:stop].tolist():
                if c < clear:
                    add(_ROOTS[c])
                    continue
                if c - first >= len(run):
                    raise ValueError(f"code {c} is not in the table")
                entry = run[c - first]
                try:
                    add(entry + run[c - first + 1][:1])
                except IndexError:
                    add(entry + entry[:1])
            out += run
            done += sum(map(len, run))
        if stop == len(codes) or codes[stop] == end:
            break
        at = int(offset[stop]) + int(mask[stop]).bit_length()
    return b"".join(out)[:n].ljust(n, b"\0")


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes((len(x),)) + x for i in range(0, len(data), 255) if (x := data[i : i + 255])) + b"\0"


def encode(frames: list[bytes], width: int, height: int, delay_cs: int = 4, palette: bytes = _GREY, clear: int | None = None, disposals: tuple[int, ...] = (1,)) -> bytes:
    """Frames of 8-bit samples, each the size of the screen. clear: the sample that is transparent; disposals: of the
    frames in turn."""
    parts = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette, b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    control = [b"\x21\xf9\x04" + struct.pack("<BHBB", d << 2 | (clear is not None), delay_cs, clear or 0, 0) for d in disposals]
    image = b"\x2c" + struct.pack("<HHHHB", 0, 0, width, height, 0) + b"\x08"
    for k, x in enumerate(lzw_encode(frames)):
        parts += [control[k % len(control)], image, _blocks(x)]
    return b"".join([*parts, b"\x3b"])


def decode(media: bytes) -> Iterator[Frame]:
    if media[:6] not in (b"GIF87a", b"GIF89a") or len(media) < 13:
        raise ValueError("not a GIF")
    width, height, flags, back = struct.unpack_from("<HHBB", media, 6)
    if width * height > MOST_PIXELS:
        raise ValueError(f"a screen of {width} x {height}")
    at = 13

    def palette(flags: int) -> np.ndarray | None:
        nonlocal at
        if not flags & 0x80:
            return None
        n = 2 << (flags & 7)
        table = np.full((256, 4), 255, np.uint8)
        table[:n, :3] = np.frombuffer(media, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
        return table

    def data() -> bytes:
        nonlocal at
        parts = []
        while at < len(media) and (n := media[at]):
            parts.append(media[at + 1 : at + 1 + n])
            at += n + 1
        at += 1
        return b"".join(parts)

    common = palette(flags)
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, clear = 0, 0, None
    while at < len(media) and (kind := media[at]) != 0x3B:
        at += 1
        if kind == 0x21:
            label = media[at]
            at += 1
            body = data()
            if label == 0xF9 and len(body) >= 4:
                bits, delay, index = struct.unpack_from("<BHB", body)
                disposal, clear = bits >> 2 & 7, index if bits & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError(f"unknown block {kind}")
        x, y, w, h, bits = struct.unpack_from("<HHHHB", media, at)
        at += 9
        if w * h > MOST_PIXELS:
            raise ValueError(f"a frame of {w} x {h}")
        own = palette(bits)
        own = common if own is None else own
        size = media[at]
        at += 1
        samples = np.frombuffer(lzw_decode(data(), size, w * h), np.uint8).reshape(h, w)
        if bits & 0x40:
            rows = [r for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(start, h, step)]
            plain = np.empty_like(samples)
            plain[rows] = samples
            samples = plain
        before = canvas.copy() if disposal == 3 else None
        colours = own[samples] if own is not None else np.repeat(samples[..., None], 4, 2)
        if (x, y, w, h) == (0, 0, width, height) and (clear is None or not (samples == clear).any()):
            canvas = colours
        else:
            canvas = canvas.copy()
            part, seen = canvas[y : y + h, x : x + w], colours[: max(0, height - y), : max(0, width - x)]
            shown = np.ones(seen.shape[:2], bool) if clear is None else samples[: seen.shape[0], : seen.shape[1]] != clear
            part[shown] = seen[shown]
        yield Frame(delay * 10, samples, canvas)
        if disposal == 2:
            canvas = canvas.copy()
            canvas[y : y + h, x : x + w] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, clear = 0, 0, None


def histogram(canvas: np.ndarray, bins: int = 4) -> list[int]:
    """Pixels by colour: bins (a power of two, up to 4) of red times bins of green times bins of blue; transparent ones
    are left out."""
    width = bins.bit_length() - 1
    red, green, blue = (canvas[..., k] >> (8 - width) for k in range(3))
    cell = red << 2 * width | green << width | blue
    seen = canvas[..., 3] > 0
    return np.bincount(cell.ravel() if seen.all() else cell[seen], minlength=bins**3).tolist()


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes, filled with 255 up to a positive multiple of TILE, and their number before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // TILE)) * TILE, b"\xff"), len(raw)


def store(payload: bytes) -> bytes:
    """An animation of SIDE x SIDE coloured frames, one for each TILE bytes.

    Frames are kept, cleared to the background or taken back in turn (they cover the screen, so none shows in the next);
    sample 0 is transparent, so the few texts that hold it show the canvas there.
    """
    return encode([payload[i : i + TILE] for i in range(0, len(payload), TILE)], SIDE, SIDE, palette=_COLOURS, clear=0, disposals=(1, 2, 3))


def to_media(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes and media (the stored GIF) of each text."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):  # a file at a time: texts may be very long
                payload, n = payload_of(t.as_py())
                yield pa.record_batch([pa.array([i.as_py()], b.schema[0].type), pa.array([n]), pa.array([store(payload)], pa.binary())], names=[key, "n_bytes", "media"])

    return texts.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes long, media binary")


def frames(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row per timed frame: key, frame, delay_ms, width, height, samples, hist, error."""
    kind = media.schema[key].dataType.simpleString()
    names = [key, "frame", "delay_ms", "width", "height", "samples", "hist", "error"]

    def rows(i, data):
        try:
            for n, f in enumerate(decode(data or b"")):
                yield i, n, f.delay_ms, f.samples.shape[1], f.samples.shape[0], f.samples.tobytes(), histogram(f.canvas), None
        except (ValueError, IndexError, struct.error) as e:
            yield i, None, None, None, None, None, None, str(e)

    def run(batches):
        for b in batches:
            types = [b.schema[0].type, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.string()]
            for i, data in zip(b.column(0), b.column(1), strict=True):
                held = []
                for row in rows(i.as_py(), data.as_py()):
                    held.append(row)
                    if len(held) == 1000:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
                        held = []
                if held:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    return media.select(key, "media").mapInArrow(run, f"`{key}` {kind}, frame int, delay_ms int, width int, height int, samples binary, hist array<long>, error string")


def media_digest(text: str | None) -> tuple:
    """Store, read back, describe."""
    payload, n = payload_of(text)
    media = store(payload)
    parts, shown, ms = [], [], 0
    hist = np.zeros(64, np.int64)
    for f in decode(media):
        parts.append(f.samples.tobytes())
        shown.append(f.canvas)
        ms += f.delay_ms
        if len(shown) == 64:  # colours of many canvases are counted together
            hist += histogram(np.stack(shown))
            shown.clear()
    if shown:
        hist += histogram(np.stack(shown))
    back = b"".join(parts)
    feature = f"frames={len(parts)};ms={ms};hist={','.join(map(str, hist.tolist()))}"
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature


def media_digests(documents: DataFrame) -> DataFrame:
    """The digest columns of the query; the stored form is made and read in one pass and not moved."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for b in batches:
            out = [media_digest(t.as_py()) for t in b.column(1)]
            cols = zip(*out, strict=True) if out else [()] * len(types)
            yield pa.record_batch([b.column(0), *(pa.array(list(c), t) for c, t in zip(cols, types, strict=True))], names=names)

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return documents.select("doc_id", F.col("text")).mapInArrow(run, schema)
