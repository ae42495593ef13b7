"""Repeated passages across documents by blockwise suffix sorting with a difference cover.

Every byte of a document that a WINDOW-byte string covers which also starts in a document of a smaller
id is removed. Only suffixes that can share a window with another document are sorted, one bucket at a
time:

1. blocks: documents are gathered into compressed blocks of about BLOCK bytes, written once.
2. anchors: of each window the least GRAM-byte string by hash is its anchor, so equal windows have equal
   anchors at equal places. Each block tells the anchors it has; those of two documents or more are shared.
3. contexts: a shared anchor's windows travel as one text of at most LONG bytes, the anchor's context, to the
   bucket of the anchor. Equal contexts meet before they travel (in their block, then, where there are more than
   FAN blocks, in groups of FAN): those of larger ids are settled there, so a passage that all blocks hold
   reaches its bucket from few of them.
4. suffix buckets: a bucket sorts the suffixes at all windows of its anchors' differing contexts, a slice of
   whole anchors at a time. Ranks of the slice's cover sample (places outside multiples of 3, a difference cover
   of period 3) are made first, by doubling up to WINDOW bytes; then suffixes of the other places are ordered by one
   or two bytes and the rank of the cover place behind them, so no comparison ever runs through a long tie.
   Neighbours that agree in WINDOW bytes form a class, and every window of a class is removed but those of its
   smallest id.
5. cuts go back to the blocks, where runs are merged.

Contexts have fixed rows of bytes, so a bucket is a few arrays. Memory is bounded by blocks, buckets and slices;
only an anchor whose contexts all differ needs them in one task. Hashes choose what is compared; equality is
always decided on bytes.

Defined results: a null text is empty; texts below WINDOW bytes stay whole; a text above BLOCK bytes is a block of
its own and read in steps; documents of one id do not cut each other; null ids count as larger than all; repeated
rows keep a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize

WINDOW, GRAM = 50, 24
#: Bytes of texts in a block, of texts for each bucket, of windows read at once, of contexts sorted at once.
BLOCK, BUCKET, STEP, SLICE = 1 << 20, 8 << 20, 1 << 20, 1 << 20
#: Blocks whose contexts meet in one group.
FAN = 4096
#: The most bytes that windows with one anchor cover, and those of a context's row.
LONG = 2 * WINDOW - GRAM
ROW = -(-LONG // 8) * 8
_LAST = np.iinfo(np.int64).max
_U = np.uint64


def gram_hashes(raw: np.ndarray, k: int = GRAM) -> np.ndarray:
    """A mixed 64-bit hash of the k bytes from each place; strings are put together by doubling."""
    h, size, power = raw.astype(_U) + _U(1), 1, 0x9E3779B97F4A7C15
    out, done = None, 0
    while True:
        if k & size:
            if out is None:
                out, done = h, size
            else:
                m = len(raw) - done - size + 1
                out, done = out[:m] * _U(power) + h[done : done + m], done + size
        if 2 * size > k:
            break
        m = len(h) - size
        h, size, power = h[:m] * _U(power) + h[size : size + m], 2 * size, power * power % (1 << 64)
    out = (out ^ (out >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    out = (out ^ (out >> _U(32))) * _U(0x94D049BB133111EB)
    return out ^ (out >> _U(29))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = 1
    while 2 * n <= w:
        x, n = np.minimum(x[:-n], x[n:]), 2 * n
    return np.minimum(x[: len(x) - (w - n)], x[w - n :]) if n < w else x


def anchors(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hash (48 bits), first window and number of windows of each run of windows with one anchor.

    raw: texts one after the other; ends: where each ends. No window goes over an end.
    """
    found = []
    for s in range(0, max(0, len(raw) - WINDOW + 1), STEP):
        part = raw[s : s + STEP + WINDOW - 1]
        h = gram_hashes(part)
        place = np.arange(len(h), dtype=_U)
        least = _sliding_min(h & ~_U(0xFFFFFF) | place, WINDOW - GRAM + 1)
        at = (least & _U(0xFFFFFF)).astype(np.int64)
        start = np.arange(s, s + len(at))
        valid = np.flatnonzero(start + WINDOW <= ends[np.searchsorted(ends, start, side="right")])
        if not len(valid):
            continue
        first = np.flatnonzero(np.concatenate([[True], (at[valid[1:]] != at[valid[:-1]]) | (valid[1:] != valid[:-1] + 1)]))
        found.append((h[at[valid[first]]] >> _U(16), valid[first] + s, np.diff(np.append(first, len(valid)))))
    if not found:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def window_classes(rows: np.ndarray, windows: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each window of each context in turn: the smallest id among contexts that have the window.

    rows: contexts of ROW bytes, filled with 0; windows: how many each has.
    """
    text = np.concatenate([rows.ravel(), np.zeros(2 * WINDOW, np.uint8)])
    n = rows.size
    owner = np.repeat(np.arange(len(rows)), windows)
    starts = np.arange(len(owner)) + np.repeat(ROW * np.arange(len(rows)) - (np.cumsum(windows) - windows), windows)
    # ranks of the cover's suffixes, in 8, 14, 26, then 50 bytes
    words = text.astype(_U)
    for b in (1, 2, 4):
        words = words[:-b] << _U(8 * b) | words[b:]
    cover = np.flatnonzero(np.arange(n + 2) % 3)
    rank = np.zeros(n + 2 * WINDOW, np.int64)
    rank[cover] = np.unique(words[cover], return_inverse=True)[1] + 1
    for step in (6, 12, 24):
        key = rank[cover] << 32 | rank[cover + step]
        rank[cover] = np.unique(key, return_inverse=True)[1] + 1
    byte = text.astype(np.int64)
    kind = starts % 3
    covered, rest = np.flatnonzero(kind), np.flatnonzero(kind == 0)
    covered = covered[np.argsort(rank[starts[covered]], kind="stable")]
    one = lambda i: byte[i] << 32 | rank[i + 1]
    two = lambda i: (byte[i] << 8 | byte[i + 1]) << 32 | rank[i + 2]
    rest = rest[np.argsort(one(starts[rest]), kind="stable")]
    # a suffix outside the cover meets those at 1 mod 3 one byte on, those at 2 mod 3 two bytes on
    i, c = starts[rest], starts[covered]
    before = np.searchsorted(one(c[c % 3 == 1]), one(i)) + np.searchsorted(two(c[c % 3 == 2]), two(i))
    place = np.arange(len(rest)) + np.maximum.accumulate(before) if len(rest) else rest
    order = np.empty(len(starts), np.int64)
    order[place] = rest
    free = np.ones(len(starts), bool)
    free[place] = False
    order[free] = covered
    # neighbours that agree in WINDOW bytes
    p, q = starts[order[:-1]], starts[order[1:]]
    same = np.ones(len(p), bool)
    for d in (*range(0, WINDOW - 8, 8), WINDOW - 8):
        same &= words[p + d] == words[q + d]
    new = np.concatenate([[True], ~same])
    least = np.minimum.reduceat(docs[owner[order]], np.flatnonzero(new))
    out = np.empty(len(starts), np.int64)
    out[order] = least[np.cumsum(new) - 1]
    return out


class Contexts(NamedTuple):
    """anchor, document, block, first window and number of windows of each context, and its bytes in a row."""

    anchor: np.ndarray
    doc: np.ndarray
    block: np.ndarray
    first: np.ndarray
    n: np.ndarray
    rows: np.ndarray

    def take(self, i) -> Contexts:
        return Contexts(*(x[i] for x in self))

    def pack(self) -> bytes:
        return _zip(*(np.ascontiguousarray(x.astype(k)).tobytes() for x, k in zip(self, _KINDS, strict=True)))


_KINDS = ("<u8", "<i8", "<i8", "<i8", "u1", "u1")
_MIX = np.random.default_rng(50).integers(1, 1 << 63, ROW // 8, np.uint64) | _U(1)


def _unpack(bodies: list[bytes]) -> Contexts:
    parts = list(zip(*map(_unzip, bodies), strict=True)) or [()] * len(_KINDS)
    *cols, rows = (np.concatenate([np.zeros(0, k), *(np.frombuffer(x, k) for x in p)]) for p, k in zip(parts, _KINDS, strict=True))
    cols[-1] = cols[-1].astype(np.int64)
    return Contexts(*cols, rows.astype(np.uint8).reshape(-1, ROW))


def _rows(raw: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The bytes of contexts."""
    out = np.zeros((len(first), ROW), np.uint8)
    place = np.arange(ROW)
    for s in range(0, len(first), 1 << 14):
        f, size = first[s : s + (1 << 14), None], n[s : s + (1 << 14), None] + WINDOW - 1
        out[s : s + (1 << 14)] = np.where(place < size, raw[np.minimum(f + place, len(raw) - 1)], 0)
    return out


def _alike(c: Contexts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order in which equal contexts are neighbours of rising ids, the number of each one's class, and the place in
    that order where each class begins. Contexts are alike if their bytes are; digests only bring them together."""
    words = np.ascontiguousarray(c.rows).view("<u8")
    digest = (words * _MIX).sum(1, dtype=_U) ^ c.anchor
    order = np.lexsort([c.doc, digest])
    a = words[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]).any(1) | (c.n[order[1:]] != c.n[order[:-1]]) | (c.anchor[order[1:]] != c.anchor[order[:-1]])
    return order, np.cumsum(new) - 1, np.flatnonzero(new)


def _settle(c: Contexts) -> tuple[Contexts, Contexts]:
    """Contexts of their class's smallest id, and the others: all their windows are removed."""
    order, number, lead = _alike(c)
    more = c.doc[order] > c.doc[order[lead]][number]
    return c.take(np.sort(order[~more])), c.take(order[more])


def _by(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value and the places that have it."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    edges = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]])) if len(k) else []
    for s, e in zip(edges[:-1], edges[1:], strict=True):
        yield int(k[s]), order[s:e]


def _cut_rows(block: np.ndarray, first: np.ndarray, n: np.ndarray) -> list[tuple[int, bytes]]:
    """block and cut of runs of removed windows."""
    runs = np.stack([first, n], 1).astype("<i8")
    return [(k, runs[i].tobytes()) for k, i in _by(block)]


def _sorted_cuts(c: Contexts) -> list[tuple[int, bytes]]:
    """Cuts of a bucket: by equal contexts, then by sorting the suffixes at windows of anchors with several."""
    if not len(c.doc):
        return []
    order, number, lead = _alike(c)
    least = c.doc[order[lead]]
    more = c.doc[order] > least[number]
    i = order[more]
    block, first, n = [c.block[i]], [c.first[i]], [c.n[i]]
    # the class's first context stands for it
    one = order[lead]
    by_anchor = np.argsort(c.anchor[one], kind="stable")
    anchor = c.anchor[one][by_anchor]
    edges = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1], [True]]))
    several = np.flatnonzero(np.diff(edges) > 1)  # an anchor with one context alone has nothing to sort
    # members of each class that are of its smallest id, in order of classes
    kept = order[~more]
    kept_at = np.searchsorted(number[~more], np.arange(len(lead) + 1))
    sizes = np.diff(edges)[several] * ROW
    slices = (np.cumsum(sizes) - sizes) // SLICE
    for _, at in _by(slices):
        group = np.concatenate([by_anchor[edges[k] : edges[k + 1]] for k in several[at].tolist()])
        windows = c.n[one[group]]
        smaller = window_classes(c.rows[one[group]], windows, least[group]) < np.repeat(least[group], windows)
        # runs of removed windows, none over a context's end; then for every member
        begin = np.cumsum(windows) - windows
        owner = np.repeat(np.arange(len(group)), windows)
        edge = np.ones(len(smaller) + 1, bool)
        edge[1:-1] = (smaller[1:] != smaller[:-1]) | (owner[1:] != owner[:-1])
        edge = np.flatnonzero(edge)
        start = edge[:-1][smaller[edge[:-1]]]
        length = np.diff(edge)[smaller[edge[:-1]]]
        of = group[owner[start]]
        many = kept_at[of + 1] - kept_at[of]
        run = np.repeat(np.arange(len(start)), many)
        member = kept[np.arange(len(run)) + np.repeat(kept_at[of] - (np.cumsum(many) - many), many)]
        block.append(c.block[member])
        first.append(c.first[member] + (start - begin[owner[start]])[run])
        n.append(length[run])
    return _cut_rows(*map(np.concatenate, (block, first, n)))


def _pack48(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack48(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _zip(*parts: bytes) -> bytes:
    head = np.array([len(parts), *map(len, parts)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def _unzip(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes = np.frombuffer(raw, "<i8", n, 8)
    at = 8 * (n + 1) + np.concatenate([[0], np.cumsum(sizes)])
    return [raw[s:e] for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


_BLOCK = "block long, data binary"


def blocks(documents: DataFrame) -> DataFrame:
    """block and data: ids, a mask of null ids, ends and texts of about BLOCK bytes of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId() << 32, 0
        ids: list[int | None] = []
        texts: list[bytes] = []
        held = 0

        def flush():
            nonlocal n, held
            known = np.array([i is not None for i in ids])
            key = np.array([i if i is not None else _LAST for i in ids], "<i8")
            ends = np.cumsum([len(t) for t in texts]).astype("<i8")
            data = _zip(key.tobytes(), known.tobytes(), ends.tobytes(), b"".join(texts))
            n += 1
            ids.clear()
            texts.clear()
            held = 0
            return pa.record_batch([pa.array([part | n]), pa.array([data], pa.binary())], names=["block", "data"])

        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):
                ids.append(i.as_py())
                texts.append((t.as_py() or "").encode("utf-8", "surrogatepass"))
                held += len(texts[-1])
                if held >= BLOCK:
                    yield flush()
        if ids:
            yield flush()

    return documents.select("doc_id", "text").mapInArrow(run, _BLOCK)


def _open(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    ids, known, ends, raw = _unzip(data)
    return np.frombuffer(ids, "<i8"), np.frombuffer(known, bool), np.frombuffer(ends, "<i8"), raw


def _shared_anchors(held: DataFrame, buckets: int) -> DataFrame:
    """block, note: the block's anchors that two documents have, by bucket of anchors."""

    def tell(batches):
        for batch in batches:
            for block, data in zip(*batch.columns, strict=True):
                ids, _, ends, raw = _open(data.as_py())
                h, first, _ = anchors(np.frombuffer(raw, np.uint8), ends)
                doc = np.searchsorted(ends, first, side="right")
                order = np.lexsort([doc, h])
                h, doc = h[order], doc[order]
                new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
                lead = np.flatnonzero(new)
                h, many = h[lead], np.maximum.reduceat(doc, lead) != doc[lead] if len(lead) else np.zeros(0, bool)
                to = (h >> _U(8)) % _U(buckets)
                order = np.argsort(to, kind="stable")
                cuts = np.searchsorted(to[order], np.arange(buckets + 1, dtype=_U))
                rows = [(k, order[s:e]) for k, (s, e) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if e > s]
                yield pa.record_batch([
                    pa.array([k for k, _ in rows], pa.int32()), pa.array([block.as_py()] * len(rows), pa.int64()),
                    pa.array([_pack48(h[i]) for _, i in rows], pa.binary()), pa.array([np.packbits(many[i]).tobytes() for _, i in rows], pa.binary()),
                ], names=["bucket", "block", "anchors", "many"])

    def meet(t: pa.Table) -> pa.Table:
        lists = [_unpack48(x) for x in t.column("anchors").to_pylist()]
        many = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(x)).astype(bool) for m, x in zip(t.column("many").to_pylist(), lists, strict=True)]
        h, m = np.concatenate(lists), np.concatenate(many)
        order = np.argsort(h)
        s = h[order]
        twice = np.zeros(len(s), bool)
        twice[1:] = s[1:] == s[:-1]
        twice[:-1] |= s[:-1] == s[1:]
        shared = np.zeros(len(h), bool)
        shared[order] = twice
        shared |= m
        at = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        notes = [_pack48(x[shared[i:j]]) for x, i, j in zip(lists, at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return pa.table({"block": t.column("block"), "note": pa.array(notes, pa.binary())})

    told = held.mapInArrow(tell, "bucket int, block long, anchors binary, many binary")
    return told.groupBy("bucket").applyInArrow(meet, "block long, note binary")


_SENT = "bucket int, block long, settled boolean, body binary"


def _sent(rows: list[tuple[int, int, bool, bytes]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [()] * 4
    return pa.table({c: pa.array(x, t) for c, x, t in zip(("bucket", "block", "settled", "body"), cols, (pa.int32(), pa.int64(), pa.bool_(), pa.binary()), strict=True)})


def _settled(rows: list[tuple[int, bytes]], buckets: int) -> list[tuple[int, int, bool, bytes]]:
    """Cuts that are decided; they go through any bucket."""
    return [(block % buckets, block, True, cut) for block, cut in rows]


def _cuts(held: DataFrame, shared: DataFrame, buckets: int) -> DataFrame:
    """block, cut: runs of removed windows (first, number), by places in the block's texts."""

    def contexts(key, left: pa.Table, right: pa.Table) -> pa.Table:
        block, out = key[0].as_py(), []
        notes = right.column("note").to_pylist()
        shared_here = np.unique(np.concatenate([_unpack48(x) for x in notes])) if notes else np.zeros(0, _U)
        for data in left.column("data").to_pylist():
            ids, _, ends, text = _open(data)
            raw = np.frombuffer(text, np.uint8)
            h, first, n = anchors(raw, ends)
            keep = shared_here[np.searchsorted(shared_here, h).clip(max=len(shared_here) - 1)] == h if len(shared_here) else np.zeros(len(h), bool)
            h, first, n = h[keep], first[keep], n[keep]
            if not len(h):
                continue
            doc = ids[np.searchsorted(ends, first, side="right")]
            sent, done = _settle(Contexts(h, doc, np.full(len(h), block), first, n, _rows(raw, first, n)))
            to = ((sent.anchor >> _U(8)) % _U(buckets)).astype(np.int64)
            out += [(k, block, False, sent.take(i).pack()) for k, i in _by(to)]
            out += _settled(_cut_rows(done.block, done.first, done.n), buckets)
        return _sent(out)

    def merge(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        bucket, group = (x.as_py() for x in key)
        rows = list(zip(*(t.column(c).to_pylist() for c in ("block", "settled", "body")), strict=True))
        kept, done = _settle(_unpack([body for _, settled, body in rows if not settled]))
        out = [(bucket, block, True, body) for block, settled, body in rows if settled]
        out += [(bucket, group, False, kept.pack())] if len(kept.doc) else []
        return _sent(out + _settled(_cut_rows(done.block, done.first, done.n), buckets))

    def sort_bucket(t: pa.Table) -> pa.Table:
        rows = list(zip(*(t.column(c).to_pylist() for c in ("block", "settled", "body")), strict=True))
        out = [(block, body) for block, settled, body in rows if settled]
        out += _sorted_cuts(_unpack([body for _, settled, body in rows if not settled]))
        to, cuts = zip(*out, strict=True) if out else ((), ())
        return pa.table({"block": pa.array(to, pa.int64()), "cut": pa.array(cuts, pa.binary())})

    sent = held.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(contexts, _SENT)
    groups = held.count()
    while groups > FAN:
        groups = -(-groups // FAN)
        sent = sent.withColumn("group", F.when(F.col("settled"), F.lit(0)).otherwise(F.pmod(F.xxhash64("block"), F.lit(groups))).cast("long"))
        sent = sent.groupBy("bucket", "group").applyInArrow(merge, _SENT)
    return sent.groupBy("bucket").applyInArrow(sort_bucket, "block long, cut binary")


def removed_runs(size: int, cuts: list[bytes]) -> np.ndarray:
    """Start and end of each maximal removed run of a block's bytes."""
    runs = np.concatenate([np.frombuffer(x, "<i8") for x in cuts]).reshape(-1, 2) if cuts else np.zeros((0, 2), np.int64)
    level = np.zeros(size + 1, np.int64)
    np.add.at(level, runs[:, 0], 1)
    np.add.at(level, runs.sum(1) + WINDOW - 1, -1)
    gone = np.cumsum(level)[:-1] > 0
    return np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]))).reshape(-1, 2)


def find_cuts(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """blocks() of the documents, written, and their cuts."""
    held = materialize(blocks(documents), "blocks")
    size = documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(8, -(-size // BUCKET))
    shared = materialize(_shared_anchors(held, buckets), "anchors")
    cuts = materialize(_cuts(held, shared, buckets), "cuts")
    discard(shared)
    return held, cuts


def cut_texts(documents: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, kept text (or its digest columns) of every document."""
    held, cuts = find_cuts(documents)

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for data in left.column("data").to_pylist():
            ids, known, ends, raw = _open(data)
            runs = removed_runs(len(raw), right.column("cut").to_pylist())
            starts = np.concatenate([[0], ends[:-1]]).tolist()
            # runs of texts that touch are one here
            for i, ok, s, e in zip(ids.tolist(), known.tolist(), starts, ends.tolist(), strict=True):
                j, k = np.searchsorted(runs[:, 1], s, side="right"), np.searchsorted(runs[:, 0], e, side="left")
                own = [(max(s, a), min(e, b)) for a, b in runs[j:k].tolist()] if e > s else []
                edges = [s, *(x for r in own for x in r), e]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                tail = (e - s, e - s - len(kept), len(own), hashlib.sha256(kept).hexdigest()) if digest else (kept,)
                rows.append((i if ok else None, *tail))
        cols = list(zip(*rows, strict=True)) if rows else [()] * (5 if digest else 2)
        if not digest:
            return pa.table({"doc_id": pa.array(cols[0], pa.int64()), "kept": pa.array(cols[1], pa.binary())})
        names = ("doc_id", "n_bytes", "n_removed", "n_spans")
        return pa.table({**{c: pa.array(x, pa.int64()) for c, x in zip(names, cols, strict=False)}, "kept_sha256": pa.array(cols[4], pa.string())})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" if digest else "doc_id long, kept binary"
    return held.groupBy("block").cogroup(cuts.groupBy("block")).applyInArrow(run, schema)


def cut_digests(documents: DataFrame) -> DataFrame:
    return cut_texts(documents, digest=True)
