"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint maps to the bit counts of its 32 two-bit segments. The Manhattan distance of two
such vectors is a lower bound of the Hamming distance, so fingerprints within RADIUS bits have vectors
within RADIUS. The grid range join rests on that bound: with the coordinates in RADIUS + 3 blocks, two
vectors within RADIUS are at range 0 of each other in three blocks at least, so the grids' cells are those of
side one in every three blocks, and bring together every pair that can link. In a cell the Manhattan distance
of the vectors is tested first; only pairs within the radius there are verified on the fingerprints.

Within a cell, a search over what isn't yet reached emits at most one link per member, whatever the
cell's size; a cell over CELL members is dealt out as pairs of chunks, each within that bound.

Defined results: null and empty texts, and texts without words, have fingerprint zero, which links like
any other; repeated rows keep a row each; an empty table gives an empty result; other columns are ignored.

near_groups() and keep_one() serve similarities that need more bits than blocks of a fingerprint can
spare: 0.8 of five-word shingles moves about every seventh bit. There a document has WIDE times 64 bits, of
its distinct shingles. Its DECIDED most decided bits (by counts farthest from half) stay with its near copies,
so documents meet in the cells of pairs of them; in a cell the Manhattan distance of the 64-bit segments' bit
counts is the lower bound that is looked at first, then Hamming distance. That only names candidates: within
what they join, a link is decided by the Jaccard similarity of the sets of shingles (as 64-bit hashes).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import discard, materialize

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Members of a cell that one task holds at once.
CELL = 20_000
#: Words of 64 bits of a wide fingerprint, and bits whose pairs are its cells.
WIDE, DECIDED = 8, 10
#: Members, and bytes of their shingles, of a group of candidates that one task holds at once, twice.
GROUP, GROUP_BYTES = 2048, 8 << 20
_LOW = 0x5555555555555555
_STEP = 1 << 16


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)

_EIGHT = np.arange(0, 2048, 256, dtype=np.uint16)


def _mixed(h: np.ndarray, j: int) -> np.ndarray:
    """The j-th further hash of each hash; the first is the hash itself."""
    if not j:
        return h
    h = (h + np.uint64(0x9E3779B97F4A7C15 * j % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def bit_counts(text: str | None, words: int = SHINGLE, wide: int = 1) -> tuple[np.ndarray, int]:
    """For each of 64 * wide bits, the shingles whose hash has it, and the number of shingles."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII only, both
    counts = np.zeros(64 * wide, np.int64)
    if not w:
        return counts, 0
    line = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(w) - words + 1)
    last = ends[min(words, len(w)) - 1 :]
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, _STEP):
        h = np.array([digest(line[s:e], SEED) for s, e in zip(starts[i : min(n, i + _STEP)].tolist(), last[i : i + _STEP].tolist(), strict=True)], np.uint64)
        for j in range(wide):
            # counts of byte values at each of eight places, then of their bits
            place = _mixed(h, j).view(np.uint8).reshape(-1, 8) + _EIGHT
            counts[64 * j : 64 * j + 64] += (np.bincount(place.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return counts, n


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """As a signed 64-bit number."""
    counts, n = bit_counts(text, words)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(documents: DataFrame, words: int = SHINGLE) -> DataFrame:
    """doc_id, fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(t.as_py(), words) for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def embedding(fp: Column) -> Column:
    """Bit counts 0, 1, 2 of the 32 segments in unary (00, 01, 11): Manhattan distance is then bit_count(x ^ y)."""
    even, odd = fp.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_LOW))
    return even.bitwiseOR(odd).bitwiseOR(F.shiftleft(even.bitwiseAND(odd), 1))


def _masks(radius: int) -> list[int]:
    """Of the cells: every three of radius + 3 blocks of segments."""
    blocks = np.array_split(np.arange(32), radius + 3)
    bits = [sum(3 << 2 * int(s) for s in b) for b in blocks]
    return [x - (1 << 64) if x >> 63 else x for x in (sum(c) for c in combinations(bits, 3))]


def cells(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, grid, cell: the cells of each fingerprint in every grid."""
    e = embedding(F.col("fp"))
    every = F.array(*(F.struct(F.lit(i).cast("short").alias("grid"), F.col("e").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(_masks(radius))))
    return fps.select("fp", e.alias("e")).select("fp", F.explode(every).alias("k")).select("fp", "k.grid", "k.cell")


def unary(fps: np.ndarray) -> np.ndarray:
    """embedding() of an array of fingerprints."""
    low = np.uint64(_LOW)
    even, odd = fps & low, fps >> np.uint64(1) & low
    return even | odd | (even & odd) << np.uint64(1)


def _near(rows: np.ndarray, at: np.ndarray, bits: int, ratio: float = 0.0) -> np.ndarray:
    """Which rows are within so many bits of one (or each of as many). A row is a fingerprint and its vector; or several
    words of one, whose bit counts bound the distance from below, and the number of shingles: sets whose sizes are in no
    such ratio can't be that similar."""
    at = at if at.ndim == 2 else at[None]
    if rows.shape[1] == 2:
        out = np.bitwise_count(rows[:, 1] ^ at[:, 1]) <= bits  # Manhattan
        out &= np.bitwise_count(rows[:, 0] ^ at[:, 0]) <= bits
        return out
    sizes, own = rows[:, -1].astype(np.int64), at[:, -1].astype(np.int64)
    out = np.minimum(sizes, own) >= ratio * np.maximum(sizes, own)
    rows, at = rows[out, :-1], np.broadcast_to(at, (len(rows), at.shape[1]))[out, :-1]
    near = np.abs(np.bitwise_count(rows).astype(np.int16) - np.bitwise_count(at)).sum(1) <= bits
    near[near] = np.bitwise_count(rows[near] ^ at[near]).sum(1, dtype=np.int64) <= bits
    out[out] = near
    return out


def _spread(fps: np.ndarray, bits: int, ratio: float = 0.0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links, as places, that join what links within so many bits join: each member once, to one that reached it."""
    out, rest = [], np.arange(len(fps))
    while len(rest) > 1:
        reached, rest = [int(rest[0])], rest[1:]
        while reached and len(rest):
            at = reached.pop()
            near = _near(fps[rest], fps[at], bits, ratio)
            if near.any():
                new = rest[near]
                out.append((np.full(len(new), at), new))
                reached += new.tolist()
                rest = rest[~near]
    return out


def _links(keys: list[np.ndarray], fps: np.ndarray, bits: int, ratio: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by keys; links, as places, within each key's rows."""
    change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
    starts = np.concatenate([[0], change])
    sizes = np.diff(np.concatenate([starts, [len(fps)]]))
    two = starts[sizes == 2]
    two = two[_near(fps[two], fps[two + 1], bits, ratio)]
    found = [(two, two + 1)]
    for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        found += [(a + s, b + s) for a, b in _spread(fps[s : s + n], bits, ratio)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _words_of(column: pa.Array) -> np.ndarray:
    """Rows of 64-bit words: of longs the fingerprint and its vector, of binaries of one length their words."""
    if pa.types.is_integer(column.type):
        fps = column.to_numpy(zero_copy_only=False).view(np.uint64)
        return np.stack([fps, unary(fps)], 1)
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), -1)


def cell_links(rows: DataFrame, bits: int, ratio: float = 0.0) -> DataFrame:
    """rows: id (long), fp, grid, cell. a, b: ids, links that join exactly what links of rows of a cell join; ratio: of
    the sizes that the last word of a wide fp tells."""
    hot = rows.groupBy("grid", "cell").count().where(F.col("count") > CELL)
    # a row for CELL rows and more: few, but found among all cells, so only what is left goes to few files
    hot = materialize(hot.select("grid", "cell", F.ceil(F.col("count") / CELL).cast("int").alias("chunks")).repartition(8), "cells")
    if hot.isEmpty():
        rows = rows.withColumns({"i": F.lit(0), "j": F.lit(0)})
    else:
        chunks = F.coalesce("chunks", F.lit(1))
        rows = rows.join(hot, ["grid", "cell"], "left").withColumn("own", F.pmod(F.xxhash64("id"), chunks).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        rows = rows.select("id", "fp", "grid", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush(cols: list[np.ndarray]):
            ids, fps, *keys = cols
            a, b = _links(keys, fps, bits, ratio)
            for s in range(0, len(a), _STEP):
                yield pa.record_batch([pa.array(ids[a[s : s + _STEP]]), pa.array(ids[b[s : s + _STEP]])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([c.to_numpy(zero_copy_only=False) if k != 1 else _words_of(c) for k, c in enumerate(batch.columns)])
            same = np.all([k == k[-1] for k in held[-1][2:]], axis=0)
            cut = len(same) - (len(same) if same.all() else int(np.argmin(same[::-1])))
            if cut:  # keep the last key's rows for the next batch
                whole = [np.concatenate(c) for c in zip(*held[:-1], [c[:cut] for c in held[-1]], strict=True)]
                held = [[c[cut:] for c in held[-1]]]
                yield from flush(whole)
        if held:
            yield from flush([np.concatenate(c) for c in zip(*held, strict=True)])

    dealt = rows.select("id", "fp", "grid", "cell", "i", "j").repartition("grid", "cell", "i", "j").sortWithinPartitions("grid", "cell", "i", "j")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fps: distinct fingerprints. a, b: links that join exactly what links within radius join."""
    return cell_links(cells(fps, radius).withColumn("id", F.col("fp")), radius)


def groups(documents: DataFrame, words: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links reach."""
    fp = materialize(fingerprints(documents, words), "fingerprints")
    distinct = materialize(fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    n = distinct.count()
    root = components(links(distinct.select("fp"), radius))
    classes = distinct.join(root, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    classes = materialize(classes, "roots", n)
    least = materialize(classes.groupBy("root").agg(F.min("least").alias("component_id")), "least", n)  # so that large groups can be split below
    named = materialize(classes.join(least, "root").select(F.col("fp").alias("of"), "component_id"), "named", n)
    discard(distinct, root, classes, least)
    return fp.join(named, F.col("fp") == F.col("of")).select("doc_id", "fp", "component_id")


def group_digests(documents: DataFrame) -> DataFrame:
    return groups(documents).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingles(text: str | None, words: int) -> np.ndarray:
    """Hashes of the distinct shingles, ascending."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII only, both
    line = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(words, len(w)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[s:e], SEED) for s, e in zip(starts.tolist(), last.tolist(), strict=False)] if w else [], np.uint64))


def set_counts(hashes: np.ndarray, wide: int = WIDE) -> np.ndarray:
    """For each of 64 * wide bits, the hashes that have it."""
    counts = np.zeros(64 * wide, np.int64)
    for i in range(0, len(hashes), _STEP):
        for j in range(wide):
            place = _mixed(hashes[i : i + _STEP], j).view(np.uint8).reshape(-1, 8) + _EIGHT
            counts[64 * j : 64 * j + 64] += (np.bincount(place.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return counts


def allowed_bits(similarity: float, wide: int = WIDE) -> int:
    """Differing bits up to which documents are candidates: what is expected at a Jaccard similarity of the
    shingles, and six standard deviations, since sets of a few shingles differ in more bits than others."""
    n, share = 64 * wide, np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return round(n * share + 6 * np.sqrt(n * share * (1 - share)))


def named(hashes: np.ndarray) -> int:
    """A signed 64-bit digest of a set of shingles."""
    return xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63)


def sketches(documents: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, fp (WIDE words and the number of shingles, as binary), h (a digest of the shingles), size (of them) and cells: pairs of the most decided bits."""
    pairs = np.array(list(combinations(range(DECIDED), 2)))

    def sketch(text: str | None) -> tuple[bytes, int, int, list[int]]:
        hashes = shingles(text, words)
        off = 2 * set_counts(hashes) - len(hashes)
        top = np.sort(np.argsort(-np.abs(off), kind="stable")[:DECIDED])
        signed = 2 * top + (off[top] > 0)
        fp = np.packbits(off > 0, bitorder="little").tobytes() + len(hashes).to_bytes(8, "little")
        return fp, named(hashes), len(hashes), (signed[pairs[:, 0]] << 20 | signed[pairs[:, 1]]).tolist()

    def run(batches):
        for b in batches:
            fp, h, size, cells = zip(*(sketch(t.as_py()) for t in b.column(1)), strict=True) if b.num_rows else ([],) * 4
            yield pa.record_batch([b.column(0), pa.array(fp, pa.binary()), pa.array(h, pa.int64()), pa.array(size, pa.int64()), pa.array(cells, pa.list_(pa.int64()))], names=["doc_id", "fp", "h", "size", "cells"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp binary, h long, size long, cells array<long>")


def _similar(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links, as places, that join what links of that Jaccard similarity or more join: each member once."""
    sizes = np.array([len(x) for x in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    parts = np.split(ids, np.cumsum(sizes)[:-1])
    flag = np.zeros(int(ids.max(initial=-1)) + 1, bool)
    a, b, rest = [], [], np.arange(len(sets))
    while len(rest) > 1:
        reached, rest = [int(rest[0])], rest[1:]
        while reached and len(rest):
            at = reached.pop()
            n = sizes[rest]
            may = np.flatnonzero((np.minimum(n, sizes[at]) / np.maximum(np.maximum(n, sizes[at]), 1) >= similarity) & (n > 0))
            if not len(may):
                continue
            flag[parts[at]] = True
            both = np.add.reduceat(flag[np.concatenate([parts[k] for k in rest[may]])], np.concatenate([[0], np.cumsum(n[may])[:-1]]), dtype=np.int64)
            flag[parts[at]] = False
            near = may[both / (n[may] + sizes[at] - both) >= similarity]
            a += [at] * len(near)
            b += rest[near].tolist()
            reached += rest[near].tolist()
            rest = np.delete(rest, near)
    return np.array(a, np.int64), np.array(b, np.int64)


def verified(documents: DataFrame, members: DataFrame, words: int, similarity: float, rows: int | None = None) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """Links, and the tables that they are read from. members: h, size, least (a document that has the set) and root, the group of candidates. a, b: links by Jaccard
    similarity of the shingles, that join what all such links within a group join."""
    # sets of sizes in no such ratio can't link, so members meet by bands of size: a pair that can is in one band or two
    # neighbours. Group g of a root holds bands g and g + 1; one without members of band g has nothing of its own to ask.
    step = float(np.log(1 / (similarity * 0.999)))
    band = F.when(F.col("size") > 0, F.floor(F.log(F.col("size")) / step)).otherwise(-1).cast("long")
    placed = members.select("h", "least", "root", "size", band.alias("band"), F.explode(F.array(band, band - 1)).alias("g"))
    chunks = F.ceil(F.greatest(F.count("*") / GROUP, F.sum("size") * 8 / GROUP_BYTES)).cast("int")
    sizes = placed.groupBy("root", "g").agg(chunks.alias("chunks"), F.count_if(F.col("band") == F.col("g")).alias("own")).where("own > 0")
    sizes = materialize(sizes.select("root", "g", "chunks"), "groups", rows)
    at = F.collect_list(F.struct("g", "chunks"))  # at most two
    m = placed.join(sizes, ["root", "g"]).groupBy("h", "least", "root").agg(at.alias("at"))
    m = materialize(m.select(F.col("h").alias("__bl_h"), F.col("least").alias("__bl_id"), F.col("root").alias("__bl_root"), F.col("at").alias("__bl_at")), "members", rows)
    texts = documents.select("doc_id", "text").join(m, F.col("doc_id").eqNullSafe(F.col("__bl_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), words) for t in b.column(0)]
            keep = pa.array([named(x) == h.as_py() for x, h in zip(sets, b.column(1), strict=True)], pa.bool_())  # an id may have several texts
            yield pa.record_batch([b.column(1), b.column(2), b.column(3), pa.array([x.tobytes() for x in sets], pa.binary())], names=["h", "root", "at", "set"]).filter(keep)

    held = texts.select("text", "__bl_h", "__bl_root", "__bl_at").mapInArrow(run, "h long, root long, at array<struct<g:long,chunks:int>>, set binary")
    held = held.withColumn("at", F.explode("at")).select("h", "root", "set", "at.g", "at.chunks")
    held = held.withColumn("own", F.pmod(F.xxhash64("h"), "chunks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    held = held.select("h", "set", "root", "g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def links_of(table: pa.Table) -> pa.Table:
        h, first = np.unique(table.column("h").to_numpy(), return_index=True)
        column = table.column("set")
        a, b = _similar([np.frombuffer(column[int(k)].as_py(), np.uint64) for k in first], similarity)
        return pa.table({"a": h[a], "b": h[b]})

    return held.groupBy("root", "g", "i", "j").applyInArrow(links_of, "a long, b long"), (sizes, m)


def near_groups(documents: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, h, component_id: documents joined by links of that similarity or more; component_id is the smallest."""
    made = materialize(sketches(documents, words), "sketches")
    distinct = made.groupBy("h").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("cells").alias("cells"))
    distinct = materialize(distinct, "classes")
    n = distinct.count()
    rows = distinct.select(F.col("h").alias("id"), "fp", F.lit(0).cast("short").alias("grid"), F.explode("cells").alias("cell"))
    candidates = components(cell_links(rows, allowed_bits(similarity), similarity))
    both = candidates.unionByName(candidates.select(F.col("root").alias("node"), "root")).distinct()
    members = distinct.join(both, F.col("h") == F.col("node")).select("h", "size", "least", "root")
    found, read = verified(documents, members, words, similarity, n)
    root = components(found)
    discard(candidates, *read)
    classes = materialize(distinct.join(root, F.col("h") == F.col("node"), "left").select("h", "least", F.coalesce("root", "h").alias("root")), "roots", n)
    least = materialize(classes.groupBy("root").agg(F.min("least").alias("component_id")), "least", n)  # so that large groups can be split below
    of = materialize(classes.join(least, "root").select(F.col("h").alias("of"), "component_id"), "named", n)
    slim = materialize(made.select("doc_id", "h"), "sketched")
    discard(made, distinct, root, classes, least)
    return slim.join(of, F.col("h") == F.col("of")).select("doc_id", "h", "component_id")


def keep_one(documents: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """documents, with all their columns: of each group of near copies the one of the smallest id, once."""
    chosen = near_groups(documents, words, similarity).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = chosen.groupBy("doc_id").agg(F.count("*").alias("__bl_times")).withColumnRenamed("doc_id", "__bl_id")
    kept = documents.join(chosen, F.col("doc_id").eqNullSafe(F.col("__bl_id")))
    once = kept.where("__bl_times = 1").select(*documents.columns)
    return once.unionByName(kept.where("__bl_times > 1").select(*documents.columns).dropDuplicates(["doc_id", "text"]))
