"""Embedding near-duplicates through a pivot-permutation index.

Pivots are Gaussian directions from a fixed seed, of uneven length on purpose: the products of two vectors
with one are then normal with the vectors' cosine as their correlation, whatever the table holds. A vector is
described by the ordered list of its NEAREST pivots by product; an inverted list of each pivot holds the
vectors that name it. Vectors that share a pivot are compared by cosine in double precision. So the chance
that a link is found depends on its cosine and the number of pivots only, not on how dense its group is: by
simulation, at cosine 0.9 itself, 0.998 at 1,024 pivots and 0.994 at 16,384, and more above 0.9.
A pair is counted only in the list of its first shared pivot, so each counts once. Lists are read in pairs of
chunks of at most CHUNK vectors, so no task holds a whole hot list, and a task returns sums of links per
vector and one link per vector towards its group, never the pairs.

Equal vectors are one entry with a multiplicity, named by a 64-bit digest.

Defined results: null vectors, zero vectors and vectors with null or non-finite components link with
nothing; shorter vectors count as filled with zeros; repeated rows link with each other and keep a row
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import discard, materialize

THRESHOLD, NEAREST, CHUNK, SEED = 0.9, 8, 2048, 5
#: Pivots: the power of two at or above this times the root of the number of different vectors, at least LEAST.
PER_ROOT, LEAST = 1.0, 64
_STEP = 256
#: Products, of rows with pivots, and compared pairs that are held at once.
_HELD, _PAIRS = 1 << 21, 1 << 14
#: What single precision may be off by, in products of unit vectors; what is nearer to the threshold is looked at in double.
_SLACK = 1e-4


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows over their norms; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True, initial=0).clip(np.finfo(float).tiny)
    return x / np.linalg.norm(x, axis=1, keepdims=True).clip(np.finfo(float).tiny)


@lru_cache(maxsize=2)
def directions(count: int, width: int) -> np.ndarray:
    """The pivots; not of length 1, see above. Each worker makes them from the seed, so none are sent."""
    return np.random.default_rng(SEED).normal(size=(count, width))


def describe(unit: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """The ordered nearest pivots of each row, _HELD products at a time."""
    out, step = [np.zeros((0, nearest), np.int32)], max(1, _HELD // len(pivots))
    for s in range(0, len(unit), step):
        far = -(unit[s : s + step] @ pivots.T)
        top = np.sort(np.argpartition(far, nearest - 1, axis=1)[:, :nearest], axis=1) if nearest < len(pivots) else np.tile(np.arange(nearest), (len(far), 1))
        order = np.argsort(np.take_along_axis(far, top, 1), axis=1, kind="stable")
        out.append(np.take_along_axis(top, order, 1).astype(np.int32))
    return np.concatenate(out)


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least member of each one's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _first_shared(a: np.ndarray, b: np.ndarray, pivot: int) -> np.ndarray:
    """Which rows of pivots, pair by pair, share none before this one."""
    return ~((a[:, :, None] == b[:, None, :]) & (a < pivot)[:, :, None]).any((1, 2))


def verify(unit: np.ndarray, lists: np.ndarray, own: np.ndarray, copies: np.ndarray, pivot: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs whose first shared pivot is this one; own: the rows' chunks, if two, only pairs across.

    For each row: copies of what it links with, and the least row that links reach. Pairs are never listed
    beyond a block, but those that join what was not joined before. Products in single precision say what may link;
    where that is little, pair by pair is looked at in double precision, else the block as a whole.
    """
    across = own.min() != own.max()
    left = np.flatnonzero(own == own.min())
    right = np.flatnonzero(own == own.max())
    # which rows on the right name a pivot before this one; the last line is for pivots that none names
    before = np.unique(lists[right][lists[right] < pivot])
    names = np.zeros((len(before) + 1, len(right)), bool)
    i, j = np.nonzero(lists[right] < pivot)
    names[np.searchsorted(before, lists[right][i, j]), i] = True
    total, root = np.zeros(len(lists)), np.arange(len(lists))
    quick = unit.astype(np.float32)
    for s in range(0, len(left), _STEP):
        rows = left[s : s + _STEP]
        near = quick[rows] @ quick[right].T >= threshold - _SLACK
        if not across:
            near &= rows[:, None] < right
        a, b = np.nonzero(near)
        if len(a) * 32 <= near.size:
            a, b = rows[a], right[b]
            for k in range(0, len(a), _PAIRS):
                p, q = a[k : k + _PAIRS], b[k : k + _PAIRS]
                sure = (np.einsum("ij,ij->i", unit[p], unit[q]) >= threshold) & _first_shared(lists[p], lists[q], pivot)
                p, q = p[sure], q[sure]
                np.add.at(total, p, copies[q])
                np.add.at(total, q, copies[p])
                fresh = root[p] != root[q]
                if fresh.any():
                    root = _roots(np.concatenate([p[fresh], np.arange(len(root))]), np.concatenate([q[fresh], root]), len(root))
            continue
        near &= unit[rows] @ unit[right].T >= threshold
        for c in lists[rows].T:
            at = np.searchsorted(before, c)
            at[(c >= pivot) | (at >= len(before))] = len(before)
            at[at < len(before)] = np.where(before[at[at < len(before)]] == c[at < len(before)], at[at < len(before)], len(before))
            near &= ~names[at]
        total[rows] += near @ copies[right].astype(float)
        total[right] += copies[rows].astype(float) @ near
        a, b = np.nonzero(near & (root[rows][:, None] != root[right]))
        if len(a):
            root = _roots(np.concatenate([rows[a], np.arange(len(root))]), np.concatenate([right[b], root]), len(root))
    return total, root


def links(embeddings: DataFrame, threshold: float = THRESHOLD, nearest: int = NEAREST) -> tuple[DataFrame, DataFrame]:
    """rows (vec_id, h) and classes (h, copies, least, n, root): h null for vectors that link with nothing."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    valid = x.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(x, lambda v: v != 0)
    named = embeddings.select("vec_id", "embedding", F.when(valid, F.xxhash64("embedding")).alias("h"))
    rows = materialize(named.select("vec_id", "h"), "rows")
    classes = materialize(
        named.where(F.col("h").isNotNull()).groupBy("h")
        .agg(F.first("embedding").alias("embedding"), F.count("*").alias("copies"), F.min("vec_id").alias("least")),
        "vectors",
    )
    n, width = classes.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    k = max(LEAST, 1 << int(np.ceil(np.log2(max(1.0, PER_ROOT * np.sqrt(n))))))
    nearest, wide = min(nearest, k), max(1, width)

    def index(batches):
        for b in batches:
            near = describe(_unit(_matrix(b.column(1), wide)), directions(k, wide), nearest)
            lists = pa.ListArray.from_arrays(np.arange(0, near.size + 1, nearest, dtype=np.int32), near.ravel())
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), lists], names=["h", "embedding", "copies", "near"])

    kind = classes.schema["embedding"].dataType.simpleString()
    indexed = classes.select("h", "embedding", "copies").mapInArrow(index, f"h long, embedding {kind}, copies long, near array<int>")
    indexed = materialize(indexed, "index")
    # one row for each of the k pivots, about the root of the rows: 16 bytes each, 16 MB at 10^12 vectors
    sizes = indexed.select(F.explode("near").alias("pivot")).groupBy("pivot").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    listed = indexed.withColumn("pivot", F.explode("near")).join(F.broadcast(sizes), "pivot")
    listed = listed.withColumn("own", F.pmod("h", "chunks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    listed = listed.select("h", "embedding", "copies", "near", "pivot", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def count(table: pa.Table) -> pa.Table:
        h, copies = (table.column(c).to_numpy() for c in ("h", "copies"))
        near = table.column("near").combine_chunks().flatten().to_numpy().reshape(-1, nearest)
        own, pivot = table.column("own").to_numpy(), table.column("pivot")[0].as_py()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        total, root = np.zeros(len(h)), np.arange(len(h))
        if i == j or own.min() != own.max():
            total, root = verify(_unit(_matrix(table.column("embedding"), wide)), near, own, copies, pivot, threshold)
        keep = total > 0
        return pa.table({"h": h[keep], "n": total[keep].astype(np.int64), "to": h[root[keep]]})

    found = materialize(listed.groupBy("pivot", "i", "j").applyInArrow(count, "h long, n long, to long"), "found")
    total = found.groupBy("h").agg(F.sum("n").alias("n"))
    root = components(found, "h", "to")
    out = materialize(
        classes.select("h", "copies", "least").join(total, "h", "left")
        .join(root, F.col("h") == F.col("node"), "left")
        .select("h", "copies", "least", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "h").alias("root")),
        "linked", n,
    )
    discard(classes, indexed, found, root)
    return rows, out


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row per vector."""
    rows, classes = links(embeddings, threshold)
    least = materialize(classes.groupBy("root").agg(F.min("least").alias("component_id")), "least", classes.count())  # so that large groups can be split below
    named = classes.join(least, "root").select(F.col("h").alias("of"), (F.col("n") + F.col("copies") - 1).alias("n"), "component_id")
    out = rows.join(named, F.col("h") == F.col("of"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
