"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into at most BINS bins. Boosting goes round the features in turn, each time adding
a shallow tree over one feature's bins to that feature's lookup table; then round the PAIRS strongest
pairs, adding trees of one cut an axis to two-way tables. A score is the sum of one table entry a feature
and pair, through the logistic function.

The model is fitted on at most MOST_LABELS labelled rows, chosen by a hash of their ids, so fitting takes
bounded memory on the driver; every document is scored from its whole text.

Defined results: null, empty and word-free texts have all features 0 and are scored like any text; with no
labelled rows, or labels of one kind, every score is the smoothed share of label 1 (one half without
rows); labels that are null are left out, labels of one id count each; repeated rows keep a row each; a text of any
length is read whole; an empty table gives an empty result; other columns of documents, whatever their names, are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_LABELS = 20_000
BINS, ROUNDS, RATE, DEPTH, PAIRS, PAIR_ROUNDS, LEAF = 32, 120, 0.1, 2, 3, 60, 10
#: Scores from here on are predicted 1.
CUT = 0.3
FOLDS = 5

FEATURES = ("log_words", "word_bytes", "upper", "digits", "marks", "stops", "distinct_words", "repeats", "distinct_lines", "wide", "entropy", "marked_words")
_BYTES = np.arange(256)
_UPPER, _LOWER = (_BYTES >= 65) & (_BYTES <= 90), (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT, _WIDE, _SPACE = (_BYTES >= 48) & (_BYTES <= 57), _BYTES >= 128, (_BYTES == 32) | (_BYTES >= 9) & (_BYTES <= 13)
_STOP = np.isin(_BYTES, list(b".,"))
_MARK = (_BYTES > 32) & (_BYTES < 127) & ~_UPPER & ~_LOWER & ~_DIGIT & ~_STOP
_MARKS = bytes(np.flatnonzero(_MARK).tolist())


def features(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, solid = len(words), int(counts[~_SPACE].sum())
    letters = max(1, int(counts[_UPPER | _LOWER].sum()))
    lines = [x for x in raw.split(b"\n") if x]
    p = counts[counts > 0] / len(raw)
    return [
        float(np.log1p(n)),
        solid / n,
        int(counts[_UPPER].sum()) / letters,
        int(counts[_DIGIT].sum()) / solid,
        int(counts[_MARK].sum()) / solid,
        int(counts[_STOP].sum()) / n,
        len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n,
        len(set(lines)) / max(1, len(lines)),
        int(counts[_WIDE].sum()) / solid,
        float(-(p * np.log2(p)).sum()),
        sum(w[-1] in _MARKS for w in words) / n,
    ]


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.intercept)
        for i, t in enumerate(self.tables):
            z += t[b[i]]
        for i, j, t in self.pairs:
            z += t[b[i], b[j]]
        return 1 / (1 + np.exp(-z.clip(-30, 30)))


def _gain(g, h):
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int) -> np.ndarray:
    """Leaf values by bin of the tree that best fits sums of gradients and curvatures by bin."""
    cg, ch, cn = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    if depth and len(g) > 1:
        gains = _gain(cg, ch) + _gain(g.sum() - cg, h.sum() - ch) - _gain(g.sum(), h.sum())
        gains = np.where((cn >= LEAF) & (n.sum() - cn >= LEAF), gains, 0)
        cut = int(gains.argmax())
        if gains[cut] > 1e-9:
            return np.concatenate([_tree(g[: cut + 1], h[: cut + 1], n[: cut + 1], depth - 1), _tree(g[cut + 1 :], h[cut + 1 :], n[cut + 1 :], depth - 1)])
    return np.full(len(g), g.sum() / (h.sum() + 1.0))


def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best one cut an axis of a two-way table: its gain and leaf values."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def parts(c):
        a, top, left, whole = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return a, top - a, left - a, whole - top - left + a

    gs, hs = parts(G), parts(H)
    gain = sum(_gain(x, y) for x, y in zip(gs, hs, strict=True))
    r, c = np.unravel_index(int(gain.argmax()), gain.shape)
    v = [x[r, c] / (y[r, c] + 1.0) for x, y in zip(gs, hs, strict=True)]
    out = np.empty_like(g)
    out[: r + 1, : c + 1], out[: r + 1, c + 1 :], out[r + 1 :, : c + 1], out[r + 1 :, c + 1 :] = v
    return float(gain[r, c] - _gain(G[-1, -1], H[-1, -1])), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(share / (1 - share))))
    if len(set(y.tolist())) < 2:
        return model
    for c in x.T:
        values = np.unique(c)
        cuts = np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(values) > BINS else (values[1:] + values[:-1]) / 2
        model.edges.append(cuts)
        model.tables.append(np.zeros(len(cuts) + 1))
    b = model.bins(x)
    z = np.full(len(y), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for i, t in enumerate(model.tables):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b[i], g, len(t)), np.bincount(b[i], h, len(t)), np.bincount(b[i], minlength=len(t)), DEPTH)
            t += step
            z += step[b[i]]

    def two_way(i, j):
        n, m = len(model.tables[i]), len(model.tables[j])
        at = b[i] * m + b[j]
        return at, lambda w: np.bincount(at, w, n * m).reshape(n, m)

    g, h = slopes()
    found = []
    for i in range(x.shape[1]):
        for j in range(i):
            if min(len(model.tables[i]), len(model.tables[j])) > 1:
                grid = two_way(i, j)[1]
                found.append((_quarters(grid(g), grid(h))[0], i, j))
    for _, i, j in sorted(found, reverse=True)[:PAIRS]:
        model.pairs.append((i, j, np.zeros((len(model.tables[i]), len(model.tables[j])))))
    for _ in range(PAIR_ROUNDS):
        for i, j, t in model.pairs:
            at, grid = two_way(i, j)
            g, h = slopes()
            step = RATE * _quarters(grid(g), grid(h))[1]
            t += step
            z += step.ravel()[at]
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for b in batches:
        yield b.column(0), np.array([features(t.as_py()) for t in b.column(1)]).reshape(-1, len(FEATURES))


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_LABELS) -> Model:
    """From at most `most` labelled rows that aren't held out."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select("doc_id", F.col(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)
    # at most `most` rows of two numbers
    rows = documents.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("y", "text", F.xxhash64("doc_id").alias("by"))

    def run(batches):
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(1)]).reshape(-1, len(FEATURES))
            yield pa.record_batch([b.column(0), pa.FixedSizeListArray.from_arrays(x.ravel(), len(FEATURES)).cast(pa.list_(pa.float64())), b.column(2)], names=["y", "x", "by"])

    # an id may have many documents: the bound holds for rows, too
    got = rows.mapInArrow(run, "y int, x array<double>, by long").orderBy("by", "y", "x").limit(most).toArrow()
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    y = got.column("y").to_numpy().astype(float)
    order = np.lexsort([*x.T, y])  # the order in which tasks end must not count
    return fit(x[order], y[order])


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(batches):
        for i, x in _feature_rows(batches):
            yield pa.record_batch([i, pa.array(model.score(x))], names=["doc_id", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    scored = documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, model: Model) -> DataFrame:
    """documents, with all their columns, that are predicted 1."""

    def run(batches):
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column("text")]).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(model.score(x) >= CUT))

    return documents.mapInArrow(run, documents.schema)


def quality_digests(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return score(documents, train(documents, labels))
