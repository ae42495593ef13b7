import numpy as np
from bookloom.llm import pivots
from bookloom.llm.recall import dense

SCHEMA = "vec_id long, embedding array<float>, label int, h long, n int, root string"


def brute(x, threshold=0.9):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= threshold
    n = near.sum(1) - 1
    root = np.arange(len(x))
    while True:
        new = np.where(near, root[None], len(x)).min(1)
        if (new == root).all():
            return n, root
        root = new


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 32))
    for i in range(300):
        x[i] = x[rng.integers(300, 320)] + rng.normal(size=32) * 0.15
    x = x.astype(np.float32)
    x[650:] = x[640]
    df = spark.createDataFrame([(i, v.tolist(), 0, 0, 0, "x") for i, v in enumerate(x)], SCHEMA)
    n, root = brute(x.astype(float))
    for chunk in (2048, 40):
        monkeypatch.setattr(pivots, "CHUNK", chunk)
        got = {r.vec_id: r for r in pivots.near_duplicates(df).collect()}
        links = sum(r.n_links for r in got.values())
        assert 0.97 * n.sum() <= links <= n.sum()
        assert np.mean([got[i].component_id == root[i] for i in range(len(x))]) > 0.97
        assert all(got[i].n_links <= n[i] and got[i].kept == (got[i].component_id == i) for i in range(len(x)))


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 0.0, 0.0]), (9, [float("inf")]), (9, [float("inf")]), (1, [1.0, 0.0]), (None, [0.0, 1.0])]
    df = spark.createDataFrame([(i, v, None, 0, 0, "x") for i, v in rows], SCHEMA)
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in pivots.near_duplicates(df).collect())
    assert got[:4] == [(0, 0, None, True), (1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False)]
    assert [g[1:] for g in got[4:]] == [(0, 3, True), (0, 4, True), (0, 5, True), (0, 6, True), (0, 7, True), (3, 1, False), (0, 9, True), (0, 9, True)]
    assert pivots.near_duplicates(df.limit(0)).count() == 0


def test_recall_in_a_dense_group(spark, monkeypatch):
    monkeypatch.setattr(pivots, "PER_ROOT", 8.0)  # 512 pivots, as a table of 100,000 rows and more has
    x = dense(4000)
    n, root = brute(x.astype(float))
    df = spark.createDataFrame([(i, v.tolist(), 0, 0, 0, "x") for i, v in enumerate(x)], SCHEMA)
    got = {r.vec_id: r for r in pivots.near_duplicates(df).collect()}
    assert sum(r.n_links for r in got.values()) >= 0.99 * n.sum()
    assert all(got[i].n_links <= n[i] for i in range(len(x)))
    assert np.mean([got[i].component_id == root[i] for i in range(len(x))]) > 0.99


def test_pairs_that_share_one_late_pivot_are_found():
    """Equal vectors in lists of many pivots, sparse and dense, whole and in chunks: each pair once, in its first shared list."""
    rng = np.random.default_rng(2)
    for n, near in ((40, False), (300, True)):
        u = pivots._unit(np.tile(rng.normal(size=16), (n, 1)) + rng.normal(size=(n, 16)) * (0.01 if near else 0.6))
        lists = np.sort(np.stack([rng.choice(1024, 8, replace=False) for _ in range(n)]), 1).astype(np.int32)
        lists[:, 0], lists[::2, 3] = 5, 261
        lists = np.sort(lists, 1)
        copies = rng.integers(1, 4, n)
        want = np.zeros(n)
        for i in range(n):
            for j in range(n):
                if i != j and u[i] @ u[j] >= 0.9:
                    want[i] += copies[j]
        total = np.zeros(n)
        for p in np.unique(lists):
            rows = np.flatnonzero((lists == p).any(1))
            for half in (False, True):
                own = rows % 2 if half else np.zeros(len(rows), int)
                if half and own.min() == own.max():
                    continue
                parts = [rows] if not half else []
                if half:
                    got, _ = pivots.verify(u[rows], lists[rows], own, copies[rows], p, 0.9)
                    both = got.copy()
                    for k in (0, 1):
                        i = np.flatnonzero(own == k)
                        both[i] += pivots.verify(u[rows[i]], lists[rows[i]], own[i], copies[rows[i]], p, 0.9)[0]
                    whole, root = pivots.verify(u[rows], lists[rows], np.zeros(len(rows), int), copies[rows], p, 0.9)
                    assert (both == whole).all() and (root <= np.arange(len(rows))).all()
                for r in parts:
                    total[r] += pivots.verify(u[r], lists[r], np.zeros(len(r), int), copies[r], p, 0.9)[0]
        assert (total == want).all()


def test_nearest_pivots_in_steps(monkeypatch):
    rng = np.random.default_rng(4)
    u, p = pivots._unit(rng.normal(size=(50, 16))), pivots.directions(600, 16)
    want = np.argsort(-(u @ p.T), axis=1, kind="stable")[:, :8]
    for held in (1, 5000, 1 << 21):
        monkeypatch.setattr(pivots, "_HELD", held)
        assert (pivots.describe(u, p, 8) == want).all()
    assert (pivots.describe(u, p[:8], 8) == np.argsort(-(u @ p[:8].T), axis=1)).all()
