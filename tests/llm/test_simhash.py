import random

import numpy as np
import xxhash
from bookloom.llm import simhash
from pyspark.sql import functions as F


def brute_fp(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(fps, radius=4):
    names = list(fps)
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in names}


def near(rng, x, bits):
    for k in rng.sample(range(64), bits):
        x ^= 1 << k
    return x


def test_fingerprint_follows_the_rule():
    for t in ["", None, "a", "A b C", "a b c d", "a b c d e a b c d e", "É x\x0by  z\n" * 50]:
        assert simhash.fingerprint(t) % (1 << 64) == brute_fp(t)


def test_links_find_every_component(spark, monkeypatch):
    rng = random.Random(3)
    fps = {}
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):
            fps[len(fps)] = x
            x = near(rng, x, rng.randint(0, 6))
    want = brute_components(fps)
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in set(fps.values())], "fp long")
    for cell in (20_000, 2):  # 2: cells are dealt out as pairs of chunks
        monkeypatch.setattr(simhash, "CELL", cell)
        got = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.components(simhash.links(df)).collect()}
        for a in fps:
            for b in fps:
                same = fps[a] == fps[b] or got.get(fps[a], fps[a]) == got.get(fps[b], fps[b])
                assert same == (want[a] == want[b])


def test_embedding_bounds_the_distance(spark):
    rng = random.Random(5)
    x = [rng.getrandbits(64) for _ in range(300)]
    y = [near(rng, v, rng.randint(0, 64)) for v in x]
    s = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(s(a), s(b)) for a, b in zip(x, y, strict=True)], "a long, b long")
    rows = df.select("a", "b", simhash.embedding(df.a).alias("p"), simhash.embedding(df.b).alias("q")).collect()
    for r in rows:
        segment = lambda v: [((v >> 2 * i) & 3).bit_count() for i in range(32)]
        low = sum(abs(i - j) for i, j in zip(segment(r.a), segment(r.b), strict=True))
        assert (r.p ^ r.q).bit_count() if r.p ^ r.q >= 0 else ((r.p ^ r.q) % (1 << 64)).bit_count() == low
        assert low <= ((r.a ^ r.b) % (1 << 64)).bit_count()


def test_groups_of_odd_rows(odd_documents, no_documents):
    got = simhash.groups(odd_documents).collect()
    assert len(got) == odd_documents.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.component_id)
    assert by[0] == by[1] == by[2] == by[None] == {0}
    assert by[4] == by[5] == {4}
    assert simhash.group_digests(no_documents).count() == 0


def test_spread_joins_chains():
    fps = np.array([0, 15, 255, 1 << 60], np.uint64)
    x = np.stack([fps, simhash.unary(fps)], 1)
    assert {tuple(map(int, p)) for a, b in simhash._spread(x, 4) for p in zip(a, b, strict=True)} == {(0, 1), (1, 2), (0, 3)}
    wide = np.concatenate([np.repeat(fps[:, None], 8, 1), np.array([[10], [10], [10], [7]], np.uint64)], 1)
    assert {tuple(map(int, p)) for a, b in simhash._spread(wide, 8) for p in zip(a, b, strict=True)} == {(0, 3)}
    assert not simhash._spread(wide, 8, 0.8)  # sets of 10 and 7 shingles are not that similar


def test_the_vectors_distance_is_a_lower_bound():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 500, np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 500, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500, np.uint64))
    counts = lambda v: np.stack([np.bitwise_count(v >> np.uint64(2 * i) & np.uint64(3)) for i in range(32)], 1).astype(int)
    manhattan = np.abs(counts(a) - counts(b)).sum(1)
    assert (np.bitwise_count(simhash.unary(a) ^ simhash.unary(b)) == manhattan).all() and (manhattan <= np.bitwise_count(a ^ b)).all()


def jaccard(a, b, k=5):
    sets = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def edited(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"w{rng.random()}"
    return words


def test_near_copies_of_five_word_shingles(spark):
    rng = random.Random(11)
    base = [[f"w{rng.randrange(3000)}" for _ in range(300)] for _ in range(60)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    rows += [(100 + i, " ".join(edited(rng, w, 2))) for i, w in enumerate(base[:30])]  # about 0.94
    rows += [(200 + i, " ".join(edited(rng, w, 25))) for i, w in enumerate(base[30:])]  # about 0.5
    rows += [(300, rows[0][1].upper()), (301, ""), (302, None), (300, rows[0][1].upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit(1))
    kept = sorted(r.doc_id for r in simhash.keep_one(df).collect())
    assert min(jaccard(rows[i][1], rows[60 + i][1]) for i in range(30)) > 0.85
    assert kept == [*range(60), *range(200, 230), 301]
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_keep_one_takes_odd_rows(odd_documents):
    out = simhash.keep_one(odd_documents)
    assert out.columns == odd_documents.columns
    assert sorted(r.doc_id for r in out.collect()) == [0, 3, 4, 6, 7, 8]


def test_links_are_decided_by_the_sets_of_shingles(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**6)}"
    line = [word() for _ in range(12)]
    repeated = [(i, " ".join([word() for _ in range(200)] + line * 20)) for i in range(2)]
    base = [word() for _ in range(304)]
    rows, n = [*repeated, (10, " ".join(base))], 0
    for k, start in enumerate(range(0, 280, 5)):  # a run of changed words: similarity about 0.76, then 0.82
        for more in (36, 26):
            n += 1
            w = list(base)
            for i in range(start, min(start + more, 304)):
                w[i] = word()
            rows.append((1000 + n, " ".join(w)))
    want = {i: i for i, _ in rows}
    for i, a in rows:
        for j, b in rows:
            if i < j and want[i] != want[j] and jaccard(a, b) >= 0.8:
                old, new = max(want[i], want[j]), min(want[i], want[j])
                want = {x: new if r == old else r for x, r in want.items()}
    got = {r.doc_id: r.component_id for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and got[1] == 1 and len(set(want.values())) > 3


def test_short_near_copies_meet(spark):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        w = [f"w{rng.random()}" for _ in range(10)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:-1]))]  # 6 and 5 shingles: similarity 0.83
    got = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - i % 2 for i in range(120)}


def test_similar_sets_meet_in_bands_of_size():
    """Sizes of sets that can be that similar are in one band or two neighbours."""
    for similarity in (0.8, 0.5, 0.9):
        step = np.log(1 / (similarity * 0.999))
        sizes = np.arange(1, 3000)
        band = np.floor(np.log(sizes) / step)
        least = np.ceil(similarity * sizes - 1e-9).astype(int).clip(1)
        assert (band - np.floor(np.log(least) / step) <= 1).all()
