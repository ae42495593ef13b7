import random

import numpy as np
from bookloom.llm import gam
from pyspark.sql import functions as F


def corpus(spark, n=600):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(80)]
        good = rng.random() < 0.7
        text = " ".join(words) if good else rng.choice([" ".join(w + "%%%" for w in words), " ".join(w for w in words[:8] for _ in range(10)), " ".join(w.upper() + "!!" for w in words)])
        docs.append((i, text, "en" if good else "xx", "s", 1))
        if i % 2 == 0:
            labels.append((i, int(good), 0))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score int")
    return df, spark.createDataFrame([*labels, (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_blindness(spark):
    df, labels = corpus(spark)
    got = gam.quality_digests(df, labels)
    rows = {r.doc_id: r for r in got.collect()}
    held = [r for r in labels.collect() if r.doc_id is not None and r.quality is not None and rows[r.doc_id].held_out]
    assert len(held) > 20 and np.mean([rows[r.doc_id].predicted == r.quality for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())
    # held-out labels, language and source do not reach a score
    turned = labels.withColumn("quality", F.when(gam.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in gam.quality_digests(df.withColumn("lang", F.lit("zz")), turned).collect()}
    assert again == {i: r.score for i, r in rows.items()}


def test_pairs_are_learned():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.fit(x, y)
    assert {0, 1} in [{i, j} for i, j, _ in model.pairs]
    assert np.mean((model.score(x) > 0.5) == y) > 0.9


def test_odd_rows(spark, odd_documents, no_documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = gam.quality_digests(odd_documents, none).collect()
    assert len(out) == odd_documents.count() and {r.score for r in out} == {0.5}
    assert gam.quality_digests(no_documents, none).count() == 0
    model = gam.train(odd_documents, none)
    assert gam.keep_good(odd_documents, model).count() == odd_documents.count()
    assert gam.features(None) == gam.features(" \n") == [0.0] * len(gam.FEATURES)


def plain_fit(x, y, bins, rounds, pair_rounds, pairs):
    """The model by loops over rows and cuts, without running sums. Returns a score for each row."""
    edges = []
    for c in x.T:
        values = sorted(set(c.tolist()))
        edges.append(sorted(set(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1]).tolist())) if len(values) > bins else [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)])
    at = [[sum(v >= e for e in edges[f]) for v in x[:, f]] for f in range(x.shape[1])]
    size = [len(e) + 1 for e in edges]
    share = (sum(y) + 1) / (len(y) + 2)
    z = [float(np.log(share / (1 - share)))] * len(y)
    gain = lambda g, h: g * g / (h + 1)

    def slopes():
        p = [1 / (1 + np.exp(-v)) for v in z]
        return [a - b for a, b in zip(y, p, strict=True)], [b * (1 - b) for b in p]

    def tree(rows, f, low, high, depth, g, h):
        """Leaf value by bin, for bins from low to high."""
        G, H = sum(g[i] for i in rows), sum(h[i] for i in rows)
        best = (1e-9, None)
        if depth:
            for cut in range(low, high):
                left = [i for i in rows if at[f][i] <= cut]
                if len(left) >= gam.LEAF and len(rows) - len(left) >= gam.LEAF:
                    a, b = sum(g[i] for i in left), sum(h[i] for i in left)
                    worth = gain(a, b) + gain(G - a, H - b) - gain(G, H)
                    if worth > best[0] + 1e-12:
                        best = (worth, cut)
        if best[1] is None:
            return dict.fromkeys(range(low, high + 1), G / (H + 1))
        cut = best[1]
        left = [i for i in rows if at[f][i] <= cut]
        right = [i for i in rows if at[f][i] > cut]
        return tree(left, f, low, cut, depth - 1, g, h) | tree(right, f, cut + 1, high, depth - 1, g, h)

    def quarters(a, b, g, h):
        best = None
        for r in range(size[a] - 1):
            for c in range(size[b] - 1):
                parts = [[0.0, 0.0] for _ in range(4)]
                for i in range(len(y)):
                    k = 2 * (at[a][i] > r) + (at[b][i] > c)
                    parts[k][0] += g[i]
                    parts[k][1] += h[i]
                worth = sum(gain(*p) for p in parts)
                if best is None or worth > best[0] + 1e-12:
                    best = (worth, r, c, [p[0] / (p[1] + 1) for p in parts])
        return best

    for _ in range(rounds):
        for f in range(x.shape[1]):
            g, h = slopes()
            step = tree(list(range(len(y))), f, 0, size[f] - 1, gam.DEPTH, g, h)
            z = [v + gam.RATE * step[at[f][i]] for i, v in enumerate(z)]
    g, h = slopes()
    whole = gain(sum(g), sum(h))
    ranked = sorted(((quarters(a, b, g, h)[0] - whole, a, b) for a in range(x.shape[1]) for b in range(a) if min(size[a], size[b]) > 1), reverse=True)[:pairs]
    for _ in range(pair_rounds):
        for _, a, b in ranked:
            g, h = slopes()
            _, r, c, leaf = quarters(a, b, g, h)
            z = [v + gam.RATE * leaf[2 * (at[a][i] > r) + (at[b][i] > c)] for i, v in enumerate(z)]
    return 1 / (1 + np.exp(-np.array(z)))


def test_fit_equals_the_plain_model(monkeypatch):
    rng = np.random.default_rng(3)
    x = np.stack([rng.integers(0, 5, 90), rng.normal(size=90).round(2), rng.integers(0, 3, 90)], 1).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 1] > 0.1) | (rng.random(90) < 0.1)).astype(float)
    for name, value in (("BINS", 6), ("ROUNDS", 4), ("PAIR_ROUNDS", 3), ("PAIRS", 2)):
        monkeypatch.setattr(gam, name, value)
    model = gam.fit(x, y)
    want = plain_fit(x, y.tolist(), 6, 4, 3, 2)
    assert np.allclose(model.score(x), want, atol=1e-9) and len(model.pairs) == 2
