import hashlib
import random

import numpy as np
from bookloom.llm import suffix_dedup as sd

W = 50


def brute(rows):
    first = {}
    raws = [(i, (t or "").encode()) for i, t in rows]
    key = lambda i: i if i is not None else 1 << 62
    for i, b in raws:
        for s in range(len(b) - W + 1):
            first[b[s : s + W]] = min(first.get(b[s : s + W], key(i)), key(i))
    out = []
    for i, b in raws:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - W + 1):
            if first[b[s : s + W]] < key(i):
                gone[s : s + W] = True
        edge = np.diff(np.concatenate([[False], gone, [False]]).astype(int))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["anon", "the", "ofing", "é", "and", "ti", "erwh", "on", "shation", "x"]
    prose = lambda k: " ".join(rng.choices(words, k=k))
    shared = [prose(rng.randint(8, 80)) for _ in range(8)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.15 and texts:
            t = rng.choice(texts)
        elif kind < 0.3 and texts:
            t = list(rng.choice(texts))
            for _ in range(rng.randint(1, 4)):
                if t:
                    t[rng.randrange(len(t))] = "#"
            t = "".join(t)
        else:
            t = " ".join(x for _ in range(rng.randint(0, 3)) for x in (prose(rng.randint(0, 60)), rng.choice(shared)))
        texts.append(t)
    rng.shuffle(texts)
    return list(enumerate(texts))


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((tuple(r) for r in sd.cut_digests(df).collect()), key=str)


def test_against_brute_force(spark, monkeypatch):
    for seed, block, part, fan in ((1, 4 << 20, 1 << 20, 4096), (2, 3000, 1 << 20, 4096), (3, 8000, 500, 4096), (4, 1500, 2000, 3)):
        monkeypatch.setattr(sd, "BLOCK", block)
        monkeypatch.setattr(sd, "SLICE", part)
        monkeypatch.setattr(sd, "FAN", fan)
        rows = corpus(seed)
        assert run(spark, rows) == sorted(brute(rows), key=str)


def test_odd_rows(spark):
    same = "abcdefghij" * 6
    rows = [(5, None), (4, ""), (3, "short"), (2, same), (2, same), (9, same), (None, same), (None, same + "!"), (7, "a" * 3000), (8, "a" * 49), (6, "a" * 50), (10, same[:49]), (11, "é" * 25), (12, "é" * 26)]
    assert run(spark, rows) == sorted(brute(rows), key=str)
    assert sd.cut_digests(spark.createDataFrame([], "doc_id long, text string, block long")).count() == 0


def test_long_text_is_read_in_steps(monkeypatch):
    rng = np.random.default_rng(0)
    raw = rng.integers(97, 100, 5000).astype(np.uint8)
    ends = np.array([1200, 1230, 5000])
    whole = sd.anchors(raw, ends)
    monkeypatch.setattr(sd, "STEP", 700)
    cover = lambda x: {(int(h), int(s + i)) for h, s, n in zip(*x, strict=True) for i in range(n)}
    assert cover(whole) == cover(sd.anchors(raw, ends))
    assert len(cover(whole)) == (1200 - 49) + (3770 - 49)
