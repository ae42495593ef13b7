"""The stages against plain versions of what each decides, on a small corpus."""

import importlib
import random
import re

import __spark_entry__
import numpy as np
import pytest
from bookloom.llm import gam, packing, simhash

pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return [f"{rng.choice('abcdefg')}{rng.choice(['on', 'er', 'ing', 'ation'])}{rng.randrange(400)}" for _ in range(n)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(160):
        words = prose(rng, 120)
        junk = i % 8 == 7
        text = " ".join(w.upper() + "!!" for w in words) if junk else " ".join(words)
        if i % 10 == 3 and not junk:
            text += f" mail me at user{i}@mail.example.com or +1 (555) 555-01{i % 90 + 10} or 4111 1111 1111 1111 from 10.1.2.{i}"
        docs.append((i, text, "en", f"s{i % 3}" if i % 5 else "s0", len(text)))
        labels.append((i, int(not junk), 0))
    for i, src in enumerate((0, 1, 2, 3)):
        docs.append((500 + i, docs[src][1], "en", "s1", docs[src][4]))  # exact copies
    for i, src in enumerate((10, 11, 12)):
        words = docs[src][1].split()
        words[60] = "changed"
        docs.append((600 + i, " ".join(words), "en", "s2", 1))  # near copies
    docs += [(700, "", "en", "s0", 0), (701, None, None, None, None)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path), {d[0]: d[1] for d in docs}


def test_stages(spark, folder):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "personal data", "source mix", "best-fit packing"]
    seen = {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path).cache()
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        seen[name] = {r.doc_id: r for r in docs.collect()}
    good = seen["quality classifier"]
    assert {i for i in good if i < 160} == {i for i in range(160) if i % 8 != 7}
    kept = seen["SimHash near-dedup"]
    assert not {500, 501, 502, 503, 600, 601, 602} & set(kept) and {0, 1, 2, 3, 10, 11, 12} <= set(kept)
    assert {i for i in good if i < 160} == {i for i in kept if i < 160}
    clean = seen["personal data"]
    for i, r in clean.items():
        if r.text is not None and texts[i] != r.text:
            assert i % 10 == 3
            assert not re.search(r"@|4111|555-01|10\.1\.2", r.text) and "<EMAIL>" in r.text and "<CARD>" in r.text and r.n_chars == len(r.text)
    assert all(clean[i].text != texts[i] for i in clean if i < 160 and i % 10 == 3)
    mixed = seen["source mix"]
    assert set(mixed) <= set(clean)
    packed = pipeline.STAGES[-1][1](spark, docs, path).collect()
    rows = docs.collect()
    assert sum(r.length for r in packed) == sum(len(packing.token_ids(r.text, packing.default_tokenizer())) for r in rows)
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        assert sum(n for _, n in b) <= 2048 and sorted(b)[0][0] == 0


def test_run_and_entry(spark, folder):
    out = pipeline.run(spark, folder[0])
    assert out.count() > 0 and "sequence_id" in out.columns
    assert __spark_entry__.queries()["pipeline"] is pipeline.run
    ops = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in ops) == list(range(1, 11))


def test_allowed_bits_follow_similarity():
    assert simhash.allowed_bits(1.0) == 0
    assert simhash.allowed_bits(0.8) < simhash.allowed_bits(0.7)
    assert np.isclose(gam.CUT, 0.3)
    assert importlib.import_module("bookloom.llm.storage").shared_dir


def test_odd_rows_through_every_stage(spark, tmp_path, folder):
    """Extra columns with clashing names, repeated rows, null ids and sources, and a table without rows."""
    path, texts = folder
    odd = "score double, h long, size long, source_size long, fp string, root long, spans string, proposals string, key string, taken long"
    extra = tuple([1.0, 7, 7, 7, "x", 7, "s", "p", "k", 7])
    base = [(i, texts[i], "en", "s0", len(texts[i])) for i in range(40)]
    rows = [r + extra for r in [*base, *base[:3], (None, texts[41], None, None, None), (None, texts[41], None, None, None), (None, None, None, None, None), (90, "", "en", None, 0), (91, " \n", "en", "s1", 2)]]
    docs = spark.createDataFrame(rows, f"{SCHEMA}, {odd}")
    columns = docs.dtypes
    for data in (docs, docs.limit(0)):
        now = data
        for name, stage in pipeline.STAGES:
            now = stage(spark, now, path)
            if name != "best-fit packing":
                assert now.dtypes == columns, name
            now = now.cache()
            if name == "SimHash near-dedup" and data is docs:
                kept = [r.doc_id for r in now.collect()]
                assert len([i for i in kept if i is not None]) == len({i for i in kept if i is not None})
        packed = now.collect()
        fill = {}
        for r in packed:
            fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
        assert all(n <= 2048 for n in fill.values()) and bool(packed) == (data is docs)
