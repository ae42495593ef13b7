import random
import zlib

import numpy as np
import pytest
from bookloom.llm import packing
from tokenizers import Tokenizer

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")

TEXTS = [None, "", "  ", "It's a TEST, don't", "''s ''ll x's's _a__b 12 ½", "É́ ﬁ İ Σς a b", "<|endoftext|>x", "a<|b", "ÀÖØöß÷×ÿ ª º", "\x1c\x85\xa0\x7f x", "word " * 5000, "9" * 3000, "mix é ñ\n\ttab's\r\n#$%!!'d", "😀 ok", "'S 'RE I'M"]


def whole(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 0]


def test_ids_are_the_tokenizers():
    rng = random.Random(2)
    alphabet = "abcSTLM'Éßñ÷ 12_-.,\n\t#"
    for t in [*TEXTS, *("".join(rng.choices(alphabet, k=60)) for _ in range(500))]:
        assert packing.token_ids(t, PATH).tolist() == whole(t), t


def test_words_that_are_met_again_stay_known(monkeypatch):
    monkeypatch.setattr(packing, "WORDS", 40)
    packing._words.cache_clear()
    words = packing._words(PATH)
    learn, learned = words.learn, []
    monkeypatch.setattr(words, "learn", lambda new: (learned.extend(new), learn(new)))
    rng = random.Random(3)
    for _ in range(30):
        t = " ".join(["often", "é'll", *("".join(rng.choices("abcdefgé", k=9)) for _ in range(4))])
        assert packing.token_ids(t, PATH).tolist() == whole(t)
    assert learned.count("often") == 1
    assert len(words.known) + len(words.older) <= 50
    packing._words.cache_clear()


def test_a_text_looks_each_word_up_once(monkeypatch):
    packing._words.cache_clear()
    words = packing._words(PATH)
    ids, asked = words.ids, []
    monkeypatch.setattr(words, "ids", lambda some: (asked.extend(some), ids(some))[1])
    t = "Some words' WORDS again, it's again 12 " * 200
    assert packing.token_ids(t, PATH).tolist() == whole(t)
    assert sorted(asked) == sorted({"some", "words", "'", "again", ",", "it", "'s", "1", "2"})
    packing._words.cache_clear()


def test_a_long_text_does_not_fill_the_words(monkeypatch):
    monkeypatch.setattr(packing, "WORDS", 100)
    monkeypatch.setattr(packing, "CHUNK", 200, raising=False)
    packing._words.cache_clear()
    rng = random.Random(5)
    t = " ".join("".join(rng.choices("abcdefgé", k=9)) for _ in range(3000))
    assert packing.token_ids(t, PATH).tolist() == whole(t)
    words = packing._words(PATH)
    assert len(words.known) + len(words.older) <= 150
    packing._words.cache_clear()


def test_texts_of_a_batch_keep_their_ids(monkeypatch):
    rng = random.Random(6)
    signs = ["'", "'s", "'re", "'L", "'ll", "''d", "-'t", "'v", "e", "É", "ßa", "à", "í", "12", "<|", "|>", " ", "\n", "\t ", "ab", "x\0y", "ﬁ"]
    texts = [*TEXTS, *("".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(400)), "", None]
    want = [whole(t) for t in texts]
    for chunk in (1, 7, 60, 1 << 19):
        monkeypatch.setattr(packing, "CHUNK", chunk)
        assert [ids.tolist() for ids in packing.text_ids(texts, PATH)] == want, chunk


def check(rows, want):
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= packing.ROOM
    return len(bins)


def test_pack_documents(spark, monkeypatch):
    want = []
    for i, t in enumerate(TEXTS):
        ids = np.array(whole(t), "<u4")
        want += [(i, p, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048])) for p, s in enumerate(range(0, len(ids), 2048))]
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for shard in (4096, 8):
        monkeypatch.setattr(packing, "SHARD", shard)
        check(packing.pack_documents(df).collect(), want)
    twice = packing.pack_documents(df.unionAll(df)).collect()
    check(twice, want * 2)


def test_odd_documents(odd_documents, no_documents):
    assert packing.pack_documents(odd_documents).select("doc_id").distinct().count() == odd_documents.select("doc_id").distinct().count()
    assert packing.pack_documents(no_documents).count() == 0


def test_evolution_packs_tightly():
    rng = random.Random(4)
    lengths = [min(2048, int(rng.expovariate(1 / 700)) + 1) for _ in range(1000)]
    bins = packing.evolve(lengths, 2048, [], random.Random(1))
    assert sorted(i for b in bins for i in b) == list(range(1000))
    assert len(bins) <= 1.02 * -(-sum(lengths) // 2048) + 1
    child = packing.crossover(bins, packing.best_fit(range(1000), lengths, 2048), lengths, 2048, rng)
    assert sorted(i for b in child for i in b) == list(range(1000))
    assert all(sum(lengths[i] for i in b) <= 2048 for b in child)
