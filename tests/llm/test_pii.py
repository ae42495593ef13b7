import hashlib
import random
import re

from bookloom.llm import pii
from pyspark.sql import functions as F

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def texts():
    rng = random.Random(7)
    parts = ["a@b.co", "x.y+z@mail-1.example.com_", "_d@e.f", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "0001.002.3.255", "4111 1111 1111 1111", "4026083977531332", "4111-1111-1111-1112", "+1 (523) 555-1055", "+49 30.12", "++12345678 9-", "é", "😀", " ", "\n", "@", ".", "-", "7", "00", "word", "Dr. Anna Schmidt", "ssn 123-45-6789", "(212) 555-0199"]
    return [None, "", *("".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(400)), "a@b" + ".c" * 20000, "9" * 20000, "a" * 20000, "+1" + " " * 20000]


def test_base_spans_follow_the_rules(spark):
    rows = texts()
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.span_digests(df).collect()}
    for i, t in enumerate(rows):
        want = brute(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest(), t
        for k in PATTERNS:
            assert got[i][f"n_{k}"] == sum(w[0] == k for w in want)
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(got[i].spans.split(","))


def test_em_trusts_labelers_that_agree():
    patterns = [("email", (1, 1, 0, 1, 1), 900), ("email", (-1, -1, 0, 1, -1), 100), ("ssn", (1, 0, 1, 1, 1), 20), ("ssn", (-1, 0, 0, -1, 1), 30)]
    post = pii.expect(patterns)
    assert post[0] > 0.9 and post[2] > 0.9 and post[1] < 0.1 and post[3] < 0.2
    assert pii.train([]).weights == [1.0] * 5


def test_redact(spark, odd_documents, no_documents):
    out = {r.doc_id: r for r in pii.redact(odd_documents).collect()}
    assert out[8].text == "<EMAIL> <PHONE> password=hunter22" and out[8].n_chars == len(out[8].text)
    assert out[0].text is None and out[3].text == "one"
    assert pii.redact(odd_documents).columns == odd_documents.columns
    assert pii.redact(no_documents).count() == pii.span_digests(no_documents).count() == 0
    df = spark.createDataFrame([(1, "a@b.co, 1.2.3.4; x")], "doc_id long, text string")
    assert pii.redact(df).select("text").first()[0] == "<EMAIL>, <IP>; x"
    assert pii.span_digests(odd_documents).where(F.col("doc_id").isNull()).first().spans == ""


def test_traits_decide_where_votes_do_not():
    """What stands beside spans of good votes speaks for others of the same surroundings."""
    good, bad, open_ = (1, 1, 1, 1, 1), (-1, -1, 0, -1, -1), (1, 0, 0, -1, 1)
    patterns = [("ssn", good, (1, 1, 3), 500), ("ssn", bad, (2, 2, 1), 500), ("ssn", open_, (1, 1, 3), 9), ("ssn", open_, (2, 2, 1), 9)]
    c = pii.train(patterns)
    odds = lambda votes, traits: c.bias["ssn"] + sum(w * v for w, v in zip(c.weights, votes, strict=True)) + sum(t[x] for t, x in zip(c.traits, traits, strict=True))
    assert odds(good, (1, 1, 3)) > 0 > odds(bad, (2, 2, 1)) and odds(open_, (1, 1, 3)) > odds(open_, (2, 2, 1))
    assert [len(t) for t in c.traits] == [n for _, n in pii.TRAITS]


def test_traits_of_spans(spark):
    df = spark.createDataFrame([("123-45-6789, x(212) 555-0199",)], "text string")
    got = {p.kind: p.traits for p in df.select(pii.proposals(F.col("text")).alias("p")).first().p}
    assert got["ssn"] == [0, 3, 3] and got["local_phone"] == [2, 0, 3]
