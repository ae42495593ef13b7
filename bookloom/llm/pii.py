"""Personal data by weak supervision.

Patterns propose spans: the base kinds (email, ip, card, phone; what passes their checks is a base span
and always stays) and weaker ones (numbers like social security and local phone numbers, titled names).
Five labelers vote on each proposal (+1, -1, or 0 to abstain): shape, gazetteer, context, edges, length.
Expectation-maximisation over the counts of vote patterns estimates how far each labeler can be trusted.
Its posteriors train a logistic span classifier that sees the votes and, besides them, traits of the span that no
labeler votes on: what stands right before and after it, and into how many groups its digits fall. So spans of equal
votes may be decided differently. It decides on proposals that aren't base spans.

All work on texts is in SQL functions; the driver gets only counts of patterns of votes and traits, at most
3 ** 5 * 4 * 4 * 5 for each of the seven kinds, whatever the corpus.

Defined results: a null text is empty; a text of any length is searched whole; repeated rows keep a row each; where
spans of one kind could overlap the leftmost stands; an empty table gives an empty result; digest columns ignore
other columns, redact() keeps them, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import exp, log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import digest_text, find_spans
from .storage import materialize

LABELERS = ("shape", "gazetteer", "context", "edges", "length")
CONTEXT = 40
#: Endings of domains, calling codes and first names that the gazetteer labeler knows.
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "us", "ch", "at", "it", "nl")
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "81", "82", "86", "91")
NAMES = ("Anna", "Carlos", "Claire", "David", "Elena", "Emma", "Hans", "James", "Jean", "John", "Jose", "Julia", "Karl", "Laura", "Lucas", "Maria", "Marie", "Mary", "Michael", "Paul", "Peter", "Robert", "Sarah", "Sofia", "Thomas", "William")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    weighed = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 1, F.pmod(d.cast("int") * 2 - 1, F.lit(9)) + 1 - F.when(d == "0", 1).otherwise(0) * 9).otherwise(d.cast("int")),
    )
    return F.aggregate(weighed, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: SQL-function tests of a match: what a base span needs, what the gazetteer says, usual lengths, words near it.
    check: object
    known: object
    length: tuple[int, int]
    near: str
    base: bool = True


# Possessive and \G forms match just what the plain patterns match, in time linear in the text: a run of
# the first class is tried once, as every later start in it fails with the first.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), lambda m: F.lower(F.substring_index(m, ".", -1)).isin(*DOMAINS), (6, 80), "mail|contact|write|@"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), lambda m: m.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[0-2][0-9])\."), (7, 15), "ip|host|server|address|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){12,}+", lambda m: F.length(_digits(m)).between(13, 19) & luhn(_digits(m)), lambda m: _digits(m).rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"), (13, 23), "card|visa|credit|pay|account"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(9, 15), lambda m: m.rlike(r"^\+(?:" + "|".join(CALLING) + ")"), (10, 20), "tel|phone|call|mobile|fax"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), lambda m: F.lit(None).cast("boolean"), (11, 11), "ssn|social|security|tax", base=False),
    Kind("local_phone", r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", lambda m: m.rlike(r"^\(?[2-9]"), lambda m: F.lit(None).cast("boolean"), (12, 14), "tel|phone|call|mobile|fax", base=False),
    Kind("person", r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau)\.?\x20[A-Z][a-z]{1,30}+(?:\x20[A-Z][a-z]{1,30}+)?", lambda m: m.rlike(r"^\w+\.?\x20\w+\x20\w+$"), lambda m: m.rlike(r"\b(?:" + "|".join(NAMES) + r")\b"), (8, 40), "name|dear|sign|contact|author", base=False),
)
_RANK = {k.name: i for i, k in enumerate(KINDS)}
_PROPOSALS = "array<struct<rank:int,start:int,end:int,kind:string,base:boolean,votes:array<int>,traits:array<int>>>"
#: Traits of a span and how many values each has: the character before and after it (none, blank, letter or digit, other)
#: and groups of digits (0 to 3, more).
TRAITS = (("before", 4), ("after", 4), ("groups", 5))


def _vote(yes: Column) -> Column:
    return F.when(yes.isNull(), 0).when(yes, 1).otherwise(-1)


def _beside(c: Column) -> Column:
    return F.when(F.length(c) == 0, 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"\w"), 2).otherwise(3)


def proposals(text: Column) -> Column:
    """_PROPOSALS of a text, by kind as listed, then start."""

    def of(k: Kind) -> Column:
        def one(s: Column) -> Column:
            m = s["text"]
            before = F.substring(text, F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT)))
            after = F.substring(text, s["end"] + 1, F.lit(1))
            ok = k.check(m)
            votes = F.array(
                _vote(ok),
                _vote(k.known(m)),
                _vote(F.when(F.lower(before).rlike(k.near), True)),
                _vote(~before.rlike(r"\w$") & ~after.rlike(r"^\w")),
                _vote(F.length(m).between(*k.length)),
            )
            return F.struct(
                F.lit(_RANK[k.name]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"),
                F.lit(k.name).alias("kind"), (ok if k.base else F.lit(False)).alias("base"), votes.alias("votes"),
                F.array(_beside(F.right(before, F.lit(1))), _beside(after), F.least(F.regexp_count(m, F.lit("[0-9]+")), F.lit(4))).alias("traits"),
            )

        return F.transform(find_spans(text, k.pattern), one).cast(_PROPOSALS)

    return F.concat(*map(of, KINDS))


@dataclass
class Classifier:
    """Log-odds that a proposal is personal data: bias of its kind, weight times vote for each labeler, and a weight for
    each value of each trait."""

    bias: dict[str, float] = field(default_factory=lambda: {k.name: 0.0 for k in KINDS})
    weights: list[float] = field(default_factory=lambda: [1.0] * len(LABELERS))
    traits: list[list[float]] = field(default_factory=lambda: [[0.0] * n for _, n in TRAITS])

    def accepts(self, p: Column) -> Column:
        odds = F.element_at(F.create_map(*(F.lit(x) for k in KINDS for x in (k.name, float(self.bias[k.name])))), p["kind"])
        for i, w in enumerate(self.weights):
            odds = odds + F.element_at(p["votes"], i + 1) * float(w)
        for i, table in enumerate(self.traits):
            odds = odds + F.element_at(F.array(*(F.lit(float(w)) for w in table)), F.element_at(p["traits"], i + 1) + 1)
        return odds >= 0.0


def expect(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 25) -> list[float]:
    """Posterior of each (kind, votes, count): two classes, votes independent given the class.

    Whom a labeler abstains on says nothing of the class.
    """
    post = [0.9 if sum(v) > 0 else 0.1 for _, v, _ in patterns]
    for _ in range(rounds):
        prior = {k.name: [1.0, 1.0] for k in KINDS}
        table = [{(y, v): (2.0 if v == 2 * y - 1 else 1.0) for y in (0, 1) for v in (-1, 1)} for _ in LABELERS]
        for (kind, votes, n), p in zip(patterns, post, strict=True):
            for y, share in ((0, 1 - p), (1, p)):
                prior[kind][y] += n * share
                for t, v in zip(table, votes, strict=True):
                    if v:
                        t[y, v] += n * share
        total = [{y: t[y, -1] + t[y, 1] for y in (0, 1)} for t in table]
        for i, (kind, votes, _) in enumerate(patterns):
            odds = log(prior[kind][1] / prior[kind][0])
            for t, s, v in zip(table, total, votes, strict=True):
                odds += log(t[1, v] / s[1]) - log(t[0, v] / s[0]) if v else 0.0
            post[i] = 1 / (1 + exp(-max(-30.0, min(30.0, odds))))
    return post


Pattern = tuple[str, tuple[int, ...], tuple[int, ...], int]


def train(patterns: list[Pattern], steps: int = 300, rate: float = 0.5) -> Classifier:
    """The logistic classifier of the posteriors, from (kind, votes, traits, count); counts weigh by their logarithm, so
    that rare patterns tell too."""
    c = Classifier()
    if not patterns:
        return c
    by_votes: dict[tuple[str, tuple[int, ...]], int] = {}
    for kind, votes, _, n in patterns:
        by_votes[kind, votes] = by_votes.get((kind, votes), 0) + n
    told = sorted((k, v, n) for (k, v), n in by_votes.items())
    post = {(k, v): p for (k, v, _), p in zip(told, expect(told), strict=True)}
    y = np.array([post[k, v] for k, v, _, _ in patterns])
    w = np.log1p([n for *_, n in patterns])
    w = w / w.sum()
    # columns: kinds, labelers, then every value of every trait
    first = np.cumsum([len(KINDS) + len(LABELERS), *(n for _, n in TRAITS)])
    x = np.zeros((len(patterns), first[-1]))
    for i, (kind, votes, traits, _) in enumerate(patterns):
        x[i, _RANK[kind]] = 1
        x[i, len(KINDS) : first[0]] = votes
        x[i, [f + t for f, t in zip(first, traits, strict=False)]] = 1
    theta = np.zeros(x.shape[1])
    theta[len(KINDS) : first[0]] = 1.0
    for _ in range(steps):
        theta += rate * (w * (y - 1 / (1 + np.exp(-(x @ theta).clip(-30, 30))))) @ x
    c.bias = {k.name: float(theta[i]) for i, k in enumerate(KINDS)}
    c.weights = theta[len(KINDS) : first[0]].tolist()
    c.traits = [theta[f : f + n].tolist() for f, (_, n) in zip(first, TRAITS, strict=False)]
    return c


def learn(proposed: DataFrame) -> Classifier:
    """From the column proposals: only counts of patterns come to the driver."""
    counts = proposed.select(F.explode("proposals").alias("p")).groupBy("p.kind", "p.votes", "p.traits").count()
    return train(sorted((r["kind"], tuple(r["votes"]), tuple(r["traits"]), r["count"]) for r in counts.collect()))


def decided(found: Column, classifier: Classifier) -> Column:
    """Base spans, and accepted proposals that touch none of them."""
    base = F.filter(found, lambda p: p["base"])
    more = lambda p: classifier.accepts(p) & ~F.exists(base, lambda b: (b["start"] < p["end"]) & (p["start"] < b["end"]))
    return F.filter(found, lambda p: p["base"] | more(p))


def propose(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and proposals, written once: learning and deciding both read them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return materialize(documents.select(F.col(key), proposals(text).alias("proposals")), "proposals")


def span_digests(documents: DataFrame) -> DataFrame:
    proposed = propose(documents)
    out = proposed.select("doc_id", decided(F.col("proposals"), learn(proposed)).alias("s"))
    base = F.filter("s", lambda p: p["base"])
    count = lambda k: F.size(F.filter("s", lambda p: p["base"] & (p["kind"] == k))).cast("long")
    return out.select(
        "doc_id",
        *(count(k.name).alias(f"n_{k.name}") for k in KINDS if k.base),
        F.sha2(digest_text(base), 256).alias("base_sha256"),
        digest_text(F.col("s")).alias("spans"),
    )


def redact(documents: DataFrame) -> DataFrame:
    """documents with every span that is decided on replaced by <KIND>, and n_chars, if there, of the new text.

    Where spans overlap, the one that starts first names the replacement. Texts without spans stay as they are.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # texts are searched twice, for learning and for deciding: keeping what was found with its rows would take their room again
    learned = learn(documents.select(proposals(text).alias("proposals")))
    spans = F.array_sort(F.transform(decided(proposals(text), learned), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["kind"].alias("kind"))))
    out = documents.withColumn("__bl_spans", spans)

    def step(a: Column, s: Column) -> Column:
        end = F.greatest(a["at"], s["end"])
        gap = F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"])
        piece = F.when(s["start"] < a["at"], F.array().cast("array<string>")).otherwise(F.array(gap, F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))))
        return F.struct(end.alias("at"), F.concat(a["out"], piece).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    new = F.aggregate("__bl_spans", start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    out = out.withColumn("text", F.when(F.size("__bl_spans") > 0, new).otherwise(F.col("text"))).drop("__bl_spans")
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull() | F.col("text").isNotNull(), F.length("text").cast(documents.schema["n_chars"].dataType)))
    return out.select(*documents.columns)
