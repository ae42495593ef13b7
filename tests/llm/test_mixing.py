import re
from fractions import Fraction

from bookloom.llm import mixing
from pyspark.sql import functions as F


def level_off(sizes):
    """Targets by resharing what is over a cap until nothing is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), Fraction(sum(sizes.values()))
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / w > 3 * sizes[s]}
        if not over:
            return target | {s: rest * weight[s] / w for s in open_}
        for s in over:
            target[s] = Fraction(3 * sizes[s])
        rest -= sum(target[s] for s in over)
        open_ -= over
    return target


def corpus(spark):
    rows = [(i, " ".join(["w"] * (i % 37 + 1)), ["b", "a", "é", None, "big"][0 if i < 20 else 1 if i < 60 else 2 if i < 300 else 3 if i < 330 else 4]) for i in range(900)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("key", F.lit(1))


def test_targets_and_takes(spark):
    rows, df = corpus(spark)
    got = mixing.mix(df).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(mixing.WORD, t))
    want = level_off(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - float(want[r.source])) < 1e-6
        assert r.taken <= 3 * r.size and r.taken == r.times * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - float(t)) <= 37
    epochs = {s: {r.times for r in got if r.source == s} for s in sizes}
    assert all(max(x) - min(x) <= 1 for x in epochs.values())  # complete epochs come first
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))


def test_take_repeats_documents(spark):
    _, df = corpus(spark)
    out = mixing.take(df)
    assert out.columns == df.columns
    times = {r.doc_id: r.times for r in mixing.mix(df).collect() if r.times}
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == times


def test_odd_rows(odd_documents, no_documents):
    out = mixing.mix_digests(odd_documents).collect()
    assert len(out) == odd_documents.count()
    assert all(r.taken == 0 for r in out if r.size == 0)
    assert mixing.mix_digests(no_documents).count() == mixing.take(no_documents).count() == 0


def test_no_key_range_is_hot_whatever_the_weights(spark):
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    for weight in (1.0, 0.2, 0.05, 0.001):
        keyed = rows.select((-F.log(mixing.uniform(F.col("doc_id"), F.col("text"))) / weight).alias("key"))
        per = keyed.groupBy(mixing.key_range(F.col("key"), 512)).count().agg(F.max("count"), F.count("*")).first()
        assert per[0] <= 2 * 40_000 / (2.718 * 512) + 10 and per[1] > 512


def test_documents_without_ids_draw_by_their_text(spark):
    df = spark.createDataFrame([(None, f"w{i} x y", "a") for i in range(300)] + [(i, "z " * 40, "b") for i in range(300)], "doc_id long, text string, source string")
    assert len({r.u for r in df.where("doc_id IS NULL").select(mixing.uniform(F.col("doc_id"), F.col("text")).alias("u")).collect()}) == 300
    got = mixing.mix(df).where("doc_id IS NULL").collect()
    assert len(got) == 300 and abs(sum(r.taken for r in got) - got[0].target) <= 3
