"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is exponential with its quality weight as rate: -ln(u) / weight, u from a hash of its
id, so reruns agree. Within a source, documents in key order are a weighted sample without replacement.
A source takes complete epochs first; the rest of its target goes to its first documents in key order,
by running sums of sizes. A source's running sum is made in two steps, over key ranges and within one
range, so that no task holds a whole source, however large its share. Ranges are steps of the key's
logarithm: a weight only shifts that, so a range holds the same share of a source whatever its weights are.

Defined results: a null text has size 0; the null source is a source, listed last; repeated rows count
each; documents of equal key are ordered by id (nulls first), then size; documents without an id draw by
their text; documents of size 0 are taken 0 words; a text of any length is one document; an empty table
gives an empty result; other columns are ignored by mix() and kept by take().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Times its size that a source is taken at most.
MOST = 3
#: Documents for each step of a key range, and the least number of steps to a factor e of the key. The logarithm of an
#: exponential variable is nowhere denser than 1/e, so a range of n steps holds at most 1/(e n) of a source's documents.
RANGE_ROWS, RANGES = 1 << 14, 512


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """Near 1 for a mean word length of usual prose, less for junk; never 0."""
    mean = F.coalesce(F.length(text), F.lit(0)) / F.greatest(size, F.lit(1))
    return F.lit(1.0) / (F.lit(1.0) + F.abs(mean - 6.0) / 6.0)


def uniform(key: Column, text: Column, seed: str = "mix") -> Column:
    """In (0, 1), from the first 52 bits of a digest of the key, or of the text where there is none."""
    by = F.coalesce(key.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), by))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def key_range(key: Column, steps: int) -> Column:
    """Rises with the key."""
    return F.floor(F.log(key) * steps).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """sizes: source, source_size, a row per source. Adds weight and target.

    Sources in code-point order, null last, weigh as listed, repeating. With a cap of MOST times the
    size, what is over a cap goes to the others by weight: every uncapped source gets level * weight,
    where the capped ones are those of the smallest cap / weight.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * float(MOST))
    rising = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = rising.rowsBetween(W.unboundedPreceding, -1), rising.rowsBetween(0, W.unboundedFollowing)
    level = (
        F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / F.sum("weight").over(after)
    # the first source that stays below its cap sets the level of all after it
    s = s.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(
        rising.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    )
    return s.select(
        "source", "source_size", "weight",
        F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap"))).alias("target"),
    )


def mix(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3), quality: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, times: a row per document."""
    size = words(F.col("text"))
    base = documents.select("doc_id", "source", F.col("text"), size.alias("size")).select(
        "doc_id", "source", "size",
        (-F.log(uniform(F.col("doc_id"), F.col("text"))) / (quality if quality is not None else quality_weight(F.col("text"), F.col("size")))).alias("key"),
    )
    # texts are read and counted once; what follows are passes over four narrow columns
    base = materialize(base, "mix")
    steps = max(RANGES, 1 << (base.count() // RANGE_ROWS).bit_length())
    base = base.withColumn("range", key_range(F.col("key"), steps))
    ranges = base.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    goal = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights)
    by_range = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("offset", F.coalesce(F.sum("range_size").over(by_range), F.lit(0)))
    plan = (
        ranges.alias("r").join(goal.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source")))
        .select(F.col("r.source").alias("of"), F.col("range").alias("part"), "offset", "source_size", "target")
    )
    within = W.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    ahead = base.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0)))
    out = ahead.join(plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("part")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - epochs * F.col("source_size")
    # the document at the boundary is taken if that comes nearer to the target
    first = (F.col("offset") + F.col("ahead") + F.col("size") / 2.0) <= rest
    times = epochs + F.when(first & (epochs < MOST), 1).otherwise(0)
    return out.select(
        "doc_id", "source", "size", "source_size", "target",
        (times * F.col("size")).alias("taken"), times.cast("int").alias("times"),
    )


def take(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, with all its columns.

    Documents without words carry nothing to mix and are left out.
    """
    chosen = (
        mix(documents, weights).where(F.col("taken") > 0)
        .groupBy("doc_id").agg(F.max("times").alias("__bl_times")).withColumnRenamed("doc_id", "__bl_id")
    )
    joined = documents.join(chosen, F.col("doc_id").eqNullSafe(F.col("__bl_id")))
    copies = F.explode(F.sequence(F.lit(1), F.col("__bl_times")))
    return joined.where(words(F.col("text")) > 0).select(*documents.columns, copies.alias("__bl_copy")).drop("__bl_copy")


def mix_digests(documents: DataFrame) -> DataFrame:
    return mix(documents).select("doc_id", "size", "source_size", "target", "taken")
