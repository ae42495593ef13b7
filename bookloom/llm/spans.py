"""Positions of regular-expression matches as Column expressions.

Spark has functions for the matched strings and for the strings between them, not for positions;
running sums of both lengths give the positions, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int,text:string>>"
#: Matches that one fold appends to one array; longer lists are folded in blocks, so that the cost stays linear.
BLOCK = 256


def find_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of a Java pattern that never matches the empty string, as SPANS."""
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")
    )

    def width(x: Column) -> Column:
        return F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))

    def in_blocks(zipped: Column) -> Column:
        last = F.floor((F.size(zipped) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(zipped, b * BLOCK + 1, F.lit(BLOCK)))

    def with_offsets(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + width(x)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        offsets = F.aggregate(
            sums,
            start,
            lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")),
            lambda a: a["all"],
        )
        return F.arrays_zip(blocks.alias("block"), offsets.alias("offset"))

    def fold(x: Column) -> Column:
        def step(a: Column, p: Column) -> Column:
            begin = a["at"] + F.length(p["gap"])
            end = begin + F.length(p["hit"])
            hit = F.struct(begin.alias("start"), end.alias("end"), p["hit"].alias("text"))
            return F.when(p["hit"].isNull(), a).otherwise(
                F.struct(end.alias("at"), F.concat(a["all"], F.array(hit)).alias("all"))
            )

        start = F.struct(x["offset"].alias("at"), F.array().cast(SPANS).alias("all"))
        return F.aggregate(x["block"], start, step, lambda a: a["all"])

    # let(): one-element transforms keep each intermediate array from being computed again
    def let(value: Column, body) -> Column:
        return F.element_at(F.transform(F.array(value), body), 1)

    found = let(parts, lambda z: let(in_blocks(z), lambda b: F.flatten(F.transform(with_offsets(b), fold))))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPANS))


def digest_text(spans: Column) -> Column:
    """kind:start:end of each, comma-joined in the order given."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")
