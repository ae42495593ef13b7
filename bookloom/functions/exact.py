"""Exact numbers from wire text, and statistics that never approximate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookloom.sources.schemas import DECIMAL, NOT_FINITE, NUMBER


def decimal_code(text: Column, is_string: Column | None = None, kind: str = DECIMAL) -> Column:
    """Why a wire value is not a number here: null if it is one. kind: the decimal type that has to hold it."""
    scale = int(kind.rstrip(")").split(",")[1])
    digits = F.length(F.rtrim(F.regexp_extract(text, r"\.([0-9]*)", 1), F.lit("0")))
    code = (
        F.when(text.rlike(NOT_FINITE), "decimal_not_finite")
        .when(text.isNull() | ~text.rlike(NUMBER), "decimal_parse_failure")
        .when((digits > scale) | text.try_cast(kind).isNull(), "decimal_precision_unsupported")
    )
    return code if is_string is None else F.when(~F.coalesce(is_string, F.lit(False)), "decimal_not_string").otherwise(code)


def exact(text: Column, kind: str = DECIMAL) -> Column:
    """The number, null where decimal_code() has a reason."""
    return F.when(decimal_code(text, kind=kind).isNull(), text.try_cast(kind))


def plain_text(number: Column) -> Column:
    """Without exponent and trailing zeros."""
    text = number.cast("string")
    return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)


def bounds_code(price: Column, size: Column) -> Column:
    return F.when((price < 0) | (price > 1), "price_out_of_bounds").when(size < 0, "negative_size")


def delay_ms(received: Column, source_ms: Column) -> Column:
    """Receive time (timestamp) less source time (milliseconds), exact to the microsecond."""
    return F.unix_micros(received).cast("decimal(20,0)") / F.lit(1000).cast("decimal(4,0)") - source_ms.cast("decimal(22,6)")


def elapsed_ms(start_ns: Column, end_ns: Column) -> Column:
    """Milliseconds between two readings of a monotonic clock, as plain text."""
    return plain_text((end_ns - start_ns).cast("decimal(26,6)") / F.lit(1_000_000).cast("decimal(7,0)"))


def nearest_rank(df: DataFrame, value: str, shares: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """Exact nearest-rank quantiles: the value at ceil(n * share), at least the first.

    Values are counted first, so the ordered pass sees each different value once.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__bl_n"))
    whole, upto = W.partitionBy(*by), W.partitionBy(*by).orderBy(value)
    ranked = counts.withColumn("__bl_upto", F.sum("__bl_n").over(upto)).withColumn("__bl_all", F.sum("__bl_n").over(whole))
    pick = lambda p: F.min(F.when(F.col("__bl_upto") >= F.greatest(F.lit(1), F.ceil(F.col("__bl_all") * F.lit(p).cast("decimal(6,4)"))), F.col(value)))
    return ranked.groupBy(*by).agg(F.sum("__bl_n").alias("n"), *(pick(p).alias(name) for name, p in shares.items()))
