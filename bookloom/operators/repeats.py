"""Frames with many entries: histogram, repeated assets, repeated keys and whether their order matters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entries_histogram(frames: DataFrame) -> DataFrame:
    """frame_entries, frames; frames: a row per frame with frame_entries."""
    return frames.groupBy("frame_entries").agg(F.count("*").alias("frames"))


def frame_repeats(entries: DataFrame, frame: str = "frame") -> DataFrame:
    """A row per frame: frame_entries, same_asset, repeated_keys, order_sensitive.

    entries: frame, change_index, asset_id, side, price_key, size_key (numbers as plain text, or raw text).
    Sensitive are keys whose first and last sizes differ; what lies between does not count. Entries are
    counted by key before they meet by frame.
    """
    key = entries.groupBy(frame, "asset_id", "side", "price_key").agg(
        F.count("*").alias("n"),
        F.min_by("size_key", "change_index").alias("first"),
        F.max_by("size_key", "change_index").alias("last"),
    )
    asset = key.groupBy(frame, "asset_id").agg(
        F.sum("n").alias("n"),
        F.count_if(F.col("n") > 1).alias("keys"),
        F.count_if((F.col("n") > 1) & ~F.col("first").eqNullSafe(F.col("last"))).alias("moved"),
    )
    return asset.groupBy(frame).agg(
        F.sum("n").alias("frame_entries"),
        (F.max("n") > 1).alias("same_asset"),
        F.sum("keys").alias("repeated_keys"),
        (F.sum("moved") > 0).alias("order_sensitive"),
    )


def repeat_counters(frames: DataFrame) -> DataFrame:
    """Totals of frame_repeats()."""
    return frames.agg(
        F.count("*").alias("frames"),
        F.coalesce(F.sum("frame_entries"), F.lit(0)).alias("entries"),
        F.count_if(F.col("frame_entries") > 1).alias("multi_entry_frames"),
        F.count_if("same_asset").alias("same_asset_frames"),
        F.count_if(F.col("repeated_keys") > 0).alias("repeated_key_frames"),
        F.count_if("order_sensitive").alias("order_sensitive_frames"),
    )
