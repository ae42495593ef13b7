"""What a decoded payload holds: types, paths, tokens, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_KINDS = {"VOID": "null", "BOOLEAN": "boolean", "STRING": "string", "OBJECT": "object", "ARRAY": "array"}
_NUMBERS = ("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE", "DECIMAL")


def wire_type(value: Column) -> Column:
    """null, boolean, string, number, object or array; NULL for a missing value. The value is read once."""
    names = F.create_map(*(F.lit(x) for k, v in (_KINDS | dict.fromkeys(_NUMBERS, "number")).items() for x in (k, v)))
    return F.element_at(names, F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0))


def base64_text(content: Column) -> Column:
    """Without line breaks."""
    return F.regexp_replace(F.base64(content), r"[\r\n]", "")


def member(value: Column, path: str) -> Column:
    """The member as VARIANT: NULL if missing, the variant null if explicitly null."""
    return F.try_variant_get(value, path, "variant")


def has(value: Column, path: str) -> Column:
    return member(value, path).isNotNull()


def text_of(value: Column, path: str) -> Column:
    """str() of a member: an explicit null reads None, as the feed's own tools print it."""
    return F.when(F.is_variant_null(member(value, path)), "None").otherwise(F.try_variant_get(value, path, "string"))


def field_paths(events: DataFrame, key: str, event: str = "event") -> DataFrame:
    """key, event_type, path, wire_type of every member at any depth; [] marks array elements.

    The depth is that of the data; rows are bounded by the data, so the row limit of recursion is lifted.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    walked = spark.sql(
        """WITH RECURSIVE walk(k, event_type, path, v) AS (
             SELECT k, event_type, CAST('' AS STRING), v FROM {events}
             UNION ALL
             SELECT w.k, w.event_type,
                    CASE WHEN e.key IS NULL THEN concat(w.path, '[]') WHEN w.path = '' THEN e.key ELSE concat(w.path, '.', e.key) END, e.value
             FROM walk w, LATERAL variant_explode(w.v) e)
           SELECT k, event_type, path, v FROM walk WHERE path <> ''""",
        events=events.select(F.col(key).alias("k"), "event_type", F.col(event).alias("v")),
    )
    return walked.select(F.col("k").alias(key), "event_type", "path", wire_type(F.col("v")).alias("wire_type"))


def leaf(path: Column) -> Column:
    return F.lower(F.element_at(F.split(F.replace(path, F.lit("[]"), F.lit("")), "[.]"), -1))


def event_tokens(event: Column) -> Column:
    """Sorted distinct asset ids: the event's own, its changes', its list's."""
    own = F.array(F.try_variant_get(event, "$.asset_id", "string"))
    changes = F.transform(F.try_variant_get(event, "$.price_changes", "array<variant>"), lambda c: F.try_variant_get(c, "$.asset_id", "string"))
    listed = F.try_variant_get(event, "$.assets_ids", "array<string>")
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(own, F.coalesce(changes, empty), F.coalesce(listed, empty)))))


def frame_metadata(events: Column) -> dict[str, Column]:
    """Of the array of a frame's events: sorted distinct types, timestamps and asset ids, and the only timestamp."""

    def gather(path: str) -> Column:
        return F.array_sort(F.array_distinct(F.array_compact(F.transform(events, lambda e: F.try_variant_get(e, path, "string")))))

    times = gather("$.timestamp")
    return {
        "event_types": gather("$.event_type"),
        "source_timestamps": times,
        "asset_ids": F.array_sort(F.array_distinct(F.flatten(F.transform(events, event_tokens)))),
        "source_timestamp": F.when(F.size(times) == 1, times[0]),
    }
