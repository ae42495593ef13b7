"""The queries of this package over the driver's tables, and their SQL for DuckDB where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, gam, gif, mixing, packing, pii, pivots, secrets, simhash, suffix_dedup
from .storage import ship

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _over(table: str, run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: run(_table(spark, sf_dir, table))


QUERIES: dict[str, Query] = {
    "op1_secret_scan": _over("documents", secrets.scan_digests),
    "op2_suffix_dedup": _over("documents", suffix_dedup.cut_digests),
    "op3_chat_format": _over("conversations", chat.format_digests),
    "op4_source_mix": _over("documents", mixing.mix_digests),
    "op5_pivot_dedup": _over("embeddings", pivots.near_duplicates),
    "op6_quality_gam": lambda spark, d: gam.quality_digests(_table(spark, d, "documents"), _table(spark, d, "labels")),
    "op7_pii_spans": _over("documents", pii.span_digests),
    "op8_best_fit_pack": _over("documents", packing.pack_documents),
    "op9_simhash_dedup": _over("documents", simhash.group_digests),
    "op10_gif_media": _over("documents", gif.media_digests),
}


def _secret_sql() -> str:
    """Matched strings and the strings between them; sums of their lengths give the places."""
    text = "coalesce(text, '')"
    parts = []
    for rank, r in enumerate(secrets.RULES):
        pattern = r.pattern.replace("++", "+").replace(",}+", ",}").replace("'", "''")
        part = f"regexp_extract(m, '{pattern}', {r.group})" if r.group else "m"
        parts.append(f"""
  SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, {r.base} AS base, i,
         list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda h: length(h))), 0) AS s,
         hits[i] AS m
  FROM (SELECT doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM
        (SELECT doc_id, regexp_extract_all({text}, '{pattern}', 0) AS hits, regexp_split_to_array({text}, '{pattern}') AS gaps
         FROM documents WHERE regexp_matches({text}, '{pattern}')))
  WHERE length({part.replace("m,", "hits[i],") if r.group else "hits[i]"}) >= {r.least}""")
    body = "\n  UNION ALL".join(parts)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.RULES if r.base)
    joined = "string_agg(kind || ':' || s::BIGINT || ':' || (s + length(m))::BIGINT, ',' ORDER BY s, rank)"
    names = ", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in secrets.RULES if r.base)
    return f"""WITH hit AS ({body}),
per AS (SELECT doc_id, {counts}, {joined} FILTER (base) AS base_spans, {joined} AS spans FROM hit GROUP BY doc_id)
SELECT d.doc_id, {names}, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN per USING (doc_id)"""


_CHAT_SQL = r"""WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (7 + sum(8 + 8 + 7 + length(regexp_replace(role, '(\\|<\||<s>|</s>|\[INST\]|\[/INST\])', '\1+', 'g'))
              + length(regexp_replace(text, '(\\|<\||<s>|</s>|\[INST\]|\[/INST\])', '\1+', 'g'))))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id"""

_MIX_SQL = r"""WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, length(coalesce(text, '')) AS chars, text
  FROM documents),
keyed AS (
  SELECT *, -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)
            / (1.0 / (1.0 + abs(chars::DOUBLE / greatest(size, 1) - 6.0) / 6.0)) AS key
  FROM base),
sized AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0 AS cap FROM sized),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (rising ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (rising ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW rising AS (ORDER BY cap / weight, source NULLS LAST)),
goal AS (
  SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, cap / weight) FROM levels WHERE level * weight <= cap) * weight, cap))::DOUBLE AS target
  FROM levels),
ranked AS (
  SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS ahead FROM keyed),
planned AS (
  SELECT r.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END::BIGINT AS epochs
  FROM ranked r JOIN goal g ON r.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN ahead + size / 2.0 <= target - epochs * source_size AND epochs < 3 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM planned"""

SQL: dict[str, str] = {
    "op1_secret_scan": _secret_sql(),
    "op3_chat_format": _CHAT_SQL,
    "op4_source_mix": _MIX_SQL,
}
