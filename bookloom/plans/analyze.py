"""From the record files of a run to its verdicts: read, decode, replay, align, judge."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.functions import bookhash, exact, wire
from bookloom.operators import frames, replay, repeats, rest, timing
from bookloom.sources import evidence
from bookloom.sources.schemas import BOOK_METADATA, REST_FIELDS
from bookloom.sources.staging import staged

from . import summary, verdicts

KEEP = ("session_id", "seq", "event_index")


@dataclass
class Analysis:
    """Every table of a run's analysis; nothing is gathered before a summary is made."""

    frames: DataFrame
    events: DataFrame
    books: DataFrame
    entries: DataFrame
    fates: DataFrame
    reads: DataFrame
    failed: DataFrame
    attempts: DataFrame
    candidates: DataFrame
    validations: DataFrame
    timed: DataFrame
    order: DataFrame
    receive: DataFrame
    sessions: DataFrame
    first: DataFrame
    paths: DataFrame
    hashes: DataFrame
    change_frames: DataFrame
    repeats: DataFrame
    direct: DataFrame
    presence: DataFrame
    per_token: DataFrame
    errors: DataFrame
    verdicts: DataFrame


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _rest_reads(spark: SparkSession, run_dir: str) -> DataFrame:
    raw = evidence.read_records(spark, run_dir, "rest").drop("parse_status")
    r = evidence.with_status(raw, "raw_response").withColumnRenamed("ingest_sequence", "seq")
    fields = F.array_compact(F.array(*(F.when(wire.has(F.col("decoded"), f"$.{x}"), F.lit(x)) for x in REST_FIELDS)))
    r = r.withColumns({"is_object": F.coalesce(wire.wire_type(F.col("decoded")) == "object", F.lit(False)), "fields": fields})
    return rest.outcome(r.withColumn("rest_id", F.col("seq")))


def control_events(spark: SparkSession, run_dir: str) -> DataFrame:
    """Control events with the details that operators read."""
    text = lambda path: F.try_variant_get("details", f"$.{path}", "string")
    return evidence.read_records(spark, run_dir, "control").select(
        "ingest_sequence", "event", text("session_id").alias("session_id"), F.coalesce(text("disconnect_error"), text("error")).alias("error"),
        F.try_variant_get("details", "$.controlled_disconnect", "boolean").alias("controlled"), text("token_id").alias("token_id"),
        text("request_context.candidate_id").alias("candidate_id"), text("message").alias("message"),
    )


def analyze(spark: SparkSession, run_dir: str, tokens: tuple[str, ...]) -> Analysis:
    raw = evidence.read_records(spark, run_dir, "websocket", place=True).drop("parse_status")
    seen = evidence.with_status(raw).withColumnsRenamed({"collector_session_id": "session_id", "ingest_sequence": "seq"})
    seen = staged(seen.select("session_id", "seq", "received_at", "received_monotonic_ns", "digest", "parse_status", "decoded", *evidence.PLACE), "frames")
    found = staged(frames.events(seen, ("session_id", "seq", "received_at")), "events")
    books = staged(frames.books(found, KEEP), "books")
    entries = staged(frames.entries(found, KEEP), "entries")
    levels = frames.level_rows(found, KEEP).where("level_code IS NULL").join(books.where("code IS NULL").select(*KEEP, "asset_id"), list(KEEP))
    levels = staged(levels, "book-levels")
    numbered = staged(replay.number_events(books, entries), "numbered")
    changed = staged(replay.level_events(numbered, levels), "levels")
    fates = staged(replay.judge(numbered, changed), "fates")
    versions = staged(replay.versions(books, fates), "versions")

    control = control_events(spark, run_dir)
    failures = staged(timing.failures(control), "failures")

    # state at each REST receipt, then the recorded windows
    reads = _rest_reads(spark, run_dir)
    reads = rest.as_of(reads.withColumn("asset_id", F.col("token_id")), versions.select("asset_id", "seq", "version"), ["asset_id"], "seq", ["version"])
    at = numbered.select("asset_id", "seq", "session_id", "epoch", "n")
    reads = rest.as_of(reads, at, ["asset_id"], "seq", ["session_id", "epoch", "n"])
    bad = fates.groupBy(*replay.KEY).agg(F.min("first_bad").alias("first_bad"))
    reads = reads.join(bad, replay.KEY, "left")
    valid = F.coalesce((F.col("epoch") > 0) & (F.col("first_bad").isNull() | (F.col("first_bad") > F.col("n"))), F.lit(False))
    now = {"now_valid": valid, "now_session": F.col("session_id"), "now_version": F.coalesce("version", F.lit(0))}
    reads = staged(rest.align(reads.withColumns(now)).withColumn("aligned", F.col("aligned") & F.col("code").isNull()), "reads")
    as_event = reads.where("code IS NULL").select("rest_id", F.col("decoded").alias("event"), F.lit("book").alias("event_type"), F.lit(None).cast("string").alias("code"))
    rest_levels = staged(frames.level_rows(as_event, ("rest_id",)), "rest-levels")
    broken = rest_levels.where("level_code IS NOT NULL").groupBy("rest_id").agg(F.min_by("level_code", F.struct("side", "level_index")).alias("level_code"))
    full = rest_levels.groupBy("rest_id").agg(F.count_if(F.col("side") == "BUY").alias("bid_levels"), F.count_if(F.col("side") == "SELL").alias("ask_levels"))
    match = rest.depth_matches(reads.where("epoch > 0 AND code IS NULL"), rest_levels.select("rest_id", "side", "price", "size"), changed)
    reads = reads.join(broken, "rest_id", "left").join(full, "rest_id", "left").join(match, "rest_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)) == 0
    reads = reads.withColumns({"malformed": F.col("level_code").isNotNull(), "bids_empty": zero("bid_levels"), "asks_empty": zero("ask_levels")})
    # a malformed book is no comparison
    reads = staged(reads.withColumn("compared", F.col("aligned") & ~F.col("malformed")), "reads")

    named = rest.candidates(fates, versions)
    targeted = reads.where(F.col("request_context")["request_purpose"] == "empty_side_boundary_candidate").withColumn("candidate_id", F.col("request_context")["candidate_id"])
    failed = rest.failed_reads(failures)
    attempts = staged(rest.candidate_attempts(named, _union(targeted, failed.where("candidate_id IS NOT NULL"))), "attempts")
    good = attempts.where("outcome = 'CONFIRMED'").select("candidate_id").distinct().withColumn("confirmed", F.lit(True))
    named = staged(named.join(good, "candidate_id", "left").withColumn("confirmed", F.coalesce("confirmed", F.lit(False))), "candidates")
    validated = staged(rest.validations(fates, books, reads.where("compared AND full_match").select("asset_id", "seq")), "validations")

    # times: a row per event, then per event and token
    e = F.col("event")
    timed = staged(timing.timed_events(found, KEEP).drop("session_id"), "timed")
    per = timed.where("code IS NULL").select("seq", "event_index", "event_type", "source_ms", "stamp", F.explode("tokens").alias("token"))
    order = staged(timing.source_order(per), "order")
    subscribed = spark.createDataFrame([(t,) for t in tokens], "token string")
    per_token = subscribed.join(timing.order_counters(order), "token", "left").fillna(0)
    arrived = seen.select(F.col("seq").alias("ingest_sequence"), "received_monotonic_ns", *evidence.PLACE)
    receive = staged(frames.receive_order(arrived, ["place"], ["file", "block"]), "receive")

    sessions = timing.session_table(control)
    states = books.where("code IS NULL").select("session_id", F.col("asset_id").alias("token"), "seq", "event_index", F.lit(-1).alias("change_index"), F.lit("book").alias("event_type"))
    states = states.unionByName(entries.where("asset_id IS NOT NULL").select("session_id", F.col("asset_id").alias("token"), "seq", "event_index", "change_index", F.lit("price_change").alias("event_type")))
    first = timing.first_state_events(states, timing.session_grid(sessions.select("session_id"), subscribed))

    # digests of accepted books, of books after each applied entry, and of read books
    book_events = found.where("code IS NULL AND event_type = 'book'")
    accepted = book_events.join(books.where("code IS NULL").select(*KEEP, "asset_id"), list(KEEP))
    digests = _union(
        accepted.select(F.lit("book").alias("shape"), "seq", "asset_id", wire.text_of(e, "$.hash").alias("observed"), bookhash.event_hash(e).alias("computed")),
        replay.change_hashes(replay.hash_points(found, fates), changed, replay.hash_books(found, numbered)).select(F.lit("change").alias("shape"), "seq", "asset_id", "observed", "computed"),
        reads.where("code IS NULL").select(F.lit("rest").alias("shape"), "seq", "asset_id", wire.text_of(F.col("decoded"), "$.hash").alias("observed"), bookhash.event_hash(F.col("decoded")).alias("computed")),
    )
    digests = staged(digests, "digests")
    unhashed = _union(
        accepted.select("seq", "event_type", bookhash.attempt_code(e).alias("code")),
        reads.where("code IS NULL").select("seq", F.lit("rest_book").alias("event_type"), bookhash.attempt_code(F.col("decoded")).alias("code")),
    ).where("code = 'hash_levels_malformed'")

    presence = book_events.select(*(wire.has(e, f"$.{x}").alias(x) for x in BOOK_METADATA))
    paths = staged(wire.field_paths(found.where("code IS NULL").withColumn("k", F.struct("seq", "event_index")), "k"), "paths")
    number = lambda c: F.coalesce(exact.plain_text(F.col(c)), F.col(f"{c}_text"))
    keyed = entries.where("NOT by_frame").select(F.struct("seq", "event_index").alias("frame"), "change_index", "asset_id", "side", number("price").alias("price_key"), number("size").alias("size_key"))
    repeated = staged(repeats.frame_repeats(keyed), "repeats")
    change_frames = frames.change_frames(found, KEEP)
    # direct: the only entry of its asset in its frame
    alone = entries.groupBy(*KEEP, "asset_id").agg(F.count("*").alias("own"))
    direct = fates.where("comparison = 'mismatch'").join(alone, [*KEEP, "asset_id"]).agg(F.count_if(F.col("own") == 1).alias("direct_mismatches"))
    back = receive.agg(F.count_if("sequence_regressed").alias("sequence_regressions"), F.count_if("monotonic_regressed").alias("monotonic_regressions"))
    told = _union(
        verdicts.schema(frames.event_counts(found), frames.ordering_fields(paths, "k")), verdicts.reconnect(sessions, first),
        verdicts.updates(replay.update_counters(fates).crossJoin(direct), validated.groupBy("discriminating", "verdict").agg(F.count("*").alias("updates")), named),  # a row each
        verdicts.repeats(repeats.repeat_counters(repeated)), verdicts.hashes(digests),
        verdicts.rest(rest.field_presence(reads), reads.select(F.col("compared").alias("aligned"), "full_match")), verdicts.metadata(presence, BOOK_METADATA), verdicts.times(per_token, back),
    )

    mismatch = fates.where("comparison = 'mismatch'")
    errors = _union(
        frames.event_errors(found, ("seq",)), frames.receive_errors(receive).withColumnRenamed("ingest_sequence", "seq"), books.select("seq", F.lit("book").alias("event_type"), "asset_id", "code"),
        fates.where("NOT by_frame").select("seq", F.lit("price_change").alias("event_type"), "asset_id", "change_index", F.col("reason").alias("code")),
        mismatch.select("seq", F.lit("price_change").alias("event_type"), "asset_id", "change_index", F.lit("best_bid_ask_mismatch").alias("code")),
        fates.where("comparison = 'unparseable'").select("seq", F.lit("price_change").alias("event_type"), "asset_id", "change_index", F.coalesce("best_bid_code", "best_ask_code").alias("code")),
        reads.select("seq", "asset_id", F.coalesce("code", F.when(F.col("aligned"), F.col("level_code"))).alias("code")), unhashed,
        timed.select("seq", "event_type", "code"), order.where("regressed").select("seq", "event_type", F.col("token").alias("asset_id"), F.lit("source_timestamp_regression").alias("code")),
        failures.select(F.col("ingest_sequence").alias("seq"), F.col("token_id").alias("asset_id"), "message", "code"),
    ).where("code IS NOT NULL")
    return Analysis(
        seen, found, books, entries, fates, reads, failed, attempts, named, validated, timed, order, receive, sessions, first, paths, digests, change_frames, repeated, direct, presence, per_token,
        staged(errors, "errors"), staged(told, "verdicts"),
    )


def summarize(spark: SparkSession, run_dir: str, run: dict, tokens: tuple[str, ...]) -> dict:
    """The run's summary document; run: what the collector's configuration says of it."""
    a = analyze(spark, run_dir, tokens)
    kinds = {k: evidence.read_records(spark, run_dir, k) for k in evidence.FILES}
    records = {r["record_type"]: r["records"] for r in frames.record_counts(*kinds.items()).collect()}
    files = {r["file"]: {"bytes": r["bytes"], "sha256": r["sha256"]} for r in evidence.manifest(spark, run_dir).collect()}
    return summary.assemble(a, {"token_ids": list(tokens)} | run, {"records": records, "run_directory": run_dir, "manifest": {"algorithm": "sha256", "files": files}})
