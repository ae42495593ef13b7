"""Live capture with transports that the caller supplies: nothing here opens a connection of its own.

FrameSource is a streaming data source of a feed's frames (option connect: "module:function", which is called with the
session, the tokens and the first position and gives (payload, position) pairs, text or bytes); read_books() performs
reads of a plan of requests on the executors. Both give records of the evidence's schemas; what fails is a record of its
own, never an exception that loses what came before it.
"""

from __future__ import annotations

import base64
import time
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from decimal import Decimal
from hashlib import sha256
from importlib import import_module
from itertools import islice
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from bookloom.plans.config import Boundary

from .schemas import REST

FRAMES = "collector_session_id string, ingest_sequence bigint, received_at string, received_monotonic_ns bigint, subscribed_token_ids array<string>, payload_kind string, raw_payload string, raw_payload_sha256 string"
#: transport(url, seconds) -> (status, body); TimeoutError and OSError are failures of the read.
Transport = Callable[[str, float], tuple[int, bytes]]
READS = REST + ", failure string, message string"


def now() -> str:
    return datetime.now(UTC).isoformat(timespec="microseconds").replace("+00:00", "Z")


def payload(raw: str | bytes) -> tuple[str, str, str]:
    """payload_kind, raw_payload and its digest; bytes are kept as base64."""
    if isinstance(raw, str):
        return "text", raw, sha256(raw.encode("utf-8", "surrogatepass")).hexdigest()
    return "bytes_base64", base64.b64encode(raw).decode(), sha256(raw).hexdigest()


class _Frames(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        module, _, function = options["connect"].partition(":")
        self.connect = getattr(import_module(module), function)
        self.session, self.tokens, self.most = options["session"], options["tokens"].split(","), int(options.get("most", "10000"))

    def initialOffset(self) -> dict:
        return {"position": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        """At most `most` frames; what a source has not given yet comes with the next batch."""
        rows, last = [], start["position"]
        for raw, position in islice(self.connect(self.session, self.tokens, start["position"]), self.most):
            rows.append((self.session, position, now(), time.monotonic_ns(), self.tokens, *payload(raw)))
            last = position + 1
        return iter(rows), {"position": last}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """A batch that is replayed after a failure: the source gives the same frames for the same positions."""
        for raw, position in self.connect(self.session, self.tokens, start["position"]):
            if position >= end["position"]:
                return
            yield self.session, position, now(), time.monotonic_ns(), self.tokens, *payload(raw)

    def commit(self, end: dict) -> None:
        pass


class FrameSource(DataSource):
    """spark.dataSource.register(FrameSource); spark.readStream.format("bookloom_frames").options(connect=, session=, tokens=)"""

    @classmethod
    def name(cls) -> str:
        return "bookloom_frames"

    def schema(self) -> str:
        return FRAMES

    def simpleStreamReader(self, schema):
        return _Frames(self.options)


def poll_plan(spark: SparkSession, tokens: DataFrame, start: datetime, seconds: int, interval: int) -> DataFrame:
    """token_id, due, request_context of a periodic poll: every token once an interval, from the start on."""
    rounds = spark.range(max(0, -(-seconds // interval))).select(F.col("id").alias("round"))
    due = F.timestamp_seconds(F.lit(start.replace(tzinfo=UTC).timestamp()) + F.col("round") * interval)
    context = F.create_map(F.lit("request_purpose"), F.lit("periodic_poll"))
    listed = tokens.agg(F.collect_set("token").alias("tokens"))  # a subscription is one message: its list fits a row
    return rounds.crossJoin(listed).select(F.explode("tokens").alias("token_id"), due.alias("due"), context.alias("request_context"))


def targeted_plan(requests: DataFrame) -> DataFrame:
    """The reads that rest.targeted_requests() asks for; those it rejects are left out."""
    purpose = F.create_map(F.lit("request_purpose"), F.lit("empty_side_boundary_candidate"), F.lit("candidate_id"), F.col("candidate_id"), F.lit("candidate_kind"), F.col("kind"))
    return requests.where("code IS NULL").select("token_id", F.current_timestamp().alias("due"), purpose.alias("request_context"))


def read_books(plan: DataFrame, boundary: Boundary, transport: Transport, seconds: float = 8.0, wait: bool = True) -> DataFrame:
    """A record per request of the plan: responses as of REST, and failure (rest_timeout, rest_transport_error) with message.

    wait: a request is made when it is due. Every request is checked against the boundary, and a redirect is refused.
    """
    names = [c.strip().split(" ")[0] for c in READS.replace("map<string,string>", "map").split(", ")]

    def one(token: str, due: pd.Timestamp, context: dict) -> dict:
        url = f"https://{boundary.host}{boundary.path}?{boundary.key}={quote(token, safe='')}"
        boundary.check("GET", url)
        if wait and (left := due.timestamp() - time.time()) > 0:
            time.sleep(left)
        row = dict.fromkeys(names) | {"token_id": token, "url": url, "http_method": "GET", "request_started_at": now(), "request_context": dict(context)}
        began = time.monotonic_ns()
        try:
            status, body = transport(url, seconds)
            boundary.check_response(status)
        except TimeoutError as e:
            return row | {"failure": "rest_timeout", "message": str(e)}
        except OSError as e:  # a refused redirect among them
            return row | {"failure": "rest_transport_error", "message": str(e)}
        kind, text, digest = payload(_text(body))
        took = format(Decimal(time.monotonic_ns() - began) / 1_000_000, "f")
        return row | {"received_at": now(), "elapsed_ms": took, "status_code": status, "payload_kind": kind, "raw_response": text, "raw_response_sha256": digest}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for token, due, context in zip(b["token_id"], b["due"], b["request_context"], strict=True):
                yield pd.DataFrame([one(token, due, context)], columns=names).astype({"status_code": "Int32", "ingest_sequence": "Int64", "state_version_before": "Int64", "state_version_after": "Int64"})

    return plan.select("token_id", "due", "request_context").mapInPandas(run, READS)


def _text(body: bytes) -> str | bytes:
    try:
        return body.decode("utf-8")
    except UnicodeDecodeError:
        return body


def run_until(queries: list[StreamingQuery], seconds: float, step: float = 0.2) -> None:
    """Runs capture queries together for so long: the first failure stops all and is raised; else all are stopped."""
    end = time.monotonic() + seconds
    try:
        while time.monotonic() < end and any(q.isActive for q in queries):
            for q in queries:
                if (e := q.exception()) is not None:
                    raise e
            time.sleep(step)
        for q in queries:
            if q.isActive:
                q.processAllAvailable()
    finally:
        for q in queries:
            q.stop()
