"""Evidence runs: append-only record files, write-once documents, manifests."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.operators.ordered import numbered

from .schemas import ARCHIVE, CONTROL, HEARTBEAT, REST, WEBSOCKET

FILES = {"websocket": ("raw-websocket.jsonl", WEBSOCKET), "rest": ("raw-rest-book.jsonl", REST), "control": ("control-events.jsonl", CONTROL)}


#: Where a record stands: its file, the block of it that a task reads, and the place in that.
PLACE = ("file", "block", "place")
#: Larger files are digested as a stream, one after the other, not as a row.
LARGE = 256 << 20


def read_records(spark: SparkSession, run_dir: str, kind: str, place: bool = False) -> DataFrame:
    """One of the three record files of a run, or of many by a path pattern; place: with PLACE, the order of arrival."""
    name, schema = FILES[kind]
    rows = spark.read.schema(schema).json(f"{run_dir}/{name}")
    if not place:
        return rows
    return rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))


def read_records_stream(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """The same records as files land in a folder."""
    return spark.readStream.schema(FILES[kind][1]).json(folder)


def read_document(spark: SparkSession, path: str) -> tuple[dict, str]:
    """A summary document and its SHA-256; it must be an object with a run object."""
    raw = spark.read.format("binaryFile").load(path).select("content").first()[0]
    value = json.loads(bytes(raw))
    if not isinstance(value, dict) or not isinstance(value.get("run"), dict):
        raise ValueError("a baseline summary is an object with a run object")
    return value, hashlib.sha256(bytes(raw)).hexdigest()


def with_status(records: DataFrame, payload: str = "raw_payload", kind: str = "payload_kind") -> DataFrame:
    """Adds digest, decoded (VARIANT) and parse_status of text or base64 payloads.

    Only the text heartbeat is one; a JSON that VARIANT refuses (repeated keys, NaN) is invalid_json.
    """
    raw = F.col(payload)
    content = F.when(F.col(kind) == "bytes_base64", F.unbase64(raw)).otherwise(F.encode(raw, "UTF-8"))
    out = records.withColumn("__bl_content", content).withColumn("__bl_text", F.when(F.is_valid_utf8("__bl_content"), F.decode("__bl_content", "UTF-8")))
    decoded = F.try_parse_json("__bl_text")
    status = (
        F.when((F.col(kind) == "text") & (raw == HEARTBEAT), "expected_heartbeat")
        .when(F.col("__bl_text").isNull(), "invalid_utf8")
        .when(decoded.isNull(), "invalid_json")
        .otherwise("ok")
    )
    return out.withColumns({"digest": F.sha2("__bl_content", 256), "parse_status": status, "decoded": decoded}).drop("__bl_content", "__bl_text")


def _path(spark: SparkSession, name: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(name)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, run_dir: str) -> DataFrame:
    """file (below run_dir), bytes, sha256 and modified of a run's files, of any size; content never becomes a driver's row."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(run_dir)
    base = F.regexp_replace(F.lit(_path(spark, run_dir)[0].toUri().getPath()), "/+$", "")
    file = F.expr("substring(url_decode(replace(regexp_replace(path, '^[A-Za-z0-9+.-]+:(//[^/]*)?', ''), '+', '%2B')), length(base) + 2)")
    columns = (file.alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    small = found.where(F.col("length") < LARGE).withColumn("base", base).select(*columns, F.sha2("content", 256).alias("sha256"))
    rows = []
    for r in found.where(F.col("length") >= LARGE).withColumn("base", base).select("path", *columns).collect():  # names of large files
        p, fs = _path(spark, r["path"])
        stream = fs.open(p)
        try:
            rows.append((r["file"], r["bytes"], r["modified"], spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)))
        finally:
            stream.close()
    return small.unionByName(spark.createDataFrame(rows, small.schema)) if rows else small


def canonical_json(columns: list[str]):
    """One object of the columns with keys in order; nulls stay."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def write_records(df: DataFrame, run_dir: str, kind: str) -> None:
    """Append-only per run: a run that exists is refused."""
    df.select(canonical_json(df.columns).alias("value")).write.mode("errorifexists").text(f"{run_dir}/{FILES[kind][0]}")


def canonical_text(value) -> str:
    """A document's JSON: keys in order, no blanks, text as it is."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def write_text(spark: SparkSession, path: str, text: str, replace: bool = False) -> None:
    """A small text as one file in any store that Spark reaches; one that exists is refused unless it may be replaced."""
    p, fs = _path(spark, path)
    out = fs.create(p, replace)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def write_once(spark: SparkSession, path: str, value) -> None:
    write_text(spark, path, canonical_text(value) + "\n")


@dataclass
class EvidenceRun:
    """A run's folder: a new one, or nothing. Records are appended with one sequence over all kinds; closing writes the
    manifest, after which nothing is added."""

    spark: SparkSession
    root: str
    run_id: str
    last_sequence: int = 0
    closed: bool = False
    counts: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        p, fs = _path(self.spark, self.path)
        if fs.exists(p):
            raise FileExistsError(self.path)
        fs.mkdirs(p)

    @property
    def path(self) -> str:
        return f"{self.root.rstrip('/')}/{self.run_id}"

    def start(self, config: dict) -> None:
        write_once(self.spark, f"{self.path}/initial-config.json", config)

    def resolve(self, config: dict) -> None:
        write_once(self.spark, f"{self.path}/resolved-config.json", config)

    def append(self, df: DataFrame, kind: str, ranges: list[str], order: list[str]) -> None:
        """Rows in order get the next sequence numbers and become a new part of their record file; ranges and order as of ordered."""
        if self.closed:
            raise RuntimeError("a closed run takes no records")
        numbers = numbered(df.drop("ingest_sequence"), ranges, order, "ingest_sequence", self.last_sequence)
        keep = [c.strip().split(" ")[0] for c in FILES[kind][1].split(", ")]
        rows = numbers.select(*(F.col(c) for c in keep if c in numbers.columns))
        part = f"{self.path}/{FILES[kind][0]}"
        rows.select(canonical_json(rows.columns).alias("value")).write.mode("append").text(part)
        total = self.spark.read.text(part).count()
        self.last_sequence += total - self.counts.get(kind, 0)
        self.counts[kind] = total

    def close(self, summary: dict | None = None, report: str | None = None) -> dict:
        """The manifest of what was written; summary and report are written beside it, once."""
        self.closed = True
        files = {r["file"]: {"bytes": r["bytes"], "sha256": r["sha256"]} for r in manifest(self.spark, self.path).collect()}
        found = {"algorithm": "sha256", "files": files}
        write_once(self.spark, f"{self.path}/manifest.json", found)
        if summary is not None:
            write_once(self.spark, f"{self.path}/summary.json", summary)
        if report is not None:
            write_text(self.spark, f"{self.path}/report.md", report)
        return found


def write_shard(df: DataFrame, root: str, shard: int) -> None:
    """An immutable checkpoint of one shard."""
    df.write.mode("errorifexists").parquet(f"{root}/shard={shard}")


def check_shards(spark: SparkSession, shards: DataFrame, count: int, sample: str) -> DataFrame:
    """shard, problem: missing, duplicate or wrong_sample; shards: shard, sample of each checkpoint."""
    want = spark.range(count).select(F.col("id").cast("int").alias("shard"))
    missing = want.join(shards, "shard", "left_anti").select("shard", F.lit("missing").alias("problem"))
    twice = shards.groupBy("shard").count().where("count > 1").select("shard", F.lit("duplicate").alias("problem"))
    wrong = shards.where(~F.col("sample").eqNullSafe(F.lit(sample))).select("shard", F.lit("wrong_sample").alias("problem"))
    return missing.unionByName(twice).unionByName(wrong)


def read_archive(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Hourly archive files; only the columns asked for are read."""
    found = spark.read.schema(ARCHIVE).parquet(path)
    return found.select(*columns) if columns else found


def file_provenance(spark: SparkSession, rows: DataFrame, time: str, asked: dict[str, str] | None = None) -> DataFrame:
    """file, bytes, modified, sha256, rows, first and last time, schema of each file that a scan reads; asked: what was
    asked for by file name, where another file took its place. rows: straight from a reader."""
    per = rows.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file")).agg(
        F.max("_metadata.file_size").alias("bytes"), F.max("_metadata.file_modification_time").alias("modified"), F.count("*").alias("rows"), F.min(time).alias("first"), F.max(time).alias("last"),
    )
    requested = F.element_at(F.create_map(*(F.lit(x) for pair in asked.items() for x in pair)), F.col("file")) if asked else F.lit(None).cast("string")
    folders = sorted({r["path"].rsplit("/", 1)[0] for r in per.select("path").collect()})  # names of files
    digests = None
    for folder in folders:
        one = manifest(spark, folder).where(~F.col("file").contains("/")).select("file", "sha256")
        digests = one if digests is None else digests.unionByName(one)
    out = per.drop("path").withColumns({"requested": requested, "schema": F.lit(rows.schema.json())})
    return out.join(digests, "file", "left") if digests is not None else out.withColumn("sha256", F.lit(None).cast("string"))


#: Parts of a vendor's sample bundle, and how a file's ending is read.
BUNDLE = ("raw", "l1", "l2", "trades")
READERS = {"parquet": "parquet", "jsonl": "json", "json": "json", "csv": "csv"}


def read_bundle(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The parts that a local vendor bundle holds, by folder name, each with its file; nothing is downloaded."""
    if "://" in root and not root.startswith("file:"):
        raise PermissionError("a vendor bundle is read from a local path only")
    p, fs = _path(spark, root)
    found = {}
    for name in BUNDLE:
        for ending, reader in READERS.items():
            if files := [s.getPath().toString() for s in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(p, f"{name}/*.{ending}")) or ()]:
                rows = spark.read.option("header", "true").format(reader).load(files)
                found[name] = rows.select("*", F.col("_metadata.file_name").alias("source_file"), F.lit(name).alias("source_part"))
                break
    return found


def schema_drift(df: DataFrame, expected: str = ARCHIVE) -> list[tuple[str, str | None, str | None]]:
    """column, expected type, observed type of each that differs; unknown columns are told, not dropped."""
    spark = df.sparkSession
    want = {f.name: f.dataType.simpleString() for f in spark.createDataFrame([], expected).schema}
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    return [(c, want.get(c), have.get(c)) for c in sorted({*want, *have}) if want.get(c) != have.get(c)]


def pick_samples(requested: list[datetime], available: set[datetime]) -> dict[datetime, datetime]:
    """For each requested hour the first available hour of that date at or after it; below two, nothing is decided."""
    found = {}
    for hour in requested:
        later = [h for h in available if hour <= h < datetime(hour.year, hour.month, hour.day, tzinfo=hour.tzinfo) + timedelta(days=1)]
        if later:
            found[hour] = min(later)
    if len(set(found.values())) < 2:
        raise LookupError("UNRESOLVED: fewer than two samples")
    return found


def utc_now() -> str:
    return datetime.now(UTC).isoformat(timespec="microseconds").replace("+00:00", "Z")
