"""Secret scans through an incremental blob ledger.

Every version of a text is a blob named by the SHA-256 of its content. The ledger says which rule
versions have seen which blob; a scan reads only the blobs that some rule version has not seen, by the text
of one path however many hold them, and findings are joined back to all paths. scan_into() keeps the ledger as
Parquet: what a scan adds is a new part, and the next scan, of the same versions, of later ones or with other
rule versions, reads it first.

Defined results: a null text is the empty text; repeated paths and copies keep a row each; a text of any length is
scanned whole; equal spans are told once; an empty table gives an empty result; other columns of the input,
whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spans import digest_text, find_spans
from .storage import fresh_path, is_there, materialize

_ASSIGN = (
    "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
    "|[aA][pP][iI]_?[kK][eE][yY])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    #: A group of the match and the characters it needs at least.
    group: int = 0
    least: int = 0
    base: bool = True

    @property
    def key(self) -> str:
        return f"{self.kind}/{self.version}"

    def spans(self, text: Column) -> Column:
        found = find_spans(text, self.pattern)
        if self.least:
            part = (lambda m: F.regexp_extract(m, self.pattern, self.group)) if self.group else (lambda m: m)
            found = F.filter(found, lambda s: F.length(part(s["text"])) >= self.least)
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


#: Maximal runs shorter than the limit fail as a whole, so limits on runs may stand in the pattern.
RULES = (
    Rule("assign", 1, _ASSIGN, group=2, least=6),
    Rule("access", 1, "AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, "[0-9a-f]{24,}"),
    Rule("pem", 1, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", base=False),
    Rule("github", 1, "gh[pousr]_[A-Za-z0-9]{36,}", base=False),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", base=False),
)
RESULTS = "array<struct<rule:string,spans:array<struct<start:int,end:int>>>>"


def blobs(versions: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """path, blob and text of each version."""
    body = F.coalesce(F.col(text), F.lit(""))
    return versions.select(F.col(path).alias("path"), F.sha2(body, 256).alias("blob"), body.alias("body"))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> DataFrame:
    """New ledger rows (blob, results) of the pairs of blob and rule version that the ledger lacks.

    versions: as of blobs(). One path of each blob brings its text; the choice of paths is made on
    names and digests alone, so the texts are moved once, by path, evenly whatever is copied.
    """
    chosen = versions.groupBy("blob").agg(F.min("path").alias("path"))
    todo = F.array(*(F.lit(r.key) for r in rules))
    if ledger is None:
        chosen = chosen.withColumn("todo", todo)
    else:
        seen = ledger.groupBy("blob").agg(
            F.array_distinct(F.flatten(F.collect_list(F.transform("results", lambda r: r["rule"])))).alias("seen")
        )
        chosen = (
            chosen.join(seen, "blob", "left")
            .select("blob", "path", F.array_except(todo, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))
            .where(F.size("todo") > 0)
        )
    chosen = chosen.select(F.col("path").alias("at"), F.col("blob").alias("name"), "todo")
    texts = versions.join(chosen, F.col("path").eqNullSafe(F.col("at")) & (F.col("blob") == F.col("name")))

    def result(rule: Rule) -> Column:
        found = F.struct(F.lit(rule.key).alias("rule"), rule.spans(F.col("body")).alias("spans"))
        return F.when(F.array_contains("todo", rule.key), found)

    scanned = F.filter(F.array(*map(result, rules)), lambda r: r.isNotNull()).cast(RESULTS)
    # a row for each blob, also where a path's row is there many times
    return texts.select("blob", scanned.alias("results")).groupBy("blob").agg(F.first("results").alias("results"))


LEDGER = f"blob string, results {RESULTS}"


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.schema(LEDGER).parquet(path) if is_there(spark, path) else None


def scan_into(versions: DataFrame, path: str, rules=RULES) -> DataFrame:
    """The ledger at path, after what it lacked of these versions is scanned and added."""
    spark = versions.sparkSession
    scan_unseen(versions, read_ledger(spark, path), rules).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def findings(versions: DataFrame, ledger: DataFrame, rules=RULES) -> DataFrame:
    """path, blob and spans (kind, start, end, base; by start, then kind as listed) of every version.

    Only the rule versions in force count; the ledger may hold older ones, and a pair twice.
    """
    rank = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))))
    current = [r.key for r in rules]
    hit = lambda r: F.transform(
        F.when(r["rule"].isin(current), r["spans"]).otherwise(F.array().cast("array<struct<start:int,end:int>>")),
        lambda s: F.struct(
            s["start"].alias("start"),
            F.element_at(rank, r["rule"]).alias("rank"),
            s["end"].alias("end"),
            F.substring_index(r["rule"], "/", 1).alias("kind"),
        ),
    )
    by_blob = ledger.groupBy("blob").agg(
        F.array_sort(
            F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("results")), hit)))
        ).alias("spans")
    )
    base = [r.kind for r in rules if r.base]
    by_blob = by_blob.select(
        "blob",
        F.transform(
            "spans",
            lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].isin(base).alias("base")),
        ).alias("spans"),
    )
    # written first: a blob that many paths hold can then be split in the join
    return versions.select("path", "blob").join(materialize(by_blob, "findings"), "blob", "left")


def scan_digests(documents: DataFrame) -> DataFrame:
    """The digest columns of the query, through a ledger that starts empty."""
    versions = blobs(documents)
    found = findings(versions, scan_into(versions, fresh_path(documents.sparkSession, "ledger")))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("path").alias("doc_id"),
        *(count(r.kind).alias(f"n_{r.kind}") for r in RULES if r.base),
        F.sha2(digest_text(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
        digest_text(F.col("spans")).alias("spans"),
    )
