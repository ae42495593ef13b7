"""From raw documents to packed sequences: five stages, each written and read again before the next.

All stages: null texts are empty texts; texts of any length are whole; repeated rows are handled each; an empty table
gives an empty table; all but the last return the columns of documents, whatever else they are named, in their order and
with their types. What each keeps, and how it settles ties, is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bookloom.llm import gam, mixing, packing, pii, simhash
from bookloom.llm.storage import materialize, ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Empty texts are scored like others; equal texts share a fate;
    without labels every document is scored alike."""
    ship(spark)
    return gam.keep_good(docs, gam.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more. It is the one of the
    smallest id (null ids count as smaller); of rows that share that id and text one stays. Texts without words are
    copies of each other."""
    ship(spark)
    return simhash.keep_one(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; where spans overlap the first one's. Null texts stay null."""
    ship(spark)
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come at their target weights; documents are repeated or left out, those without words always. Keys that tie
    go by id; the null source is a source."""
    ship(spark)
    return mixing.take(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences; an empty text is its end id alone, a row that the mix repeats is packed
    as often."""
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("personal data", private),
    ("source mix", mix),
    ("best-fit packing", pack),
]

#: Classifiers, fingerprints and tokens have no SQL form; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return docs
