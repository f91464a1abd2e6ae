"""A corpus pipeline: quality rules, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and gives the next one's documents; every result is written
as Parquet and read again, so a lost executor costs a stage's task, not the pipeline. The last
stage gives packed pieces instead of documents. Texts a stage changes: personal data is replaced by
its kind, and the one document per source at which its target is met is cut there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from idsignal.llm import mixing, packing, pii, quality, simhash
from idsignal.llm.queries import table, tokenizer_path
from idsignal.workspace import stage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the forest keep."""
    return quality.keep(docs, table(spark, sf_dir, "labels"), name="pipeline-quality")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return simhash.keep_one(docs, name="pipeline-simhash")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, name="pipeline-pii")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs, name="pipeline-mixing")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed = packing.pack(docs, ["doc_id", "source"], tokenizer_path(), name="pipeline-packing")
    return packed.select("doc.doc_id", "doc.source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded")


STAGES = [
    ("quality rules", keep_quality),
    ("simhash near-dedup", drop_near_copies),
    ("personal data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
