"""A corpus from raw documents: five stages, each written to the shared folder and read by the next.

Documents that the quality classifier rejects go; of near copies one stays; personal data is masked;
sources are interleaved to target weights (no row is dropped; ``position`` is a row's place in the mixture
and goes with it to the end, since files and shuffles keep no order); the last stage returns the tokens of each text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import bpe, mixing, pii, quality, simhash
from riskloom.llm.shared import new_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, shingle=5)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows with ``position``, their place in the mixture."""
    return mixing.mix(docs, mixing.target_weights()).orderBy("position").select(*(c for c in docs.columns if c != "position"), "position")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, position, ids (the tokens of the text), n_tokens, and the digests of ids and of the text decoded from them."""
    return bpe.digests(docs, keep_ids=True, carry="position")


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("byte-level bpe", bpe_stage),
]
#: The classifier's EM and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out, folder = stage(spark, docs, sf_dir), new_folder(spark, "pipeline")
        out.write.parquet(folder)
        docs = spark.read.schema(out.schema).parquet(folder)
    return docs.withColumn("ids", F.concat_ws(" ", F.transform("ids", lambda i: i.cast("string")))) if "ids" in docs.columns else docs
