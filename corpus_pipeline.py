"""The corpus pipeline: stages over `documents`, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binflow import session
from binflow.llm import bpe, decontaminate, language, secrets, shingles
from binflow.llm.common import query, shared_folder, table
from binflow.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "ORACLE_SQL", "QUERIES", "STAGES", "run"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those in none of the languages that the corpus names."""
    session.ship_package(spark)
    return language.recognised(docs, language.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near copies (five-word shingles, Jaccard
    0.8): SimHash fingerprints find them first, an exact search what these leave apart."""
    session.ship_package(spark)
    return shingles.deduplicated(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap a benchmark item."""
    session.ship_package(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mask in the place of each secret; n_chars follows the text."""
    out = secrets.masked(docs, secrets.scan(docs))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text, with digests of the ids and of the text decoded from them."""
    session.ship_package(spark)
    return bpe.round_trip(docs, bpe.default_path(), ids=True)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("secrets", mask_secrets),
    ("bpe", encode),
]

#: No SQL expresses the stages; tests hold them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        folder = shared_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs


query("pipeline", ORACLE_SQL)(run)
