"""Sinks: verdicts, evidence packages and the stored verdict table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicon as lx


def write_verdicts(verdicts: DataFrame, path: str, mode: str = "append") -> None:
    verdicts.write.mode(mode).partitionBy("verdict").parquet(path)


def write_evidence_packages(packages: DataFrame, path: str, mode: str = "append") -> None:
    packages.write.mode(mode).partitionBy("status").parquet(path)


def write_cache(cache: DataFrame, path: str, version: str = lx.CACHE_SCHEMA_VERSION) -> None:
    """Stored as one generation per version, partitioned by the first two hash digits.

    Rows are dealt by ranges of the hash, so each partition is few large files and any
    number of tasks can write.  A new generation must go to a new ``path``: a table is never overwritten while read.
    """
    out = cache.withColumn("version", F.lit(version)).withColumn("slot", F.substring("claim_hash", 1, 2))
    out.repartitionByRange("slot", "claim_hash").write.mode("errorifexists").partitionBy("version", "slot").parquet(path)


def read_cache(spark: SparkSession, path: str, version: str = lx.CACHE_SCHEMA_VERSION) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("version") == version).drop("version", "slot")
