"""Helpers of the corpus operators: shared folder, stored tables, file access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, [\x20\x09-\x0D]
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share.

    The folder is ``spark.checkpoint.dir``; only a local session without that setting
    gets one of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    if base.startswith("file:/") and not base.startswith("file://"):
        base = "file://" + base[len("file:") :]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage ends there."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: the lineage ends there and partitions stay as they are."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_path(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def width(spark: SparkSession) -> int:
    """Tasks for few rows that carry much work, which adaptive execution would merge."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole(text: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def fold(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    name = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(name.cast("string"), F.lit("")).cast("binary")) % modulus


def filesystem(uri: str):
    """pyarrow's file system for a path in the shared folder, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)
