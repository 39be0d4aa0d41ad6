"""Documents packed into shards, and questions that shards ask about the whole corpus.

A shard is one row with some megabytes of texts, so that numpy works on them together and
what it learns travels as few packed rows.  Shards ask by key: every shard sends its
distinct keys to buckets, a bucket answers each shard from what all shards sent, and the
answers meet the shard again in a join on its number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, whole, width

SHARD_BYTES = 8 << 20
SHARD_DDL = "shard long, ids array<long>, flags array<boolean>, sizes array<long>, text binary"


@dataclass
class Shard:
    """Texts of one shard, in id order (null ids last)."""

    number: int
    ids: list[int | None]
    flags: list[bool]
    bounds: np.ndarray
    text: bytes

    @property
    def bytes(self) -> np.ndarray:
        return np.frombuffer(self.text, np.uint8)


def pack(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def make_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", flag: Column | None = None) -> DataFrame:
    """Pack whole texts, null as empty, into a stored table of shards; ``flag`` is any condition on a row."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), (F.lit(False) if flag is None else F.coalesce(flag, F.lit(False))).alias("flag"),
        F.encode(whole(text_col), "UTF-8").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0
        kind = pa.schema(
            [("shard", pa.int64()), ("ids", pa.list_(pa.int64())), ("flags", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("text", pa.binary())]
        )

        def close() -> pa.RecordBatch:
            held.sort(key=lambda r: (r[0] is None, r[0] or 0))
            row = [(part << 32) + made, [r[0] for r in held], [r[1] for r in held], [len(r[2]) for r in held], pack(b"".join(r[2] for r in held), 6)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, kind, strict=True)], schema=kind)

        for b in batches:
            for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                held.append((row[0], row[1], row[2].as_py()))
                size += len(held[-1][2])
                if size >= SHARD_BYTES:
                    yield close()
                    made, held, size = made + 1, [], 0
        if held:
            yield close()

    return stored(rows.mapInArrow(run, SHARD_DDL), "shards")


def each_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Shard, list]]:
    """Shards of Arrow batches, one after the other, with the values of the columns behind them."""
    for b in batches:
        for i in range(len(b)):
            number, ids, flags, sizes, text, *rest = (b.column(c)[i].as_py() for c in range(b.num_columns))
            yield Shard(number, ids, flags, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64), unpack(text)), rest


def buckets(frame: DataFrame) -> int:
    """Buckets for questions: a few for every shuffle partition."""
    return 4 * width(frame.sparkSession)


def by_bucket(questions: DataFrame) -> DataFrame:
    return questions.repartition(width(questions.sparkSession), "bucket")


def with_answers(shards: DataFrame, answers: DataFrame) -> DataFrame:
    """Shards with all packed ``answer`` values for them; a shard's answers are no more than its questions."""
    own = answers.groupBy("shard").agg(F.collect_list("answer").alias("answers"))
    return shards.join(own, "shard", "left").select("shard", "ids", "flags", "sizes", "text", "answers")
