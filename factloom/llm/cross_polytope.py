"""Nearest neighbours by cross-polytope hashing.

Unit vectors are turned by fast pseudo-rotations (three rounds of random signs and a
Hadamard transform) and assigned to the nearest signed axis.  Several rotations are
several tables; a query looks into the buckets of its nearest axes in every table and
reranks what lies there by the exact distance.

Vectors of other norms are lifted to one sphere first: one more coordinate, the root of
what the squared norm lacks to the largest.  It is zero where all norms are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import stored, width

TABLES, PROBES, SEED = 8, 24, 17
#: members of a bucket that one run of the comparison holds; larger buckets are split
BLOCK = 4096
#: relative differences of norms that count as none
_EVEN = 1e-4


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two, orthonormal."""
    n, size = rows.shape
    half = 1
    while half < size:
        pairs = rows.reshape(n, -1, 2, half)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, size)
        half *= 2
    return rows / np.sqrt(size)


class Hasher:
    """Signed-axis buckets of vectors in every table."""

    def __init__(self, size: int, largest: float, even: bool, tables: int = TABLES, seed: int = SEED):
        self.lift, self.largest = not even, largest
        self.size = 1 << max(0, (size + self.lift - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, self.size))

    def rotated(self, vectors: np.ndarray) -> Iterator[np.ndarray]:
        unit = np.zeros((len(vectors), self.size))
        unit[:, : vectors.shape[1]] = vectors / self.largest
        if self.lift:
            unit[:, vectors.shape[1]] = np.sqrt(np.maximum(0, 1 - (unit * unit).sum(1)))
        for signs in self.signs:
            turned = unit
            for s in signs:
                turned = hadamard(turned * s)
            yield turned

    def nearest(self, turned: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` nearest signed axes of every row, nearest first."""
        both = np.concatenate([turned, -turned], 1)
        if count == 1:
            return both.argmax(1)[:, None]
        return np.argsort(-both, axis=1, kind="stable")[:, :count]


def _usable(vector: str) -> str:
    return (
        f"{vector} is not null and forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) "
        f"and exists({vector}, x -> x <> 0)"
    )


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _nearest(query: np.ndarray, own: int, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    apart = vectors - query
    square = np.einsum("ij,ij->i", apart, apart)
    square[ids == own] = np.inf
    at = np.flatnonzero(np.isfinite(square))
    if len(at) > k:
        at = at[square[at] <= np.partition(square[at], k - 1)[k - 1]]
    order = np.lexsort((ids[at], square[at]))[:k]
    return ids[at][order], np.sqrt(square[at][order])


def search(
    vectors: DataFrame, k: int = 10, query_every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding",
    tables: int = TABLES, probes: int = PROBES,
) -> DataFrame:
    """The ``k`` nearest other rows of every row whose id is divisible by ``query_every``.

    Returns ``query_id, rank, vec_id, score``: Euclidean distances in double precision on
    the original vectors, nearest first, ties to the smaller id.  Vectors that are null,
    zero, or hold null or non-finite components take no part, nor do null ids.  Between
    vectors of different lengths there is no distance: each length is searched on its own,
    one after the other, so lengths should be few.  Rows repeated with their id are one
    candidate at its nearest vector, and one query, at the first vector in array order (of
    the longest ones).  A query that found fewer than ``k`` looks into every bucket of the
    first table, so small tables lose nothing.  An empty table gives no rows; other columns
    are not read.
    """
    # as doubles, which is exact for floats
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter("id is not null and " + _usable("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    facts = rows.groupBy(F.size("v").alias("size")).agg(F.max(norm).alias("most"), F.min(norm).alias("least"), F.max(F.col("id") % query_every == 0).alias("asked"))
    chosen = F.min(F.struct((-F.size("v")).alias("shorter"), "v"))["v"].alias("v")
    asked = rows.filter(F.col("id") % query_every == 0).groupBy("id").agg(chosen)
    found = None
    for fact in sorted(facts.filter("asked").collect()):  # one narrow row per length that has queries
        own = rows.filter(F.size("v") == fact["size"])
        part = _search(own, asked.filter(F.size("v") == fact["size"]), fact, k, tables, probes)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    return found


def _search(rows: DataFrame, queries: DataFrame, fact: Row, k: int, tables: int, probes: int) -> DataFrame:
    """``search`` of queries ``id, v`` among rows ``id, v`` of one length, of which ``fact`` has the length and the norms."""
    size = int(fact["size"])
    hasher = Hasher(size, fact["most"], fact["most"] - fact["least"] <= _EVEN * fact["most"], tables)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((tables, 2 * hasher.size), np.int64)
        for b in batches:
            for t, turned in enumerate(hasher.rotated(_matrix(b.column(0)))):
                total[t] += np.bincount(hasher.nearest(turned, 1)[:, 0], minlength=2 * hasher.size)
        at = np.argwhere(total)
        yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(total[at[:, 0], at[:, 1]])], ["t", "bucket", "n"])

    counts = rows.select("v").mapInArrow(count, "t long, bucket long, n long").groupBy("t", "bucket").agg(F.sum("n").alias("n"))
    blocks = np.zeros((tables, 2 * hasher.size), np.int64)
    for r in counts.collect():  # at most tables x 2 x dimensions rows
        blocks[r["t"], r["bucket"]] = -(-r["n"] // BLOCK)
    ddl = "t int, bucket int, block int, query boolean, id long, v array<double>"
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.bool_()]

    def keyed(b: pa.RecordBatch, t: int, bucket: np.ndarray, block: np.ndarray, query: bool, at: np.ndarray) -> pa.RecordBatch:
        values = [np.full(len(at), t), bucket, block, np.full(len(at), query)]
        taken = b.take(pa.array(at))
        return pa.RecordBatch.from_arrays([*(pa.array(x, kind) for x, kind in zip(values, kinds, strict=True)), *taken.columns], ["t", "bucket", "block", "query", "id", "v"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for t, turned in enumerate(hasher.rotated(_matrix(b.column(1)))):
                bucket = hasher.nearest(turned, 1)[:, 0]
                mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                yield keyed(b, t, bucket, (mixed % blocks[t, bucket].astype(np.uint64)).astype(np.int64), False, np.arange(len(b)))

    def probe(every: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for t, turned in enumerate(hasher.rotated(_matrix(b.column(1)))):
                    if every and t:
                        break
                    bucket = hasher.nearest(turned, 2 * hasher.size if every else min(probes, 2 * hasher.size))
                    row = np.repeat(np.arange(len(b)), bucket.shape[1])
                    bucket = bucket.ravel()
                    times = blocks[t, bucket]  # every block of a bucket; none of an empty one
                    row, bucket = np.repeat(row, times), np.repeat(bucket, times)
                    begin = np.cumsum(times) - times
                    block = np.arange(len(row)) - np.repeat(begin, times)
                    for i in range(0, len(row), 4096):
                        s = slice(i, i + 4096)
                        yield keyed(b, t, bucket[s], block[s], True, row[s])

        return run

    found_schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, members = None, [], []
        for b in batches:
            keys = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4)], 1)
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1), True])
            number, matrix = b.column(4).to_numpy(), _matrix(b.column(5))
            out: list[list[np.ndarray]] = [[], [], []]
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if tuple(keys[x, :3]) != key:
                    key, ids, members = tuple(keys[x, :3]), [], []
                if not keys[x, 3]:
                    ids.append(number[x:y])
                    members.append(matrix[x:y])
                    continue
                if not ids:
                    continue
                if len(ids) > 1:
                    ids, members = [np.concatenate(ids)], [np.concatenate(members)]
                for i in range(x, y):
                    near, apart = _nearest(matrix[i], int(number[i]), ids[0], members[0], k)
                    for column, values in zip(out, (np.full(len(near), number[i]), near, apart), strict=True):
                        column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], schema=found_schema)

    def lookup(members: DataFrame, probes_: DataFrame) -> DataFrame:
        dealt = members.unionByName(probes_).repartition(width(rows.sparkSession), "t", "bucket", "block")
        pairs = dealt.sortWithinPartitions("t", "bucket", "block", "query").mapInArrow(compare, "query_id long, vec_id long, score double")
        return pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))

    ranked = Window.partitionBy("query_id").orderBy("score", "vec_id")

    def best(pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    placed = rows.mapInArrow(place, ddl)
    found = stored(best(lookup(placed, queries.mapInArrow(probe(False), ddl))), "neighbours")
    enough = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
    short = queries.join(enough, queries["id"] == enough["query_id"], "left_anti")
    if short.isEmpty():
        return found
    # a table's buckets hold every row once
    more = best(lookup(placed.filter("t = 0"), short.mapInArrow(probe(True), ddl)))
    return found.join(enough, "query_id", "left_semi").unionByName(more)
