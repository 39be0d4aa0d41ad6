"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a target in words; a document's expected copies are target / source
size.  The whole part is taken at once.  Fractional parts are rounded in pairs: word mass
moves at random from one document of the pair to the other until one of them is integral,
which keeps every document's expectation and the source's total.  Blocks of documents
round on their own and leave at most one fractional document each; these meet again in a
reduction tree until one per source is left.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored, whole

BLOCK = 8192
FAN_IN = 64
MOST = 3


def source_targets(sized: DataFrame, most: int = MOST) -> DataFrame:
    """``source, size`` per document -> ``src, source, documents, source_size, target``.

    Sources in code point order, null last, weigh 1, 2, 3, repeating, and share the sum of
    all sizes; no target exceeds ``most`` times its source.  What the full sources leave is
    shared by weight: with sources ordered by room per weight, the first source that is not
    filled gives the common level.  The windows see one narrow row per source.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    ranked = sources.withColumn("src", F.row_number().over(by_name)).withColumn("weight", (F.col("src") - 1) % 3 + 1)
    room = most * F.col("source_size")
    by_room = Window.orderBy(room / F.col("weight"), "src")
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - (F.sum(room).over(by_room) - room)) / (
        F.sum("weight").over(everything) - F.sum("weight").over(by_room) + F.col("weight")
    )
    full = F.col("level") * F.col("weight") >= room
    rest = F.first(F.when(~full, F.col("level")), ignorenulls=True).over(
        by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return ranked.withColumn("level", level).select(
        "src", "source", "documents", "source_size",
        F.when(full, room.cast("double")).otherwise(rest * F.col("weight")).alias("target"),
    )


def _round_pairs(units: list[list[float]], rng: random.Random) -> int | None:
    """Round [p, size] in place, pair by pair; position of the one left fractional, if any."""
    left = None
    for j, b in enumerate(units):
        if not 0.0 < b[0] < 1.0:
            continue
        if left is None:
            left = j
            continue
        a = units[left]
        up = min((1.0 - a[0]) * a[1], b[0] * b[1])  # words that b can give to a
        down = min(a[0] * a[1], (1.0 - b[0]) * b[1])
        if rng.random() * (up + down) < down:
            full = (1.0 - a[0]) * a[1] <= b[0] * b[1]
            a[0], b[0] = (1.0, b[0] - up / b[1]) if full else (a[0] + up / a[1], 0.0)
        else:
            empty = a[0] * a[1] <= (1.0 - b[0]) * b[1]
            a[0], b[0] = (0.0, b[0] + down / b[1]) if empty else (a[0] - down / a[1], 1.0)
        for unit in (a, b):
            if unit[0] < 1e-12 or unit[0] > 1 - 1e-12:
                unit[0] = float(round(unit[0]))
        open_ = [k for k in (left, j) if 0.0 < units[k][0] < 1.0]
        left = open_[0] if open_ else None
    return left


def _rounder(seed: int, level: int, last: bool):
    def block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "id", "row"], ascending=[False, True, True], na_position="last", kind="stable")
        rng = random.Random(f"{seed}/{level}/{key[0]}/{key[1]}")
        units = [list(u) for u in zip(rows["part"].tolist(), rows["size"].astype(float).tolist(), strict=True)]
        left = _round_pairs(units, rng)
        if last and left is not None:
            units[left][0] = 1.0 if rng.random() < units[left][0] else 0.0
        return rows.assign(part=[u[0] for u in units])

    return block


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, most: int = MOST, row_col: str | None = None) -> DataFrame:
    """Copies of every document in the mix: ``id_col, size, source_size, target, copies, taken``.

    Size is the number of words (null text: 0); a document without words takes nothing and
    has copies 0.  Null is a source of its own.  Rows repeated with their id are separate
    documents.  No document has more than ``most`` copies, and a source's total differs
    from its target by less than its last fractional document.  All randomness comes from
    ``seed`` and block numbers that depend on ids and counts only, so reruns agree on any
    cluster.  An empty table gives no rows; other columns are not read.  ``row_col`` names
    a column that tells rows with equal ids apart and is returned as well.
    """
    row = F.col(row_col) if row_col else F.lit(0).cast("long")
    read = docs.select(
        F.col(id_col).alias("id"), row.alias("row"), F.col(source_col).alias("source"),
        F.regexp_count(whole(text_col), F.lit(WORD)).cast("long").alias("size"),
    )
    # rows that agree in all of these are numbered, so that one id of many rows has many blocks
    counted = read.groupBy("id", "row", "source", "size").agg(F.count(F.lit(1)).alias("times"))
    sized = stored(counted.select("id", "row", "source", "size", F.explode(F.sequence(F.lit(1), "times")).alias("turn")), "sizes")
    targets = source_targets(sized, most)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    spread = F.col("size") > 0
    units = sized.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(
        "id", "row", "src", "size", "source_size", "target",
        F.when(spread, F.floor(share)).otherwise(0).cast("long").alias("base"),
        F.when(spread, share - F.floor(share)).otherwise(0.0).alias("part"),
        F.pmod(F.xxhash64("id", "row", "size", "turn"), F.ceil(F.col("documents") / BLOCK)).alias("block"),
    )
    done = stored(units.groupBy("src", "block").applyInPandas(_rounder(seed, 0, False), units.schema), "rounded")
    open_ = done.filter("part > 0 and part < 1")
    finished = [done.filter("not (part > 0 and part < 1)")]
    blocks = done.agg(F.max("block")).first()[0] or 0
    level = 0
    while True:
        level += 1
        blocks //= FAN_IN
        merged = open_.withColumn("block", F.floor(F.col("block") / FAN_IN))
        last = blocks == 0
        step = merged.groupBy("src", "block").applyInPandas(_rounder(seed, level, last), merged.schema)
        if last:
            finished.append(step)
            break
        step = stored(step, "rounded")
        open_ = step.filter("part > 0 and part < 1")
        finished.append(step.filter("not (part > 0 and part < 1)"))
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    copies = (F.col("base") + F.col("part")).cast("long")
    keep = [F.col("row").alias(row_col)] if row_col else []
    return out.select(
        F.col("id").alias(id_col), *keep, "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )
