"""Exact deduplication by sorting whole contents.

Sampled splitters deal rows over range partitions by (first normalised bytes, digest of
all bytes, length, id), Spark's external sort puts equal contents next to each other, and
one pass compares every row with its neighbour in full.  The digest keeps the splitters
that the driver samples short however long the texts are.  The id is part of the sort key,
so a group of copies of any size spreads over partitions; groups that cross a border are
joined from the first and last run of each partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, stored, whole

_BATCH = 20_000
#: bytes of a content that come before its digest in the sort key
SPLITTER_BYTES = 32


def without_space(text: str | Column) -> Column:
    return F.regexp_replace(whole(text), SPACE, "")


def _runs(schema: pa.Schema):
    """Rows sorted by content -> each row with its run in this partition."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[tuple] = []
        run, content, members = -1, None, []

        def close(last: bool) -> None:
            head, size = members[0][0], len(members)
            edge = content if run == 0 or last else None
            for k, row in enumerate(members):
                out.append((*row, part, run, last, head, size, k == 0, edge if k == 0 else None))

        def batch() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[] for _ in schema]
            got = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            out.clear()
            return got

        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            for key, *row in zip(*columns, strict=True):
                if key != content:
                    if run >= 0:
                        close(False)
                        if len(out) >= _BATCH:
                            yield batch()
                    run, content, members = run + 1, key, []
                members.append(row)
        if run >= 0:
            close(True)
        if out:
            yield batch()

    return rows


def content_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content: Column | None = None, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Group of equal contents of every row: ``id_col, *carry, keep_id, group_size, kept, text_sha256``.

    ``content`` defaults to the text without ASCII white space.  Of equal contents the row
    with the most code points in its text stays, then the smallest id (null ids last).

    Null texts count as empty, and all empty texts are one group.  Rows repeated with their
    id are separate rows, of which one stays.  An empty table gives no rows.  Columns other
    than the id, the text and ``carry`` are not read, whatever their names.
    """
    key = without_space(text_col) if content is None else content
    id_type, kinds = docs.schema[id_col].dataType.simpleString(), {c: docs.schema[c].dataType.simpleString() for c in carry}
    rows = docs.select(
        F.encode(key, "UTF-8").alias("content"), F.col(id_col).alias("id"),
        *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)], F.char_length(whole(text_col)).alias("points"),
    )
    rows = rows.select("*", F.substring("content", 1, SPLITTER_BYTES).alias("begin"), F.sha2("content", 256).alias("digest"))
    order = [F.col("begin"), F.col("digest"), F.desc("points"), F.asc_nulls_last("id")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order[:2], "content", *order[2:]).drop("points", "begin")
    ddl = ", ".join(
        [f"id {id_type}", *[f"carry_{i} {kinds[c]}" for i, c in enumerate(carry)],
         "digest string, part int, run long, last boolean, head " + id_type, "size long, first boolean, edge binary"]
    )
    schema = docs.sparkSession.createDataFrame([], ddl).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    runs = stored(dealt.mapInArrow(_runs(to_arrow_schema(schema)), schema), "runs")
    joined = runs.join(F.broadcast(_across_borders(runs)), ["part", "run"], "left")  # at most two rows a partition
    return joined.select(
        F.col("id").alias(id_col),
        *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)],
        F.when(F.col("total").isNull(), F.col("head")).otherwise(F.col("whole_head")).alias("keep_id"),
        F.coalesce("total", "size").alias("group_size"),
        (F.col("first") & F.coalesce("owner", F.lit(True))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def _across_borders(runs: DataFrame) -> DataFrame:
    """(part, run) of each partition's first and last run -> size and head of its whole group.

    The windows below see one narrow row per partition; texts meet in joins by partition.
    """
    edges = runs.filter("edge is not null").select("part", "run", "last", "head", "size", "edge")
    first = edges.filter("run = 0")
    last = edges.filter("last")
    by_part = Window.orderBy("part")
    order = first.select("part", F.lag("part").over(by_part).alias("before"))
    same = (
        first.join(order, "part")
        .join(last.select(F.col("part").alias("before"), F.col("run").alias("before_run"), F.col("edge").alias("before_edge")), "before", "left")
        .select("part", "before", "before_run", F.coalesce(F.col("edge") == F.col("before_edge"), F.lit(False)).alias("same"))
    )
    owner = F.when(~F.col("same"), F.struct(F.col("part"), F.lit(0).cast("long").alias("run"))).when(
        F.col("before_run") > 0, F.struct(F.col("before").alias("part"), F.col("before_run").alias("run"))
    )
    labels = same.select("part", F.last(owner, ignorenulls=True).over(by_part).alias("owner"))
    pieces = first.join(labels, "part").select("part", "run", "owner", "head", "size").unionByName(
        last.filter("run > 0").select("part", "run", F.struct("part", "run").alias("owner"), "head", "size")
    )
    own = F.struct("part", "run") == F.col("owner")
    groups = pieces.groupBy("owner").agg(F.sum("size").alias("total"), F.first(F.when(own, F.struct("head")), ignorenulls=True).alias("h"))
    return pieces.select("part", "run", "owner", own.alias("is_owner")).join(groups, "owner").select(
        "part", "run", "total", F.col("h.head").alias("whole_head"), F.col("is_owner").alias("owner")
    )
