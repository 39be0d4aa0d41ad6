"""Structured Streaming over the request log: limits, verdict cache, metrics, enrichment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import lexicon as lx
from ..operators.cache import cache_replay
from ..operators.limits import client_sessions, counted_metrics
from ..operators.matching import match_fact_checks, search_words
from ..operators.wordindex import open_index, write_batch
from ..session import stored, work_folder

WATERMARK = "10 minutes"


def stream_files(spark: SparkSession, folder: str, schema, name_filter: str = "*", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name_filter)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def _limit_state(window_ms: int, max_requests: int) -> Callable:
    """Per key: the request times of the last window, in arrival order; older ones are dropped."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts_ms", "request_id"])
        earlier = []
        for now in rows["ts_ms"]:
            recent = [t for t in recent if t > now - window_ms]
            earlier.append(len(recent))
            recent.append(int(now))
        state.update((recent,))
        state.setTimeoutTimestamp(max(recent[-1] + window_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(
            {
                "request_id": rows["request_id"].to_numpy(),
                "earlier": earlier,
                "rejected": [n > max_requests for n in earlier],
            }
        )

    return step


def stream_rate_limit(
    log: DataFrame, key: str = "client_id", window_ms: int = lx.RATE_WINDOW_MS, max_requests: int = lx.RATE_LIMITS["verify"]
) -> DataFrame:
    """Streaming form of the sliding-window limit; state leaves with the watermark."""
    return (
        log.withWatermark("ts", WATERMARK)
        .groupBy(key)
        .applyInPandasWithState(
            _limit_state(window_ms, max_requests),
            "request_id long, earlier long, rejected boolean",
            "recent array<long>",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )


def _cache_state(ttl_ms: int) -> Callable:
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts_ms", "request_id"])
        outcomes, starts = [], []
        for now in rows["ts_ms"]:
            hit = opened is not None and now <= opened + ttl_ms
            if not hit:
                opened = int(now)
            outcomes.append("HIT" if hit else "MISS")
            starts.append(opened)
        state.update((opened,))
        state.setTimeoutTimestamp(max(opened + ttl_ms + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"request_id": rows["request_id"].to_numpy(), "window_start": starts, "outcome": outcomes})

    return step


def stream_verdict_cache(log: DataFrame, ttl_seconds: int = lx.CACHE_TTL_SECONDS) -> DataFrame:
    """HIT or MISS per request against a cache whose entries live ``ttl_seconds`` from the miss.

    One task holds the requests of a claim; :func:`replay_arriving` spreads them.
    """
    return (
        log.select("claim_hash", "ts", "ts_ms", "request_id").withWatermark("ts", WATERMARK)
        .groupBy("claim_hash")
        .applyInPandasWithState(
            _cache_state(ttl_seconds * 1000),
            "request_id long, window_start long, outcome string",
            "opened long",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )


def stream_metrics(log: DataFrame, window: str = "1 hour") -> DataFrame:
    """Counts of closed windows by latency; the state is one small row for each window and value.

    :func:`factloom.operators.limits.window_metrics` turns the written rows into metrics.
    """
    return counted_metrics(log.withWatermark("ts", WATERMARK), window)


def stream_sessions(log: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return client_sessions(log.withWatermark("ts", WATERMARK), gap)


def first_sightings(log: DataFrame, within: str = "1 day") -> DataFrame:
    """First request of each claim within a time span: the simple form of the cache."""
    return log.withWatermark("ts", within).dropDuplicatesWithinWatermark(["claim_hash"])


def each_batch(stream: DataFrame, job: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Run a batch job, for example a match against the fact-check table, on every micro-batch.

    The batch number is a partition that is overwritten, so a repeated batch leaves no duplicates.
    """

    def write(batch: DataFrame, number: int) -> None:
        job(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_arriving(checks: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keep a stored index of fact-checks up to date: every micro-batch is appended as a batch of it.

    ``folder`` holds the index and the table ``checks`` that matches are read from.  A
    repeated micro-batch replaces its own rows.
    """

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/checks/batch={number}")
        arrived = batch.sparkSession.read.schema(batch.schema).parquet(f"{folder}/checks/batch={number}")
        write_batch(arrived, "fc_id", search_words(F.col("claim_text")), f"{folder}/index", number)

    return checks.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def match_arriving(posts: DataFrame, claims_of: Callable[[DataFrame], DataFrame], folder: str, path: str, checkpoint: str) -> StreamingQuery:
    """Match every micro-batch of posts against the stored fact-checks of ``folder``.

    The index is opened anew for each batch, so checks that arrived meanwhile count; no
    fact-check is split into words again, only those that a claim meets are read.
    ``claims_of`` makes keyed claims (claim_id, normalized, metadata, match_key) of a batch.
    """

    def match(batch: DataFrame) -> DataFrame:
        spark = batch.sparkSession
        keyed = stored(claims_of(batch), "keyed")
        checks = spark.read.parquet(f"{folder}/checks").drop("batch")
        best = match_fact_checks(keyed, checks, index=open_index(spark, f"{folder}/index"))
        return keyed.select("match_key", "claim_id").join(best, "match_key").select("claim_id", "fc_id", "match_type", "total")

    return each_batch(posts, match, path, checkpoint)


CACHE_ROWS = "request_id long, window_start long, outcome string"


def replay_arriving(log: DataFrame, folder: str, checkpoint: str, ttl_seconds: int = lx.CACHE_TTL_SECONDS, delay: str = WATERMARK) -> StreamingQuery:
    """The verdict cache as a batch replay of every micro-batch, so a claim with most of the traffic has many tasks.

    ``folder`` gets ``rows``, ``opened`` (the last miss of each claim that can still serve) and
    ``progress`` (the newest event time so far), a partition of each for every batch.  What the
    batch before left there goes on, so a restarted stream and a repeated batch come to the
    same rows.  Rows behind the watermark are refused, as by Spark's own state.
    """

    def replay(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        part = lambda name, n: f"{folder}/{name}/batch={n}"
        batch = batch.select("claim_hash", "ts", "ts_ms", "request_id")
        opened = None
        newest = F.max("ts")
        if number:
            before = spark.read.schema("newest timestamp").parquet(part("progress", number - 1)).first()[0]
            newest = F.greatest(newest, F.lit(before).cast("timestamp"))
            batch = batch.filter(F.col("ts") >= F.lit(before).cast("timestamp") - F.expr(f"interval {delay}")) if before else batch
            opened = spark.read.schema("claim_hash string, opened long").parquet(part("opened", number - 1))
        rows = cache_replay(stored(batch, "arrived"), ttl_seconds, opened=opened).select("claim_hash", "ts", "request_id", "window_start", "outcome")
        rows.write.mode("overwrite").option("compression", "zstd").parquet(part("rows", number))
        rows = spark.read.schema(rows.schema).parquet(part("rows", number))
        rows.agg(newest.alias("newest")).write.mode("overwrite").parquet(part("progress", number))
        last = rows.filter("outcome = 'MISS'").select("claim_hash", F.col("window_start").alias("opened"))
        last = last if opened is None else last.unionByName(opened)
        now = spark.read.schema("newest timestamp").parquet(part("progress", number))
        kept = last.groupBy("claim_hash").agg(F.max("opened").alias("opened")).join(
            F.broadcast(now.select(F.unix_millis(F.col("newest") - F.expr(f"interval {delay}")).alias("watermark")))
        ).filter(F.col("opened") + ttl_seconds * 1000 >= F.col("watermark")).drop("watermark")
        kept.write.mode("overwrite").parquet(part("opened", number))

    return log.writeStream.foreachBatch(replay).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process everything that is there and return the written table."""
    spark = stream.sparkSession
    folder = work_folder(spark, "stream")
    query = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


LATE_SCHEMA = "batch long, rows long, late long, newest timestamp, watermark timestamp"


def split_late(log: DataFrame, folder: str, checkpoint: str, ts: str = "ts", delay: str = WATERMARK) -> StreamingQuery:
    """Keep rows that come behind the watermark: on-time and late rows go to tables of their own.

    The watermark of a micro-batch is the newest event time of all earlier ones less
    ``delay``, as Spark's own.  ``folder`` gets ``on_time``, ``late`` and ``progress`` (one
    row per batch: rows, late rows, newest time, watermark).  Progress is read back from
    there, so a restarted stream and a repeated batch come to the same split.
    """

    def split(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        part = lambda name: f"{folder}/{name}/batch={number}"
        newest = None
        if number:
            newest = spark.read.schema("newest timestamp, batch long").parquet(f"{folder}/progress").filter(F.col("batch") < number).agg(F.max("newest")).first()[0]
        watermark = F.lit(newest).cast("timestamp") - F.expr(f"interval {delay}")
        rows = stored(batch.withColumn("_late", F.coalesce(F.col(ts) < watermark, F.lit(False))), "arrived")
        rows.filter("not _late").drop("_late").write.mode("overwrite").parquet(part("on_time"))
        rows.filter("_late").drop("_late").write.mode("overwrite").parquet(part("late"))
        rows.agg(
            F.count(F.lit(1)).alias("rows"), F.count_if("_late").alias("late"), F.max(ts).alias("newest"), F.max(watermark).alias("watermark")
        ).write.mode("overwrite").parquet(part("progress"))

    return log.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dropped_late_rows(query: StreamingQuery) -> int:
    """Rows refused because they came after the watermark, over all progress reports."""
    return sum(
        op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"]
    )
