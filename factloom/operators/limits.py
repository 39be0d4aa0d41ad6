"""Sliding-window request limits and log windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions.text import ratio
from .evaluation import exact_percentiles


def rate_limit(
    log: DataFrame,
    key: str = "client_id",
    window_ms: int = lx.RATE_WINDOW_MS,
    max_requests: int = lx.RATE_LIMITS["verify"],
    arrival: str = "request_id",
) -> DataFrame:
    """Add ``earlier`` (requests of the key in the window before), ``remaining``, ``rejected``.

    Rejected requests count as well, and a request is refused when more than
    ``max_requests`` came before it.  Rows are windowed per (key, time bucket) with the
    previous bucket as context, so one busy client is spread over many tasks.
    """
    bucket = F.floor(F.col("ts_ms") / window_ms)
    copies = log.withColumn(
        "_c", F.explode(F.array(F.struct(bucket.alias("b"), F.lit(True).alias("own")), F.struct((bucket + 1).alias("b"), F.lit(False).alias("own"))))
    ).select("*", F.col("_c.b").alias("_b"), F.col("_c.own").alias("_own")).drop("_c")
    group = Window.partitionBy(key, "_b")
    place = F.row_number().over(group.orderBy("ts_ms", arrival))
    expired = F.count("*").over(
        group.orderBy("ts_ms").rangeBetween(Window.unboundedPreceding, -window_ms)
    )
    earlier = place - 1 - expired
    return (
        copies.withColumn("earlier", earlier)
        .filter("_own")
        .drop("_b", "_own")
        .withColumn("remaining", F.greatest(F.lit(0), F.lit(max_requests) - F.col("earlier")))
        .withColumn("rejected", F.col("earlier") > max_requests)
    )


def counted_metrics(log: DataFrame, window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts per (window, latency): they add up, so no row or state holds the values of a window.

    Works on batches and streams; :func:`window_metrics` makes the metrics of a window of them.
    """
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    verdicts = [F.count_if(F.col("verdict") == v).alias(v.lower()) for v in lx.VERDICTS]
    grouped = log.groupBy(span.alias("w"), F.col("latency_ms")).agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
        F.count_if(F.col("tier") == "CACHE").alias("cached"),
        *verdicts,
    )
    return grouped.select(F.col("w.start").alias("window_start"), *grouped.columns[1:])


def window_metrics(counted: DataFrame) -> DataFrame:
    """Counts, hit ratio, verdict mix and latency per window, from :func:`counted_metrics`."""
    names = [c for c in counted.columns if c not in ("window_start", "latency_ms")]
    timed = F.when(F.col("latency_ms").isNotNull(), F.col("requests"))
    sums = counted.groupBy("window_start").agg(
        *[F.sum(c).alias(c) for c in names], (F.sum(F.col("latency_ms") * F.col("requests")) / F.sum(timed)).alias("avg_latency")
    )
    high = exact_percentiles(counted, "latency_ms", ("window_start",), {"p95_latency": 0.95}, times="requests").drop("n")
    return sums.join(high, "window_start", "left").withColumn("hit_ratio", ratio(F.col("cached"), F.col("requests")))


def request_metrics(log: DataFrame, window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Metrics per window of a batch."""
    return window_metrics(counted_metrics(log, window, slide))


def viral_claims(log: DataFrame, window: str = "10 minutes", slide: str = "1 minute", top: int = 3) -> DataFrame:
    """Most requested claims per hopping window; counts are aggregated before ranking."""
    counts = log.groupBy(F.window("ts", window, slide).alias("w"), "claim_hash").agg(F.count("*").alias("requests"))
    rank = Window.partitionBy("w").orderBy(F.desc("requests"), "claim_hash")
    return counts.withColumn("place", F.row_number().over(rank)).filter(F.col("place") <= top).select(
        F.col("w.start").alias("window_start"), "claim_hash", "requests", "place"
    )


def client_sessions(log: DataFrame, gap: str = "30 minutes") -> DataFrame:
    s = F.session_window("ts", gap)
    return log.groupBy("client_id", s.alias("s")).agg(
        F.count("*").alias("requests"), F.avg("latency_ms").alias("avg_latency")
    ).select("client_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "requests", "avg_latency")
