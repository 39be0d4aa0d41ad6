import random

from pyspark.sql import functions as F

from factloom.operators import cache as ca
from factloom.operators import cascade as cs
from factloom.operators import limits as li
from factloom.streaming import jobs


def _log(spark, rows):
    df = spark.createDataFrame(rows, "request_id long, claim_hash string, client_id long, ts_ms long")
    return df.withColumn("ts", F.timestamp_millis("ts_ms"))


def _rows(seed, n=600):
    rng = random.Random(seed)
    return [(i, rng.choice("aaaabcd"), rng.choice([1, 1, 1, 2, 3]), rng.randint(0, 400_000)) for i in range(n)]


def slow_replay(rows, ttl_ms):
    opened, out = {}, {}
    for rid, key, _, ts in sorted(rows, key=lambda r: (r[3], r[0])):
        if key not in opened or ts > opened[key] + ttl_ms:
            opened[key] = ts
            out[rid] = "MISS"
        else:
            out[rid] = "HIT"
    return out


def test_replay_matches_sequential(spark):
    rows = _rows(1)
    for ttl in (1, 7, 60, 1000):
        got = {r.request_id: r.outcome for r in ca.cache_replay(_log(spark, rows), ttl).collect()}
        assert got == slow_replay(rows, ttl * 1000)


def slow_limit(rows, window, most):
    seen, out = {}, {}
    for rid, _, client, ts in sorted(rows, key=lambda r: (r[3], r[0])):
        recent = [t for t in seen.get(client, []) if t > ts - window]
        out[rid] = len(recent) > most
        seen[client] = recent + [ts]
    return out


def test_rate_limit_batch_and_stream(spark):
    rows = _rows(2)
    log = _log(spark, rows)
    want = slow_limit(rows, 60_000, 10)
    assert any(want.values())
    assert {r.request_id: r.rejected for r in li.rate_limit(log).collect()} == want
    folder = jobs.work_folder(spark, "stream")
    log.write.parquet(f"{folder}/in")
    stream = jobs.stream_files(spark, f"{folder}/in", log.schema)
    got = jobs.run_available(jobs.stream_rate_limit(stream))
    assert {r.request_id: r.rejected for r in got.collect()} == want


def test_stream_cache_over_many_batches(spark):
    rows = sorted(_rows(4), key=lambda r: (r[3], r[0]))
    folder = jobs.work_folder(spark, "stream")
    for i in range(3):
        _log(spark, rows[i * 200 : (i + 1) * 200]).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = jobs.stream_files(spark, f"{folder}/in", _log(spark, rows[:1]).schema, files_per_trigger=1)
    got = jobs.run_available(jobs.stream_verdict_cache(stream, 60))
    assert {r.request_id: r.outcome for r in got.collect()} == slow_replay(rows, 60_000)


def test_cascade_gives_one_verdict_per_claim(spark):
    claims = spark.createDataFrame(
        [(i, f"h{i}", "n", f"k{i}", i != 5) for i in range(6)],
        "claim_id long, claim_hash string, normalized string, match_key string, provider_ok boolean",
    )
    now = F.lit("2024-01-01").cast("timestamp")
    cache = spark.createDataFrame(
        [("h0", "FALSE", 0.9, "e", "FACT_CHECK_API", "2024-01-02"), ("h1", "FALSE", 0.9, "e", "AI_RAG", "2023-01-01")],
        "claim_hash string, verdict string, confidence double, explanation string, source_tier string, expires_at string",
    ).withColumn("expires_at", F.col("expires_at").cast("timestamp"))
    matches = spark.createDataFrame(
        [("k1", "HIGH_CONFIDENCE", 0.9, "SUPPORTED", 0.8, "m"), ("k2", "LOW_CONFIDENCE", 0.7, "FALSE", 0.4, "m")],
        "match_key string, match_type string, total double, verdict string, confidence double, explanation string",
    )
    model = spark.createDataFrame([(3, "MISLEADING", 0.5, "x"), (1, "FALSE", 0.5, "x")], "claim_id long, verdict string, confidence double, explanation string")
    got = {r.claim_id: (r.outcome, r.verdict, r.cached) for r in cs.verify(claims, cache, matches, model, now).collect()}
    assert got == {
        0: ("HIT", "FALSE", True), 1: ("MATCH", "SUPPORTED", False), 2: ("UNRELIABLE", "UNVERIFIED", False),
        3: ("MODEL", "MISLEADING", False), 4: ("NO_MATCH", "UNVERIFIED", False), 5: ("ERROR", "UNVERIFIED", False),
    }
    ttl = {r.claim_id: r.ttl for r in cs.to_cache_rows(cs.verify(claims, cache, matches, model, now)).collect()}
    assert ttl == {1: 86400, 2: 900, 3: 86400, 4: 900}


def test_hit_ratio(spark):
    log = spark.createDataFrame([("HIT", 1.0), ("MISS", 3.0)], "outcome string, latency_ms double")
    m = ca.cache_metrics(log).first()
    assert m.hit_ratio == 0.5 and m.avg_lookup_ms == 2.0 and m.avg_write_ms is None
