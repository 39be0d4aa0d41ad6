import random

from pyspark.sql import functions as F

from factloom.operators import cache as ca
from factloom.streaming import jobs


def _log(spark, rows):
    return spark.createDataFrame(rows, "request_id long, claim_hash string, ts_ms long")


def _rows(seed, n, span):
    """One claim has half of the traffic, and many requests share a time."""
    rng = random.Random(seed)
    return [(i, rng.choice(["hot"] * 6 + list("abcdef")), rng.randint(0, span) // 3 * 3) for i in range(n)]


def slow_replay(rows, ttl_ms):
    opened, out = {}, {}
    for rid, key, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        hit = key in opened and ts <= opened[key] + ttl_ms
        if not hit:
            opened[key] = ts
        out[rid] = (opened[key], "HIT" if hit else "MISS")
    return out


def test_a_claim_may_go_over_many_pieces(spark, monkeypatch):
    """Windows within a piece, over a few pieces, and over all of them."""
    monkeypatch.setattr(ca, "PIECE", 60)
    rows = _rows(3, 900, 300_000)
    for ttl in (1, 20, 100, 1000):
        got = {r.request_id: (r.window_start, r.outcome) for r in ca.cache_replay(_log(spark, rows), ttl).collect()}
        assert got == slow_replay(rows, ttl * 1000)


def test_one_time_only_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(ca, "PIECE", 10)
    rows = [(i, "hot", 5) for i in range(40)]
    got = {r.request_id: (r.window_start, r.outcome) for r in ca.cache_replay(_log(spark, rows), 1).collect()}
    assert got == slow_replay(rows, 1000)
    assert ca.cache_replay(_log(spark, []), 1).collect() == []


def test_jobs_do_not_grow_with_the_windows(spark):
    """Three hundred windows take no more jobs than one: they were followed by rounds of joins."""
    jobs = []
    for n, span in enumerate((900, 300_000)):
        spark.sparkContext.setJobGroup(f"replay {n}", "")
        assert ca.cache_replay(_log(spark, _rows(5, 900, span)), 1).agg(F.count_if(F.col("outcome") == "MISS")).first()[0] > n * 100
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"replay {n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] == jobs[0]


def _arriving(spark, folder, rows, files):
    size = len(rows) // files
    for i in range(files):
        log = _log(spark, rows[i * size : (i + 1) * size]).withColumn("ts", F.timestamp_millis("ts_ms"))
        log.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return jobs.stream_files(spark, f"{folder}/in", log.schema, files_per_trigger=1)


def _streamed(spark, folder):
    return {r.request_id: (r.window_start, r.outcome) for r in spark.read.schema(jobs.CACHE_ROWS).parquet(f"{folder}/rows/*").collect()}


def test_stream_cache_goes_on_from_batch_to_batch(spark, tmp_path, monkeypatch):
    """One claim has half of the traffic and several pieces in every batch; its window outlives batches."""
    monkeypatch.setattr(ca, "PIECE", 60)
    rows = sorted(_rows(7, 600, 300_000), key=lambda r: (r[2], r[0]))
    stream = _arriving(spark, tmp_path, rows, 3)
    jobs.replay_arriving(stream, str(tmp_path), f"{tmp_path}/state", 70).awaitTermination()
    assert _streamed(spark, tmp_path) == slow_replay(rows, 70_000)


def test_stream_cache_after_a_restart_and_with_late_rows(spark, tmp_path):
    hour = 3_600_000
    for rows in ([(1, "a", 0), (2, "b", hour)], [(3, "a", hour - 60_000), (4, "b", 0), (5, "b", 2 * hour + 1)]):
        stream = _arriving(spark, tmp_path, rows, 1)
        jobs.replay_arriving(stream, str(tmp_path), f"{tmp_path}/state", 3600).awaitTermination()
    # request 4 is an hour late; 3 is late by a minute only, and its claim's window is open
    assert _streamed(spark, tmp_path) == {1: (0, "MISS"), 2: (hour, "MISS"), 3: (0, "HIT"), 5: (2 * hour + 1, "MISS")}


def test_no_task_of_the_stream_query_holds_a_claim(spark, sf_dir, monkeypatch):
    """The state of a claim was fed with all its requests by one task."""
    from factloom.plans import catalog

    called, real = [], jobs.stream_verdict_cache
    monkeypatch.setattr(jobs, "stream_verdict_cache", lambda *a: called.append(a) or real(*a))
    catalog.queries()["stream_verdict_cache"](spark, sf_dir).count()
    assert not called
