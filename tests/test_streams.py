import datetime

from pyspark.sql import functions as F

from factloom.operators import evaluation as evl
from factloom.operators import limits as li
from factloom.operators import matching as mt
from factloom.operators import normalize as nm
from factloom.streaming import jobs


def _files(df, folder, parts):
    for part in parts:
        df.filter(part).coalesce(1).write.mode("append").parquet(f"{folder}/incoming")
    return jobs.stream_files(df.sparkSession, f"{folder}/incoming", df.schema, files_per_trigger=1)


def _log(spark, rows):
    schema = "request_id long, ts timestamp, latency_ms double, event_type string, tier string, verdict string"
    at = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, at + datetime.timedelta(minutes=m), v, "view", "CACHE", "FALSE") for i, m, v in rows], schema)


def test_late_rows_are_kept_and_counted(spark, tmp_path):
    log = _log(spark, [(1, 0, 1.0), (2, 60, 1.0), (3, 55, 1.0), (4, 49, 1.0), (5, 10, 1.0), (6, 200, 1.0), (7, 100, 1.0)])
    stream = _files(log, str(tmp_path), ["request_id <= 2", "request_id in (3, 4, 5, 6)", "request_id = 7"])
    jobs.split_late(stream, str(tmp_path), f"{tmp_path}/state").awaitTermination()
    ids = lambda name: {r.request_id for r in spark.read.parquet(f"{tmp_path}/{name}").collect()}
    assert ids("on_time") == {1, 2, 3, 6} and ids("late") == {4, 5, 7}  # the watermark is ten minutes behind 60, then 200
    progress = {r.batch: (r.rows, r.late) for r in spark.read.parquet(f"{tmp_path}/progress").collect()}
    assert progress == {0: (2, 0), 1: (4, 2), 2: (1, 1)}


def test_late_split_goes_on_after_a_restart(spark, tmp_path):
    log = _log(spark, [(1, 100, 1.0), (2, 10, 1.0)])
    for part in ("request_id = 1", "request_id = 2"):
        stream = _files(log, str(tmp_path), [part])
        jobs.split_late(stream, str(tmp_path), f"{tmp_path}/state").awaitTermination()
    assert [r.request_id for r in spark.read.parquet(f"{tmp_path}/late").collect()] == [2]


def test_window_percentiles_from_counts(spark):
    """Most requests of a window have one latency; nulls have none."""
    rows = [(i, 0, 5.0) for i in range(900)] + [(1000 + i, 1, float(i)) for i in range(100)] + [(5000, 70, None)]
    got = {r.window_start.hour: r for r in li.request_metrics(_log(spark, rows)).collect()}
    values = sorted([5.0] * 900 + [float(i) for i in range(100)])
    at = 0.95 * 999
    want = values[int(at)] + (at - int(at)) * (values[int(at) + 1] - values[int(at)])
    assert abs(got[0].p95_latency - want) < 1e-9 and got[0].requests == 1000 and abs(got[0].avg_latency - sum(values) / 1000) < 1e-9
    assert got[1].requests == 1 and got[1].p95_latency is None and got[1].avg_latency is None


def test_no_state_row_holds_the_values_of_a_window(spark, tmp_path):
    stream = _files(_log(spark, [(1, 0, 1.0), (2, 500, 1.0)]), str(tmp_path), ["true"])
    plan = jobs.stream_metrics(stream)._jdf.queryExecution().toString()
    assert "percentile" not in plan and "collect" not in plan


def test_checks_that_arrive_later_are_found(spark, tmp_path):
    """The index grows with a stream of fact-checks; the same posts match more of them each time."""
    rows = [(1, "earth is round and big"), (2, "moon landing was filmed in Nevada"), (3, "moon landing was filmed in Nevada")]
    details = [F.lit(None).cast("string").alias("claimant"), F.struct(F.lit("P").alias("name")).alias("publisher"), F.struct(F.lit("u").alias("url")).alias("review")]
    checks = spark.createDataFrame(rows, "fc_id long, claim_text string").select("*", *details)
    posts = spark.createDataFrame([(1, "Earth is round and big"), (2, "Moon landing was filmed in Nevada")], "claim_id long, claim string")
    claims_of = lambda batch: mt.with_match_key(nm.claim_identity(batch))
    found = []
    for k, part in enumerate(["fc_id = 1", "fc_id = 2", "fc_id = 3"]):
        stream = _files(checks, f"{tmp_path}/checks", [part])
        jobs.index_arriving(stream, f"{tmp_path}/known", f"{tmp_path}/state").awaitTermination()
        arriving = _files(posts, f"{tmp_path}/posts{k}", ["true"])
        jobs.match_arriving(arriving, claims_of, f"{tmp_path}/known", f"{tmp_path}/out{k}", f"{tmp_path}/out-state{k}").awaitTermination()
        found.append(sorted((r.claim_id, r.fc_id) for r in spark.read.parquet(f"{tmp_path}/out{k}/*").collect()))
    assert found == [[(1, 1)], [(1, 1), (2, 2)], [(1, 1), (2, 2)]]


def test_retention_is_the_same_when_repeated(spark, tmp_path):
    day = lambda d: datetime.date(2024, 1, d)
    rows = [("view", day(1), 2.0), ("view", day(1), 4.0), ("view", day(9), 1.0), ("error", day(1), 8.0), ("error", day(2), 1.0)]
    log = spark.createDataFrame(rows, "event_type string, day date, latency_ms double").withColumn("kind", F.col("event_type"))
    log.write.partitionBy("kind", "day").parquet(f"{tmp_path}/log")
    run = lambda: evl.apply_retention(spark, f"{tmp_path}/log", f"{tmp_path}/totals", {"view": 3, "error": 9}, "2024-01-11", 5, kind="kind")
    assert [run(), run()] == [2, 0]
    left = sorted((r.kind, r.day.day) for r in spark.read.parquet(f"{tmp_path}/log").collect())
    assert left == [("error", 2), ("view", 9)]
    totals = {(r.kind, r.day.day): (r.requests, r.errors, r.latency_sum, r.latency_max) for r in spark.read.parquet(f"{tmp_path}/totals").collect()}
    assert totals == {("view", 1): (2, 0, 6.0, 4.0), ("error", 1): (1, 1, 8.0, 8.0)}
