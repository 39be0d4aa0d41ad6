"""Queries run as streams over the event files; each equals its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import round_half_up
from ..operators import limits as li
from ..operators import matching as mt
from ..operators import normalize as nm
from ..sources import readers as rd
from ..streaming import jobs
from . import sqltext as st
from .catalog import query
from .matching import BASE, SCORED
from .serving import replay_sql
from .tables import SQL_LOG, _decorated, fact_checks, log_columns, read, request_log


def event_stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return log_columns(jobs.stream_files(spark, sf_dir, schema, "events.parquet"))


@query(
    "stream_rate_limit",
    f"""with {SQL_LOG}, w as (select request_id, row_number() over (partition by client_id order by ts_ms, request_id) - 1
    - count(*) over (partition by client_id order by ts_ms range between unbounded preceding and 3600000 preceding) as earlier from log)
select request_id, earlier, earlier > 1 as rejected from w""",
)
def stream_rate_limit(spark, sf_dir):
    return jobs.run_available(jobs.stream_rate_limit(event_stream(spark, sf_dir), "client_id", 3_600_000, 1))


@query("stream_verdict_cache", f"with recursive {replay_sql(86400)} select request_id, window_start, outcome from replayed")
def stream_verdict_cache(spark, sf_dir):
    folder = jobs.work_folder(spark, "stream")
    jobs.replay_arriving(event_stream(spark, sf_dir), folder, f"{folder}/state").awaitTermination()
    return spark.read.schema(jobs.CACHE_ROWS).parquet(f"{folder}/rows/*")


@query(
    "stream_window_metrics",
    f"""with {SQL_LOG}, m as (select time_bucket(interval '1 hour', ts) as window_start, count(*) as requests, count_if(event_type = 'error') as errors,
  {st.half_up('avg(latency_ms)', 6)} as avg_latency, {st.half_up('quantile_cont(latency_ms, 0.95)', 6)} as p95_latency, count_if(tier = 'CACHE') / count(*)::double as hit_ratio from log group by 1)
select * from m where window_start + interval '1 hour' <= (select max(ts) from log) - interval '10 minutes'""",
)
def stream_window_metrics(spark, sf_dir):
    """Closed windows only: append mode emits the counts of a window once the watermark has passed it."""
    out = li.window_metrics(jobs.run_available(jobs.stream_metrics(event_stream(spark, sf_dir))))
    return out.select(
        "window_start", "requests", "errors", round_half_up(F.col("avg_latency"), 6).alias("avg_latency"), round_half_up(F.col("p95_latency"), 6).alias("p95_latency"), "hit_ratio"
    )


# rows arrive up to an hour and three quarters after their time, in files of a week each
ARRIVAL = "unix_seconds(ts) + (request_id * 7919 % 106) * 60"
_WEEK = 7 * 86400


@query(
    "late_rows",
    f"""with {SQL_LOG}, a as (select *, (epoch_us(ts) // 1000000) + (request_id * 7919 % 106) * 60 as arrived from log),
b as (select *, arrived // {_WEEK} - min(arrived // {_WEEK}) over () as batch from a),
w as (select batch, max(max(ts)) over (order by batch rows between unbounded preceding and 1 preceding) - interval '10 minutes' as watermark from b group by batch)
select b.batch, count(*) as rows, count_if(coalesce(b.ts < w.watermark, false)) as late, sum(case when b.ts < w.watermark then b.request_id else 0 end)::bigint as late_ids
from b join w using (batch) group by 1""",
)
def late_rows(spark, sf_dir):
    """Rows of every micro-batch, and those behind its watermark, which are kept beside the others."""
    folder = jobs.work_folder(spark, "late")
    log = request_log(spark, sf_dir).withColumn("file", F.floor(F.expr(ARRIVAL) / _WEEK))
    weeks = [r[0] for r in log.select("file").distinct().orderBy("file").collect()]  # one row per week of the log
    for week in weeks:  # one file after the other, as they would come in
        log.filter(F.col("file") == week).drop("file").coalesce(1).write.mode("append").parquet(f"{folder}/incoming")
    arriving = jobs.stream_files(spark, f"{folder}/incoming", log.drop("file").schema, files_per_trigger=1)
    jobs.split_late(arriving, folder, f"{folder}/state").awaitTermination()
    progress = spark.read.parquet(f"{folder}/progress")
    late = spark.read.schema("request_id long, batch long").parquet(f"{folder}/late").groupBy("batch").agg(F.sum("request_id").alias("late_ids"))
    return progress.join(late, "batch", "left").select(F.col("batch").cast("long").alias("batch"), "rows", "late", F.coalesce("late_ids", F.lit(0)).cast("long").alias("late_ids"))


@query(
    "stream_fact_checks",
    f"{BASE}, {SCORED} select claim_id, fc_id, match_type from best",
)
def stream_fact_checks(spark, sf_dir):
    """A stream of posts matched against fact-checks that are indexed once; each micro-batch probes the index."""
    folder = jobs.work_folder(spark, "stream")
    checks = fact_checks(spark, sf_dir)
    checks.write.parquet(f"{folder}/incoming")
    arriving = jobs.stream_files(spark, f"{folder}/incoming", checks.schema)
    jobs.index_arriving(arriving, folder, f"{folder}/index-state").awaitTermination()
    schema = spark.read.parquet(f"{sf_dir}/benchmark.parquet").schema
    posts = jobs.stream_files(spark, sf_dir, schema, "benchmark.parquet").selectExpr("item_id as post_id", "text")
    claims_of = lambda batch: mt.with_match_key(nm.claim_identity(_decorated(batch)))
    jobs.match_arriving(posts, claims_of, folder, f"{folder}/rows", f"{folder}/state").awaitTermination()
    return spark.read.schema("claim_id long, fc_id long, match_type string, total double").parquet(f"{folder}/rows/*").drop("total")


# ------------------------------------------------------- provider formats
RESPONSE = """concat('{"claims":[{"text":"', case when fc_id % 7 = 0 then '' else 'c' end, cast(fc_id as varchar(20)), '","claimReview":[',
  case when fc_id % 11 = 0 then '' else concat('{"publisher":{"name":"', case when fc_id % 3 = 0 then '' else source end, '"},"url":"',
    case when fc_id % 13 = 0 then 'nowhere' else concat('https://', source, '.org/', cast(fc_id as varchar(20))) end, '","textualRating":"',
    case when fc_id % 5 = 0 then '' else 'False' end, '"}') end, ']},{"claimant":"no text"}]}')"""


@query(
    "provider_fact_checks",
    """select concat('c', doc_id) as claim_text, case when doc_id % 3 = 0 then 'Unknown Publisher' else source end as publisher,
  concat('https://', source, '.org/', doc_id) as url, 'False' as rating from documents
where doc_id % 11 <> 0 and doc_id % 13 <> 0 and doc_id % 5 <> 0 and doc_id % 7 <> 0
union all select cast(doc_id as varchar), case when doc_id % 3 = 0 then 'Unknown Publisher' else source end, concat('https://', source, '.org/', doc_id), 'False'
from documents where doc_id % 11 <> 0 and doc_id % 13 <> 0 and doc_id % 5 <> 0 and doc_id % 7 = 0""",
)
def provider_fact_checks(spark, sf_dir):
    body = read(spark, sf_dir, "documents").withColumnRenamed("doc_id", "fc_id").select(F.expr(RESPONSE).alias("body"))
    parsed = body.select(F.from_json("body", rd.PROVIDER_SCHEMA).alias("r")).select("r.*")
    return rd.flatten_fact_checks(parsed).select(
        "claim_text", F.col("publisher.name").alias("publisher"), F.col("review.url").alias("url"), F.col("review.textual_rating").alias("rating")
    )


SEARCH_BODY = """case page_id % 2 when 0 then concat('{"web":{"results":[{"url":"', url, '","title":"T","description":"d","meta":{"publisher":"P"}},{"title":"no url"}]}}')
  else concat('{"organic_results":[{"link":"', url, '","title":"T","snippet":"d","source":"S"}]}') end"""


@query(
    "provider_search_results",
    """select page_id as claim_id, 1 as rank, url, 'T' as title, case page_id % 2 when 0 then 'P' else 'S' end as publisher from pages union all
select page_id, 2, '', 'no url', null from pages where page_id % 2 = 0""",
)
def provider_search_results(spark, sf_dir):
    raw = read(spark, sf_dir, "pages").select(
        F.col("page_id").alias("claim_id"), F.lit(1).alias("query_no"), F.lit("q").alias("query"), F.expr(SEARCH_BODY).alias("body")
    )
    return rd.parse_search_results(raw).select("claim_id", "rank", "url", "title", "publisher")


@query(
    "admitted_claims",
    """select case when text is null or text = '' then 'missing' when length(text) > 5000 then 'too_long' when trim(text) = '' then 'blank' else 'accepted' end as reason,
  count(*) as n from documents group by 1""",
)
def admitted_claims(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("claim_id"), F.col("text").alias("claim"))
    good, bad = rd.admit_claims(rows)
    return good.select(F.lit("accepted").alias("reason")).unionByName(bad.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "admitted_pages",
    """select page_id, length(case when strlen(html) > 20000 then substring(html, 1, 10000) else html end) as chars from pages
where page_id % 4 <> 3""",
)
def admitted_pages(spark, sf_dir):
    kinds = F.expr("element_at(array('text/html; charset=utf-8', 'TEXT/PLAIN', 'application/xml', 'image/png'), cast(page_id % 4 + 1 as int))")
    pages = read(spark, sf_dir, "pages").withColumn("content_type", kinds)
    return rd.admit_pages(pages, max_bytes=20000).select("page_id", F.length("html").alias("chars"))
