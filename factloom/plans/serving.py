"""Queries over the verdict table, the cascade, the request log and monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import round_half_up
from ..operators import cache as ca
from ..operators import cascade as cs
from ..operators import evaluation as evl
from ..operators import limits as li
from ..operators import matching as mt
from ..operators import ratings as rt
from ..session import stored, work_folder
from . import sqltext as st
from .catalog import query
from .matching import FULL, keyed_claims, verdict_rows
from .tables import SQL_LOG, fact_checks, read, request_log

AS_OF = "2024-02-01 00:00:00"


def now():
    return F.lit(AS_OF).cast("timestamp")


_AGE = "(claim_id * 13) % 200000"

# stored verdicts of documents: some entries broken on purpose
ENTRY = """concat('{"schemaVersion":"v1","claimHash":"', case when doc_id % 11 = 0 then 'abc' else sha2(cast(doc_id as string), 256) end,
  '","normalizedClaim":"c","verdict":"', element_at(array('SUPPORTED','FALSE','MISLEADING','UNVERIFIED','MAYBE'), cast(doc_id % 5 + 1 as int)),
  '","confidence":', cast(doc_id % 13 as string), 'e-1,"explanation":"x","sources":[{"title":"t","url":"u","publisher":"',
  source, case when doc_id % 7 = 0 then '"' else '","publishDate":"2024-01-01"' end, '}],"sourceTier":"AI_RAG","createdAt":"2024-01-01T00:00:00Z","expiresAt":"',
  case when doc_id % 17 = 0 then 'soon' else '2024-03-01T00:00:00Z' end, '"', case when doc_id % 19 = 0 then '' else '}' end)"""


@query(
    "cache_entry_validation",
    """select doc_id, doc_id % 11 <> 0 and doc_id % 5 <> 4 and doc_id % 13 <= 10 and doc_id % 7 <> 0 and doc_id % 17 <> 0 and doc_id % 19 <> 0 as valid
from documents""",
)
def cache_entry_validation(spark, sf_dir):
    raw = read(spark, sf_dir, "documents").select("doc_id", F.expr(ENTRY).alias("value"))
    return ca.parse_entries(raw).select("doc_id", "valid")


def stored_cache(spark, sf_dir):
    """Verdicts stored at different times, one per distinct benchmark claim of two in three."""
    claims = keyed_claims(spark, sf_dir).filter("claim_id % 3 <> 0")
    base = claims.groupBy("claim_hash").agg(F.min("claim_id").alias("claim_id"))
    created = F.timestamp_seconds(F.unix_seconds(now()) - F.expr(_AGE))
    return base.select(
        "claim_hash",
        F.expr("element_at(array('SUPPORTED','FALSE','MISLEADING','UNVERIFIED'), cast(claim_id % 4 + 1 as int))").alias("verdict"),
        (F.col("claim_id") % 10 / F.lit(10.0)).alias("confidence"),
        F.lit("stored").alias("explanation"), F.lit("FACT_CHECK_API").alias("source_tier"),
        created.alias("created_at"), F.timestamp_seconds(F.unix_seconds(created) + 86400).alias("expires_at"),
    )


CACHE_SQL = f"""
hashed as (select claim_id, sha256(normalized) as claim_hash, normalized from norm),
cache as (select claim_hash, list_extract(['SUPPORTED','FALSE','MISLEADING','UNVERIFIED'], claim_id % 4 + 1) as verdict,
  claim_id % 10 / 10.0::double as confidence, {_AGE} as age from (select claim_hash, min(claim_id) as claim_id from hashed where claim_id % 3 <> 0 group by 1))"""


@query(
    "cache_lookup",
    f"{FULL}, {CACHE_SQL} select claim_id, age is not null as hit, c.verdict, c.confidence from hashed left join (select * from cache where age <= 86400) c using (claim_hash)",
)
def cache_lookup(spark, sf_dir):
    claims = keyed_claims(spark, sf_dir).select("claim_id", "claim_hash")
    return ca.cache_lookup(claims, stored_cache(spark, sf_dir), now()).select("claim_id", "hit", "verdict", "confidence")


@query(
    "cache_upsert",
    f"""{FULL}, {CACHE_SQL}, fresh as (select distinct claim_hash from hashed where claim_id % 4 = 0)
select claim_hash, case when f.claim_hash is not null then 'UNVERIFIED' else verdict end as verdict,
  case when f.claim_hash is not null then 900 else 86400 - age end as seconds_left
from cache full join fresh f using (claim_hash)""",
)
def cache_upsert(spark, sf_dir):
    cache = stored_cache(spark, sf_dir)
    fresh = keyed_claims(spark, sf_dir).filter("claim_id % 4 = 0").select("claim_hash").distinct().select(
        "claim_hash", F.lit("UNVERIFIED").alias("verdict"), F.lit(0.0).alias("confidence"), F.lit("none found").alias("explanation"),
        F.lit("FACT_CHECK_API").alias("source_tier"), F.lit("NO_MATCH").alias("outcome"),
    )
    merged = ca.cache_upsert(cache, fresh, now(), ca.outcome_ttl(F.col("outcome")))
    return merged.select("claim_hash", "verdict", (F.unix_seconds("expires_at") - F.unix_seconds(now())).alias("seconds_left"))


@query(
    "cache_invalidate",
    f"{FULL}, {CACHE_SQL} select claim_hash, verdict from cache where claim_hash not in (select claim_hash from hashed where claim_id % 5 = 0)",
)
def cache_invalidate(spark, sf_dir):
    gone = keyed_claims(spark, sf_dir).filter("claim_id % 5 = 0").select("claim_hash")
    return ca.cache_invalidate(stored_cache(spark, sf_dir), gone).select("claim_hash", "verdict")


OUTCOME = "case event_type when 'view' then 'HIT' when 'click' then 'MISS' when 'error' then 'ERROR' when 'signup' then 'SET' else 'SET_FAIL' end"


@query(
    "cache_metrics",
    f"""with {SQL_LOG}, o as (select *, {OUTCOME} as outcome from log)
select count_if(outcome = 'HIT') as hits, count_if(outcome = 'MISS') as misses, count_if(outcome = 'ERROR') as errors, count_if(outcome = 'SET') as sets,
  count_if(outcome = 'SET_FAIL') as set_failures, count_if(outcome = 'HIT') / nullif(count_if(outcome in ('HIT', 'MISS')), 0)::double as hit_ratio,
  {st.half_up("avg(latency_ms) filter (where outcome in ('HIT', 'MISS'))", 6)} as avg_lookup_ms,
  {st.half_up("avg(latency_ms) filter (where outcome in ('SET', 'SET_FAIL'))", 6)} as avg_write_ms from o""",
)
def cache_metrics(spark, sf_dir):
    df = ca.cache_metrics(request_log(spark, sf_dir).withColumn("outcome", F.expr(OUTCOME)))
    return df.withColumns({c: round_half_up(F.col(c), 6) for c in ("avg_lookup_ms", "avg_write_ms")})


def replay_sql(ttl: int) -> str:
    return f"""{SQL_LOG}, nodes as materialized (select claim_hash, ts_ms, min(request_id) as first_id,
  min(ts_ms) over (partition by claim_hash order by ts_ms range between {ttl * 1000 + 1} following and unbounded following) as nxt from log group by claim_hash, ts_ms),
starts as (select claim_hash, min(ts_ms) as start from nodes group by 1 union all
  select s.claim_hash, n.nxt from starts s join nodes n on n.claim_hash = s.claim_hash and n.ts_ms = s.start where n.nxt is not null),
opened as (select s.claim_hash, s.start, n.first_id from starts s join nodes n on n.claim_hash = s.claim_hash and n.ts_ms = s.start),
replayed as (select l.*, o.start as window_start, case when l.request_id = o.first_id then 'MISS' else 'HIT' end as outcome
  from log l asof join opened o on l.claim_hash = o.claim_hash and l.ts_ms >= o.start)"""


@query("cache_replay", f"with recursive {replay_sql(86400)} select request_id, window_start, outcome from replayed")
def cache_replay(spark, sf_dir):
    return ca.cache_replay(request_log(spark, sf_dir)).select("request_id", "window_start", "outcome")


@query("cache_replay_short_ttl", f"with recursive {replay_sql(900)} select outcome, count(*) as n from replayed group by 1")
def cache_replay_short_ttl(spark, sf_dir):
    return ca.cache_replay(request_log(spark, sf_dir), 900).groupBy("outcome").agg(F.count("*").alias("n"))


@query(
    "stampede",
    f"""with recursive {replay_sql(86400)} select claim_hash, window_start, count(*) as requests,
  count_if(outcome = 'HIT' and ts_ms - window_start <= 600000) as in_flight_duplicates from replayed group by 1, 2""",
)
def stampede(spark, sf_dir):
    return ca.stampede(ca.cache_replay(request_log(spark, sf_dir)), 600000)


@query(
    "cost_savings",
    f"""with recursive {replay_sql(86400)} select count(*) as requests, count_if(outcome = 'HIT') as avoided,
  count_if(outcome = 'HIT') / count(*)::double as hit_ratio, count_if(outcome = 'HIT') * 4950.0::double as saved_ms from replayed""",
)
def cost_savings(spark, sf_dir):
    return ca.savings(ca.cache_replay(request_log(spark, sf_dir)), 5000.0, 50.0)


@query(
    "page_cache",
    """with p as (select url, min(page_id) as first_page, max(page_id) as last_page from pages group by url)
select url, last_page, (last_page * 37) % 5000 + 3600 > 5000 as live from p""",
)
def page_cache(spark, sf_dir):
    """Stored page content: newest copy per url, live for an hour after it was fetched."""
    fetched = F.timestamp_seconds(F.unix_seconds(now()) - 5000 + (F.col("page_id") * 37) % 5000)
    rows = read(spark, sf_dir, "pages").select("url", "page_id", fetched.alias("fetched"))
    newest = rows.groupBy("url").agg(F.max_by("fetched", "page_id").alias("created_at"), F.max("page_id").alias("last_page"))
    entries = newest.withColumn("expires_at", F.timestamp_seconds(F.unix_seconds("created_at") + 3600))
    return entries.select("url", "last_page", (F.col("expires_at") > now()).alias("live"))


# --------------------------------------------------------------- cascade
MODEL = "element_at(array('SUPPORTED','FALSE','MISLEADING'), cast(claim_id % 3 + 1 as int))"
CASCADE_SQL = f"""{FULL}, {CACHE_SQL},
tier2 as (select h.claim_id, h.claim_hash, case when h.claim_id % 23 = 0 then 'ERROR' when v.match_type in ('EXACT', 'HIGH_CONFIDENCE') then 'MATCH'
    when v.match_type is not null then 'UNRELIABLE' else 'NO_MATCH' end as outcome2, v.verdict as v2, v.confidence as c2
  from hashed h left join fc_verdicts v using (claim_id)),
casc as (select t.claim_id, c.claim_hash is not null as cached,
  case when c.claim_hash is not null then 'HIT' when t3 and need then 'MODEL' else outcome2 end as outcome,
  case when c.claim_hash is not null then c.verdict when t3 and need then list_extract(['SUPPORTED','FALSE','MISLEADING'], t.claim_id % 3 + 1)
    when outcome2 = 'MATCH' then v2 else 'UNVERIFIED' end as verdict,
  case when c.claim_hash is not null then c.confidence when t3 and need then 0.5::double when outcome2 = 'MATCH' then c2 else 0.0::double end as confidence,
  case when c.claim_hash is null and t3 and need then 'AI_RAG' else 'FACT_CHECK_API' end as source_tier
  from (select *, claim_id % 2 = 0 as t3, (outcome2 <> 'MATCH' or (v2 = 'UNVERIFIED' and c2 = 0)) as need from tier2) t
  left join (select * from cache where age <= 86400) c using (claim_hash))"""


def cascade_inputs(spark, sf_dir):
    keyed = keyed_claims(spark, sf_dir)
    claims = keyed.select("claim_id", "claim_hash", "normalized", "match_key", (F.col("claim_id") % 23 != 0).alias("provider_ok"))
    matches = verdict_rows(spark, sf_dir).dropDuplicates(["match_key"])
    model = keyed.filter("claim_id % 2 = 0").select(
        "claim_id", F.expr(MODEL).alias("verdict"), F.lit(0.5).alias("confidence"), F.lit("model").alias("explanation")
    )
    return claims, stored_cache(spark, sf_dir), matches, model


@query("cascade", f"{CASCADE_SQL} select claim_id, cached, outcome, verdict, confidence, source_tier from casc")
def cascade(spark, sf_dir):
    """Fact-checks are searched for misses only, and the model is asked for what they left open."""
    keyed = keyed_claims(spark, sf_dir)
    claims = keyed.select("claim_id", "claim_hash", "normalized", "metadata", "match_key", (F.col("claim_id") % 23 != 0).alias("provider_ok"))

    def search(misses):
        return rt.map_ratings(mt.match_fact_checks(misses, fact_checks(spark, sf_dir)))

    def answer(still_open):
        return still_open.filter("claim_id % 2 = 0").select(
            "claim_id", F.expr(MODEL).alias("verdict"), F.lit(0.5).alias("confidence"), F.lit("model").alias("explanation")
        )

    return cs.verify_in_stages(claims, stored_cache(spark, sf_dir), search, answer, now()).select(
        "claim_id", "cached", "outcome", "verdict", "confidence", "source_tier"
    )


@query(
    "cache_negative_ttl",
    f"""{CASCADE_SQL} select outcome, case when outcome in ('MATCH', 'MODEL') then 86400 else 900 end as ttl, count(*) as n from casc
where outcome not in ('HIT', 'ERROR') group by all""",
)
def cache_negative_ttl(spark, sf_dir):
    claims, cache, matches, model = cascade_inputs(spark, sf_dir)
    rows = cs.to_cache_rows(cs.verify(claims, cache, matches, model, now()))
    return rows.groupBy("outcome", "ttl").agg(F.count("*").alias("n"))


CONFIGS = {"full": cs.TIERS, "no_model": ("cache", "fact_check"), "no_cache": ("fact_check", "model"), "fact_check_only": ("fact_check",), "model_only": ("model",)}
_T2 = "case when outcome2 = 'MATCH' then v2 else 'UNVERIFIED' end"
_T3 = "list_extract(['SUPPORTED','FALSE','MISLEADING'], t.claim_id % 3 + 1)"
_HIT = "c.claim_hash is not null"
RUNS_SQL = f"""{CASCADE_SQL},
wide as (select t.claim_id, {_HIT} as hit, c.verdict as cv, outcome2, {_T2} as fv, t.claim_id % 2 = 0 as has_model, {_T3} as mv,
    (outcome2 <> 'MATCH' or (v2 = 'UNVERIFIED' and c2 = 0)) as need from tier2 t left join (select * from cache where age <= 86400) c using (claim_hash)),
runs as (
  select claim_id, 'full' as config, case when hit then cv when need and has_model then mv else fv end as verdict, case when hit then 'HIT' when need and has_model then 'MODEL' else outcome2 end as outcome from wide union all
  select claim_id, 'no_model', case when hit then cv else fv end, case when hit then 'HIT' else outcome2 end from wide union all
  select claim_id, 'no_cache', case when need and has_model then mv else fv end, case when need and has_model then 'MODEL' else outcome2 end from wide union all
  select claim_id, 'fact_check_only', fv, outcome2 from wide union all
  select claim_id, 'model_only', case when has_model then mv else 'UNVERIFIED' end, case when has_model then 'MODEL' else 'DISABLED' end from wide)"""


def ablation_runs(spark, sf_dir):
    claims, cache, matches, model = cascade_inputs(spark, sf_dir)
    return cs.ablation(stored(cs.tier_outcomes(claims, cache, matches, model, now()), "tiers"), CONFIGS)


@query("ablation", f"{RUNS_SQL} select config, verdict, count(*) as n from runs group by all")
def ablation(spark, sf_dir):
    return ablation_runs(spark, sf_dir).groupBy("config", "verdict").agg(F.count("*").alias("n"))


@query(
    "ablation_metrics",
    f"""{RUNS_SQL}, judged as (select r.*, l.rated_verdict as truth from runs r left join (select claim_id, rated_verdict from rated) l using (claim_id))
select config, count(*) as claims, count_if(verdict <> 'UNVERIFIED') as decided, count_if(truth is not null) as judged,
  count_if(verdict = truth) / nullif(count_if(truth is not null), 0)::double as accuracy,
  count_if(verdict = truth and verdict <> 'UNVERIFIED') / nullif(count_if(truth is not null and verdict <> 'UNVERIFIED'), 0)::double as precision,
  count_if(verdict <> 'UNVERIFIED') / count(*)::double as coverage, count_if(outcome = 'HIT') as hits, count_if(outcome not in ('HIT', 'DISABLED')) as searches,
  count_if(outcome = 'MODEL') as model_calls from judged group by config""",
)
def ablation_metrics(spark, sf_dir):
    """Truth: the rating of the best fact-check of a claim, however weak the match; others are not judged."""
    truth = verdict_rows(spark, sf_dir).select("claim_id", F.col("rated_verdict").alias("truth"))
    return cs.ablation_metrics(ablation_runs(spark, sf_dir), truth)


@query(
    "ttl_by_claim_type",
    """select event_type as claim_type, case event_type when 'view' then 3600 when 'click' then 600 else 86400 end as ttl, count(*) as n from events group by all""",
)
def ttl_by_claim_type(spark, sf_dir):
    policy = spark.createDataFrame([("view", 3600), ("click", 600)], "claim_type string, ttl int")
    rows = request_log(spark, sf_dir).select(F.col("event_type").alias("claim_type"))
    return ca.type_ttl(rows, policy).groupBy("claim_type", "ttl").agg(F.count("*").alias("n"))


# ------------------------------------------------------------ request log
@query(
    "rate_limit",
    f"""with {SQL_LOG}, w as (select request_id, row_number() over (partition by event_type order by ts_ms, request_id) - 1
    - count(*) over (partition by event_type order by ts_ms range between unbounded preceding and 3600000 preceding) as earlier from log)
select request_id, earlier, greatest(0, 3 - earlier) as remaining, earlier > 3 as rejected from w""",
)
def rate_limit(spark, sf_dir):
    return li.rate_limit(request_log(spark, sf_dir), "event_type", 3_600_000, 3).select(
        "request_id", "earlier", "remaining", "rejected"
    )


@query(
    "window_metrics",
    f"""with {SQL_LOG} select time_bucket(interval '1 hour', ts) as window_start, count(*) as requests, count_if(event_type = 'error') as errors,
  count_if(tier = 'CACHE') as cached, count_if(verdict = 'SUPPORTED') as supported, count_if(verdict = 'FALSE') as false,
  count_if(verdict = 'MISLEADING') as misleading, count_if(verdict = 'UNVERIFIED') as unverified, {st.half_up('avg(latency_ms)', 6)} as avg_latency,
  {st.half_up('quantile_cont(latency_ms, 0.95)', 6)} as p95_latency, count_if(tier = 'CACHE') / count(*)::double as hit_ratio from log group by 1""",
)
def window_metrics(spark, sf_dir):
    df = li.request_metrics(request_log(spark, sf_dir))
    return df.withColumns({c: round_half_up(F.col(c), 6) for c in ("avg_latency", "p95_latency")})


@query(
    "hopping_viral",
    f"""with {SQL_LOG}, x as (select time_bucket(interval '1 hour', ts) - to_hours(k::integer) as window_start, claim_hash from log, unnest(range(6)) as r(k)),
c as (select window_start, claim_hash, count(*) as requests from x group by all)
select * from (select *, row_number() over (partition by window_start order by requests desc, claim_hash) as place from c) where place <= 3""",
)
def hopping_viral(spark, sf_dir):
    return li.viral_claims(request_log(spark, sf_dir), "6 hours", "1 hour")


@query(
    "sessions",
    f"""with {SQL_LOG}, m as (select *, case when ts - lag(ts) over w < interval '30 minutes' then 0 else 1 end as fresh from log window w as (partition by client_id order by ts, request_id)),
s as (select *, sum(fresh) over (partition by client_id order by ts, request_id) as no from m)
select client_id, min(ts) as session_start, max(ts) + interval '30 minutes' as session_end, count(*) as requests, {st.half_up('avg(latency_ms)', 6)} as avg_latency
from s group by client_id, no""",
)
def sessions(spark, sf_dir):
    return li.client_sessions(request_log(spark, sf_dir)).withColumn("avg_latency", round_half_up(F.col("avg_latency"), 6))


@query(
    "tier_latency",
    f"with {SQL_LOG} select tier, count(*) as n, {', '.join(st.half_up(f'quantile_cont(latency_ms, {p})', 6) + ' as ' + n for n, p in (('p50', .5), ('p95', .95), ('p99', .99)))} from log group by 1",
)
def tier_latency(spark, sf_dir):
    df = evl.latency_percentiles(request_log(spark, sf_dir), "tier")
    return df.withColumns({c: round_half_up(F.col(c), 6) for c in ("p50", "p95", "p99")})


@query(
    "latency_percentiles",
    f"with {SQL_LOG} select count(*) as n, {', '.join(st.half_up(f'quantile_cont(latency_ms, {p})', 6) + ' as ' + n for n, p in (('p50', .5), ('p95', .95), ('p99', .99)))} from log",
)
def latency_percentiles(spark, sf_dir):
    df = evl.latency_percentiles(request_log(spark, sf_dir))
    return df.withColumns({c: round_half_up(F.col(c), 6) for c in ("p50", "p95", "p99")})


@query(
    "latency_histogram",
    f"with {SQL_LOG} select case when latency_ms < 0 then 0 when latency_ms >= 400 then 21 else floor(latency_ms / 20)::bigint + 1 end as bucket, count(*) as n from log group by 1",
)
def latency_histogram(spark, sf_dir):
    return evl.latency_histogram(request_log(spark, sf_dir), 0.0, 400.0, 20)


@query(
    "cost_by_tier",
    f"""with {SQL_LOG} select tier, count(*) as requests, count(*) * case tier when 'CACHE' then 0.5::double when 'FACT_CHECK' then 2.0::double else 16.0::double end as cost,
  count(*) * 16.0::double as cost_without_cache from log group by tier""",
)
def cost_by_tier(spark, sf_dir):
    return evl.cost(request_log(spark, sf_dir), {"CACHE": 0.5, "FACT_CHECK": 2.0, "EVIDENCE": 16.0})


@query(
    "failure_rate",
    f"""with {SQL_LOG} select tier, count(*) as requests, count_if(event_type = 'error') as failures, count_if(event_type = 'error') / count(*)::double as failure_rate,
  1 - count_if(event_type = 'error') / count(*)::double as reliability from log group by 1""",
)
def failure_rate(spark, sf_dir):
    return evl.reliability(request_log(spark, sf_dir), "tier")


@query(
    "production_counters",
    f"""with {SQL_LOG} select time_bucket(interval '1 day', ts) as day, count(*) as requests, count_if(event_type <> 'error') as successes, count_if(event_type = 'error') as errors,
  count_if(tier = 'CACHE') as hits, count_if(tier <> 'CACHE') as misses from log group by 1""",
)
def production_counters(spark, sf_dir):
    hit, error = F.col("tier") == "CACHE", F.col("event_type") == "error"
    return request_log(spark, sf_dir).groupBy(F.date_trunc("day", "ts").alias("day")).agg(
        F.count("*").alias("requests"), F.count_if(~error).alias("successes"), F.count_if(error).alias("errors"),
        F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"),
    )


@query(
    "error_rate_trend",
    f"""with {SQL_LOG}, d as (select time_bucket(interval '1 day', ts) as window_start, count(*) as requests, count_if(event_type = 'error') as errors,
  count_if(event_type = 'error') / count(*)::double as error_rate from log group by 1)
select *, error_rate - lag(error_rate) over (order by window_start) as change from d""",
)
def error_rate_trend(spark, sf_dir):
    return evl.error_rate_trend(request_log(spark, sf_dir))


@query(
    "service_latency_trend",
    f"with {SQL_LOG} select tier, time_bucket(interval '1 day', ts) as day, count(*) as n, {', '.join(st.half_up(f'quantile_cont(latency_ms, {p})', 6) + ' as ' + n for n, p in (('p50', .5), ('p95', .95), ('p99', .99)))} from log group by 1, 2",
)
def service_latency_trend(spark, sf_dir):
    df = evl.latency_percentiles(request_log(spark, sf_dir).withColumn("day", F.date_trunc("day", "ts")), "tier", "day")
    return df.withColumns({c: round_half_up(F.col(c), 6) for c in ("p50", "p95", "p99")})


@query(
    "cache_trend",
    f"with recursive {replay_sql(86400)} select time_bucket(interval '1 day', ts) as day, count(*) as requests, count_if(outcome = 'HIT') as hits, count_if(outcome = 'HIT') / count(*)::double as hit_ratio, count_if(outcome = 'MISS' and window_start > first_start) as expired from (select *, min(window_start) over (partition by claim_hash) as first_start from replayed) group by 1",
)
def cache_trend(spark, sf_dir):
    """Hit ratio per day and misses caused by expiry (not the first of their claim)."""
    replayed = ca.cache_replay(request_log(spark, sf_dir))
    firsts = replayed.groupBy("claim_hash").agg(F.min("window_start").alias("first_start"))
    df = replayed.join(firsts, "claim_hash")
    hit = F.col("outcome") == "HIT"
    return df.groupBy(F.date_trunc("day", "ts").alias("day")).agg(
        F.count("*").alias("requests"), F.count_if(hit).alias("hits"),
        (F.count_if(hit) / F.count("*").cast("double")).alias("hit_ratio"),
        F.count_if(~hit & (F.col("window_start") > F.col("first_start"))).alias("expired"),
    )


@query(
    "retention",
    f"with {SQL_LOG} select event_type, count(*) as kept from log where ts >= timestamp '{AS_OF}' - interval 14 days group by 1",
)
def retention(spark, sf_dir):
    return evl.retained(request_log(spark, sf_dir), "ts", AS_OF, 14).groupBy("event_type").agg(F.count("*").alias("kept"))


AGES = {"view": 7, "click": 10, "error": 25}
_KEEP = "case event_type " + " ".join(f"when '{k}' then {v}" for k, v in AGES.items()) + " else 14 end"


@query(
    "retention_by_class",
    f"""with {SQL_LOG}, d as (select *, ts::date as day, ts::date < date '{AS_OF[:10]}' - ({_KEEP})::integer as old from log)
select event_type, old as expired, count(*) as requests, count(distinct day) as days, count_if(event_type = 'error') as errors, {st.half_up('sum(latency_ms)', 4)} as latency_sum from d group by 1, 2""",
)
def retention_by_class(spark, sf_dir):
    """What stays as rows and what stays as totals once retention has run, twice, over a stored log."""
    folder = work_folder(spark, "retention")
    log = request_log(spark, sf_dir).withColumn("day", F.to_date("ts")).withColumn("kind", F.col("event_type"))
    log.repartitionByRange("kind", "day").write.partitionBy("kind", "day").parquet(f"{folder}/log")
    for _ in range(2):
        evl.apply_retention(spark, f"{folder}/log", f"{folder}/totals", AGES, AS_OF, 14, kind="kind")
    total = lambda requests, errors, latency: [F.sum(requests).alias("requests"), F.count_distinct("day").alias("days"), F.sum(errors).alias("errors"), round_half_up(F.sum(latency), 4).alias("latency_sum")]
    kept = spark.read.parquet(f"{folder}/log").groupBy("kind").agg(*total(F.lit(1), (F.col("event_type") == "error").cast("int"), F.col("latency_ms")))
    gone = spark.read.parquet(f"{folder}/totals").groupBy("kind").agg(*total(F.col("requests"), F.col("errors"), F.col("latency_sum")))
    both = kept.withColumn("expired", F.lit(False)).unionByName(gone.withColumn("expired", F.lit(True)))
    return both.select(F.col("kind").alias("event_type"), "expired", *[F.col(c).cast("long").alias(c) for c in ("requests", "days", "errors")], "latency_sum")


@query(
    "security_events",
    f"""with {SQL_LOG}, w as (select request_id, row_number() over (partition by client_id order by ts_ms, request_id) - 1
    - count(*) over (partition by client_id order by ts_ms range between unbounded preceding and 3600000 preceding) as earlier from log)
select 'rate_limit' as type, count(*) as n from w where earlier > 1 union all
select 'oversize', count(*) from documents where length(text) > 5000 union all
select 'unsafe_url', count(*) from pages where regexp_matches(url, '://(?:10|127)[.]|localhost')""",
)
def security_events(spark, sf_dir):
    from ..operators.sources import is_safe_url

    limited = li.rate_limit(request_log(spark, sf_dir), "client_id", 3_600_000, 1).filter("rejected")
    oversize = read(spark, sf_dir, "documents").filter(F.length("text") > 5000)
    unsafe = read(spark, sf_dir, "pages").filter(~is_safe_url(F.col("url")))
    parts = [
        df.agg(F.lit(name).alias("type"), F.count("*").alias("n"))
        for name, df in (("rate_limit", limited), ("oversize", oversize), ("unsafe_url", unsafe))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
