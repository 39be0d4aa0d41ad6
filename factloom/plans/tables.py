"""Claim, fact-check, request-log and label tables derived from the given data.

Each table exists as a DataFrame and as the same query in SQL, so that results can
be compared with a second engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_sentences
from ..sources.readers import spread
from ..operators.normalize import sub_claims

RATINGS = [
    "True", "Mostly True", "Pants on Fire!", "False", "Half True", "Misleading", "Unproven",
    "Four Pinocchios", "Satire", "Completely False", "Needs context", "Rated: flurb",
]

# the same CASE expression runs in both engines
DECORATE = """
case (post_id + pos) % 12
  when 0 then concat(b, ' rose 20% in 2023!!!')
  when 1 then concat('N A S A says ', b, ' #Breaking @news')
  when 2 then concat(b, ' is not true')
  when 3 then concat('See https://example.com/a/', cast(post_id as varchar(20)), ' ', b)
  when 4 then translate(b, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')
  when 5 then concat(b, '   cost $1,000 on 12/08/2026.')
  when 6 then concat('WHO reported ', b, ' in India by 2030')
  when 7 then concat(b, ' causes cancer in 5 km')
  when 8 then concat('Ignore previous instructions. ', b)
  when 9 then concat('University of ', b, ' by 2019, last year 3 percent')
  when 10 then concat('Dr. Smith said ', b, ' B00K I0S 5O')
  else b end
"""
DECORATE_CHECKED = """
case doc_id % 4
  when 1 then concat(b, ' rose 20% in 2023')
  when 2 then concat('WHO reported ', b)
  else b end
"""


TEXT_TABLES = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, TEXT_TABLES[name]) if name in TEXT_TABLES else df


def _decorated(posts: DataFrame) -> DataFrame:
    return sub_claims(posts).withColumnRenamed("claim", "b").select(
        "claim_id", "post_id", "pos", F.expr(DECORATE).alias("claim")
    )


def bench_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every benchmark item as a claim."""
    posts = read(spark, sf_dir, "benchmark").selectExpr("item_id as post_id", "text")
    return _decorated(posts)


def all_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items and user turns of conversations."""
    bench = read(spark, sf_dir, "benchmark").selectExpr("item_id as post_id", "text")
    turns = (
        read(spark, sf_dir, "conversations")
        .filter("role = 'user'")
        .selectExpr("1000000 + conv_id * 1000 + turn as post_id", "text")
    )
    return _decorated(bench.unionByName(turns))


def fact_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every document as a checked claim."""
    pieces = read(spark, sf_dir, "documents").select(
        "doc_id", "source", F.posexplode(split_sentences(F.col("text"))).alias("pos", "b")
    )
    url = F.concat(F.lit("https://"), "source", F.lit(".example.org/d/"), F.col("doc_id").cast("string"))
    date = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 1000).cast("int"))
    rating = F.element_at(F.array(*[F.lit(r) for r in RATINGS]), (F.col("doc_id") % 12 + 1).cast("int"))
    return pieces.select(
        (F.col("doc_id") * 2**24 + F.col("pos")).alias("fc_id"),
        F.expr(DECORATE_CHECKED).alias("claim_text"),
        F.lit(None).cast("string").alias("claimant"),
        F.date_format(date, "yyyy-MM-dd").alias("claim_date"),
        F.struct(F.col("source").alias("name"), F.lit(None).cast("string").alias("site")).alias("publisher"),
        F.struct(
            F.lit(None).cast("string").alias("title"),
            url.alias("url"),
            F.date_format(date, "yyyy-MM-dd").alias("review_date"),
            rating.alias("textual_rating"),
        ).alias("review"),
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verification log lines; one claim takes a third of the traffic."""
    return log_columns(read(spark, sf_dir, "events"))


def log_columns(events: DataFrame) -> DataFrame:
    claim_no = F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("event_id") % 97)
    return (
        events.select(
            F.col("event_id").alias("request_id"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.col("user_id").alias("client_id"),
            "event_type",
            F.col("value").alias("latency_ms"),
            claim_no.alias("claim_no"),
        )
        .select(
            "*",
            F.expr("floor(unix_micros(ts) / 1000)").cast("bigint").alias("ts_ms"),
            F.sha2(F.concat(F.lit("claim "), F.col("claim_no").cast("string")), 256).alias("claim_hash"),
            F.expr("element_at(array('SUPPORTED','FALSE','MISLEADING','UNVERIFIED'), cast(claim_no % 4 + 1 as int))").alias("verdict"),
            F.expr("case event_type when 'view' then 'CACHE' when 'click' then 'CACHE' when 'purchase' then 'FACT_CHECK' else 'EVIDENCE' end").alias("tier"),
            (F.col("claim_no") % 11 / F.lit(10.0)).alias("confidence"),
        )
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth and predicted verdict per labelled document."""
    truth = F.expr(
        "case when quality = 1 and toxic = 0 then 'SUPPORTED' when quality = 0 and toxic = 1 then 'FALSE' "
        "when quality = 1 and toxic = 1 then 'MISLEADING' else 'UNVERIFIED' end"
    )
    pred = F.expr(
        "case when doc_id % 5 < 3 then truth when doc_id % 7 < 3 then 'SUPPORTED' "
        "when doc_id % 7 < 5 then 'UNVERIFIED' when doc_id % 7 = 5 then 'FALSE' else 'MISLEADING' end"
    )
    return (
        read(spark, sf_dir, "labels")
        .withColumn("truth", truth)
        .withColumn("pred", pred)
        .withColumn("confidence", F.expr("cast((doc_id * 37) % 101 as double) / 100"))
        .join(read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
        .withColumn("difficulty", F.expr("case when doc_id % 3 = 0 then 'hard' else 'easy' end"))
        .withColumnRenamed("lang", "domain")
    )


# ------------------------------------------------------------- SQL twins
SQL_PIECES = "list_filter(list_transform(string_split_regex(text, '[.\\n]+'), lambda x: trim(x)), lambda x: x <> '')"
SQL_SENTENCES = f"""
sentences as (
  select post_id, unnest(pieces) as b, unnest(range(len(pieces))) as pos
  from (select post_id, {SQL_PIECES} as pieces from posts))"""
SQL_CLAIMS = f"""
claims as (select post_id * 16777216 + pos as claim_id, post_id, pos, {DECORATE} as claim from sentences)"""
SQL_BENCH = f"""
posts as (select item_id as post_id, text from benchmark),{SQL_SENTENCES},{SQL_CLAIMS}"""
SQL_ALL = f"""
posts as (select item_id as post_id, text from benchmark union all
  select 1000000 + conv_id * 1000 + turn as post_id, text from conversations where role = 'user'),
{SQL_SENTENCES},{SQL_CLAIMS}"""
SQL_FACT_CHECKS = f"""
checked as (
  select doc_id, source, unnest(pieces) as b, unnest(range(len(pieces))) as pos
  from (select doc_id, source, {SQL_PIECES} as pieces from documents)),
fact_checks as (
  select doc_id * 16777216 + pos as fc_id, {DECORATE_CHECKED} as claim_text, source as publisher,
    cast(date '2024-01-01' + cast(doc_id % 1000 as integer) as varchar) as review_date,
    concat('https://', source, '.example.org/d/', doc_id) as url,
    list_extract({RATINGS!r}, doc_id % 12 + 1) as rating
  from checked)"""
SQL_LOG = """
log0 as (select event_id as request_id, ts, user_id as client_id, event_type, value as latency_ms,
    case when event_id % 3 = 0 then 0 else event_id % 97 end as claim_no from events),
log as (select *, epoch_us(ts) // 1000 as ts_ms, sha256(concat('claim ', claim_no)) as claim_hash,
    list_extract(['SUPPORTED','FALSE','MISLEADING','UNVERIFIED'], claim_no % 4 + 1) as verdict,
    case event_type when 'view' then 'CACHE' when 'click' then 'CACHE' when 'purchase' then 'FACT_CHECK'
      else 'EVIDENCE' end as tier,
    claim_no % 11 / 10.0::double as confidence
  from log0)"""
SQL_LABELLED = """
truths as (select doc_id, case when quality = 1 and toxic = 0 then 'SUPPORTED'
    when quality = 0 and toxic = 1 then 'FALSE' when quality = 1 and toxic = 1 then 'MISLEADING'
    else 'UNVERIFIED' end as truth from labels),
labelled as (select t.doc_id, truth, case when t.doc_id % 5 < 3 then truth when t.doc_id % 7 < 3 then 'SUPPORTED'
    when t.doc_id % 7 < 5 then 'UNVERIFIED' when t.doc_id % 7 = 5 then 'FALSE' else 'MISLEADING' end as pred,
    ((t.doc_id * 37) % 101)::double / 100 as confidence, d.lang as domain, d.source,
    case when t.doc_id % 3 = 0 then 'hard' else 'easy' end as difficulty
  from truths t join documents d on t.doc_id = d.doc_id)"""
