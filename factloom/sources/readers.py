"""Readers for every input table, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicon as lx

CLAIM_SCHEMA = "claim_id long, claim string, lang string, client_id string, ts timestamp"
REVIEW = "array<struct<publisher:struct<name:string,site:string>,url:string,title:string,reviewDate:string,textualRating:string>>"
PROVIDER_SCHEMA = f"claims array<struct<text:string,claimant:string,claimDate:string,claimReview:{REVIEW}>>"
WEB_SCHEMA = "web struct<results:array<struct<url:string,title:string,description:string,meta:struct<publisher:string>>>>"
ORGANIC_SCHEMA = "organic_results array<struct<link:string,title:string,snippet:string,source:string>>"
LOG_SCHEMA = (
    "requestId string, timestamp timestamp, clientId string, claimHash string, verdict string, confidence double, "
    "sourceTier string, cached boolean, durationMs double"
)
OUTPUT_ROW_SCHEMA = "claim_id long, raw string"
BENCHMARK_SCHEMA = (
    "id string, claim string, label string, domain string, difficulty string, "
    "reference_sources array<struct<title:string,url:string>>, language string, date_of_claim string, "
    "time_sensitivity string, annotator string"
)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores on a table stored in fewer files than there are cores.

    Large tables already have more input partitions than that and are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def _load(spark: SparkSession, path: str, schema: str, fmt: str) -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def admit_claims(df: DataFrame, max_len: int = lx.MAX_CLAIM_CHARS) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantine): required, not blank, length tested before and after trimming."""
    text = F.col("claim")
    reason = (
        F.when(text.isNull() | (text == ""), "missing")
        .when(F.length(text) > max_len, "too_long")
        .when(F.trim(text) == "", "blank")
    )
    marked = df.withColumn("reason", reason)
    accepted = marked.filter(F.col("reason").isNull()).drop("reason").withColumn("claim", F.trim("claim"))
    return accepted, marked.filter(F.col("reason").isNotNull())


def read_claims(spark: SparkSession, path: str, fmt: str = "json") -> tuple[DataFrame, DataFrame]:
    return admit_claims(_load(spark, path, CLAIM_SCHEMA, fmt))


def flatten_fact_checks(responses: DataFrame) -> DataFrame:
    """One row per provider claim with a usable first review; the others are skipped."""
    rows = responses.select(F.explode("claims").alias("c")).withColumn(
        "r", F.try_element_at("c.claimReview", F.lit(1))
    )
    usable = (
        (F.length("c.text") > 0)
        & (F.length("r.url") > 0)
        & (F.length("r.textualRating") > 0)
        & F.col("r.url").rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/?#\s]+|[^/\s])")
    )
    name = F.coalesce(F.nullif("r.publisher.name", F.lit("")), F.lit("Unknown Publisher"))
    return rows.filter(usable).select(
        F.col("c.text").alias("claim_text"), F.col("c.claimant").alias("claimant"), F.col("c.claimDate").alias("claim_date"),
        F.struct(name.alias("name"), F.col("r.publisher.site").alias("site")).alias("publisher"),
        F.struct(
            F.col("r.title").alias("title"), F.col("r.url").alias("url"), F.col("r.reviewDate").alias("review_date"),
            F.col("r.textualRating").alias("textual_rating"),
        ).alias("review"),
    )


def with_fact_check_id(checks: DataFrame) -> DataFrame:
    """A stable id from the content; a fact-check in several responses is one row."""
    parts = [F.coalesce(c, F.lit("")) for c in ("claim_text", "review.url", "review.textual_rating")]
    return checks.withColumn("fc_id", F.sha2(F.concat_ws("\u0001", *parts), 256)).dropDuplicates(["fc_id"])


def read_fact_checks(spark: SparkSession, path: str) -> DataFrame:
    return with_fact_check_id(flatten_fact_checks(_load(spark, path, PROVIDER_SCHEMA, "json")))


def parse_search_results(raw: DataFrame, col: str = "body") -> DataFrame:
    """Two provider shapes to one schema; needs claim_id, query_no and query beside the JSON."""
    keys = ["claim_id", "query_no", "query"]
    web = raw.select(*keys, F.posexplode(F.from_json(col, WEB_SCHEMA)["web"]["results"]).alias("p", "r")).select(
        *keys, "p", "r.url", "r.title", F.col("r.description").alias("snippet"), F.col("r.meta.publisher").alias("publisher")
    )
    organic = raw.select(*keys, F.posexplode(F.from_json(col, ORGANIC_SCHEMA)["organic_results"]).alias("p", "r")).select(
        *keys, "p", F.col("r.link").alias("url"), "r.title", "r.snippet", F.col("r.source").alias("publisher")
    )
    both = web.unionByName(organic)
    return both.select(
        *keys, (F.col("p") + 1).alias("rank"), F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("title", F.lit("")).alias("title"), "snippet", "publisher",
        F.lit(None).cast("timestamp").alias("published_at"),
    )


def read_search_results(spark: SparkSession, path: str) -> DataFrame:
    return parse_search_results(_load(spark, path, "claim_id long, query_no int, query string, body string", "json"))


def admit_pages(pages: DataFrame, max_bytes: int = lx.MAX_PAGE_BYTES) -> DataFrame:
    """Keep text content types; cut over-long pages to half the cap in characters."""
    if "content_type" in pages.columns:
        kind = F.lower(F.trim(F.split_part("content_type", F.lit(";"), F.lit(1))))
        pages = pages.filter(kind.isin(lx.CONTENT_TYPES))
    body = F.col("html")
    cut = F.when(F.octet_length(body) > max_bytes, F.substring(body, 1, max_bytes // 2)).otherwise(body)
    return pages.filter(F.length(body) > 0).withColumn("html", cut).withColumn(
        "word_count", F.size(F.regexp_extract_all("html", F.lit(r"\S+"), F.lit(0)))
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return admit_pages(spark.read.parquet(path))


def read_request_log(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return _load(spark, path, LOG_SCHEMA, fmt)


def stream_request_log(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.readStream.schema(LOG_SCHEMA).format(fmt).load(path)


def read_model_outputs(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return _load(spark, path, OUTPUT_ROW_SCHEMA, fmt)


def read_benchmark_claims(spark: SparkSession, path: str) -> DataFrame:
    return _load(spark, path, BENCHMARK_SCHEMA, "json")
