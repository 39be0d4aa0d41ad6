"""Round trips through the readers and writers, in the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grounding as gr
from ..session import work_folder
from ..sources import readers as rd
from ..sources import writers as wr
from .catalog import query
from .matching import FULL
from .serving import CACHE_SQL, now, stored_cache
from .tables import SQL_LABELLED, SQL_LOG, labelled, read, request_log
from .verdicts import SQL as VERDICT_SQL
from .verdicts import outputs


@query(
    "verdict_table_files",
    f"{FULL}, {CACHE_SQL} select claim_hash, verdict, confidence, age::bigint as age from cache",
)
def verdict_table_files(spark, sf_dir):
    """The stored verdict table, written by hash and read by version."""
    path = work_folder(spark, "verdict-table")
    wr.write_cache(stored_cache(spark, sf_dir), path)
    age = F.unix_seconds(now()) - F.unix_seconds("created_at")
    return wr.read_cache(spark, path).select("claim_hash", "verdict", "confidence", age.alias("age"))


@query(
    "request_log_files",
    f"""with {SQL_LOG} select concat('r', request_id) as request_id, ts_ms, concat('c', client_id) as client_id, claim_hash, verdict, confidence, tier, tier = 'CACHE' as cached, latency_ms from log""",
)
def request_log_files(spark, sf_dir):
    """Request log lines as JSON files and back."""
    path = work_folder(spark, "request-log")
    log = request_log(spark, sf_dir)
    log.select(
        F.concat(F.lit("r"), "request_id").alias("requestId"), F.col("ts").alias("timestamp"), F.concat(F.lit("c"), "client_id").alias("clientId"),
        F.col("claim_hash").alias("claimHash"), "verdict", "confidence", F.col("tier").alias("sourceTier"), (F.col("tier") == "CACHE").alias("cached"),
        F.col("latency_ms").alias("durationMs"),
    ).write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
    return rd.read_request_log(spark, path).select(
        F.col("requestId").alias("request_id"), F.expr("floor(unix_micros(timestamp) / 1000)").cast("bigint").alias("ts_ms"),
        F.col("clientId").alias("client_id"), F.col("claimHash").alias("claim_hash"), "verdict", "confidence", F.col("sourceTier").alias("tier"), "cached",
        F.col("durationMs").alias("latency_ms"),
    )


@query(
    "model_output_files",
    f"with {VERDICT_SQL} select claim_id, sha256(o.raw) as raw_hash, p.valid from outs o join parsed p using (claim_id)",
)
def model_output_files(spark, sf_dir):
    """Model outputs as JSON lines, read and parsed."""
    path = work_folder(spark, "model-outputs")
    outputs(spark, sf_dir).select("claim_id", "raw").write.json(path)
    parsed = gr.parse_outputs(rd.read_model_outputs(spark, path))
    return parsed.select("claim_id", F.sha2("raw", 256).alias("raw_hash"), "valid")


@query("verdict_files", f"with {SQL_LABELLED} select doc_id, pred as verdict, confidence from labelled")
def verdict_files(spark, sf_dir):
    """Verdicts partitioned by verdict, appended in two runs."""
    path = work_folder(spark, "verdicts")
    rows = labelled(spark, sf_dir).select("doc_id", F.col("pred").alias("verdict"), "confidence")
    wr.write_verdicts(rows.filter("doc_id % 2 = 0"), path)
    wr.write_verdicts(rows.filter("doc_id % 2 = 1"), path)
    return spark.read.schema("doc_id long, confidence double, verdict string").parquet(path).select("doc_id", "verdict", "confidence")


@query(
    "benchmark_claim_files",
    "select cast(item_id as varchar) as id, text as claim, 'http://b/' || item_id as first_source, 1::bigint as sources from benchmark",
)
def benchmark_claim_files(spark, sf_dir):
    """Benchmark claims as JSON lines with their reference sources."""
    path = work_folder(spark, "benchmark")
    source = F.array(F.struct(F.lit("t").alias("title"), F.concat(F.lit("http://b/"), "item_id").alias("url")))
    read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("claim"), source.alias("reference_sources")).write.json(path)
    return rd.read_benchmark_claims(spark, path).select(
        "id", "claim", F.col("reference_sources")[0]["url"].alias("first_source"), F.size("reference_sources").cast("bigint").alias("sources")
    )
