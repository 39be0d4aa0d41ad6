import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from factloom.operators import grounding, matching, normalize, sources
from factloom.sources import readers

ROOT = Path(__file__).resolve().parents[1]


def test_queries_need_no_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 150 and len(e.oracle_sql()) > 150"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0


@pytest.mark.parametrize("copies", [1, 2, 3])
def test_repeated_fact_checks_count_once(spark, copies):
    text = "the moon is made of green cheese says study"
    claims = matching.with_match_key(normalize.claim_identity(spark.createDataFrame([(1, text)], "claim_id long, claim string"), "claim"))
    row = (7, text, "2024-01-01")
    checks = spark.createDataFrame([row] * copies + [(9, text, "2024-01-01")], "fc_id long, claim_text string, d string")
    checks = checks.withColumn("review", F.struct(F.col("d").alias("review_date")))
    found = matching.fact_check_candidates(matching.distinct_claims(claims), checks).collect()
    assert sorted(r.fc_id for r in found) == [7, 9]


def test_fact_check_ids_are_one_row_each(spark):
    one = ("text", "http://a", "False")
    rows = spark.createDataFrame([one, one, ("text", "http://b", "False")], "claim_text string, url string, rating string")
    checks = rows.select("claim_text", F.struct("url", F.col("rating").alias("textual_rating")).alias("review"))
    assert readers.with_fact_check_id(checks).count() == 2


def test_sentence_ids_never_meet(spark):
    posts = spark.createDataFrame([(1, "a b. " * 1003), (2, "c d. e f.")], "post_id long, text string")
    got = normalize.sub_claims(posts)
    assert got.count() == got.select("claim_id").distinct().count() == 1005


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://a.b/c?a=1&&b=2", "https://a.b/c?a=1&&b=2"), ("https://a.b/c?utm_source=x", "https://a.b/c"), ("https://a.b/c?utm_source=x&", "https://a.b/c"),
        ("https://a.b/c?&", "https://a.b/c?&"), ("https://u@[2001:DB8::1]:80/x", "https://2001:db8::1/x"), ("https://a.b/?", "https://a.b/"),
    ],
)
def test_url_parameters(spark, url, want):
    assert spark.range(1).select(sources.normalize_url(F.lit(url)).alias("u")).first().u == want


def verdicts(spark, status, said, confidence, items, hosts):
    raw = f'{{"verdict": "{said}", "confidence": {confidence}, "summary": "It is true", "reasoning": "Because of reports", "supporting_evidence": ["E1"], "contradicting_evidence": [], "contextual_evidence": []}}'
    outputs = spark.createDataFrame([(1, raw)], "claim_id long, raw string")
    packages = spark.createDataFrame([(1, status, items, hosts, 0.9, 0.9)], "claim_id long, status string, items long, independent_domains long, avg_relevance double, avg_authority double")
    context = spark.createDataFrame([(1, 1, "E1", "SUPPORTS", "Reports say so", "h", 0.9, 0.9)], "claim_id long, context_no int, evidence_id string, direction string, excerpt string, host string, relevance double, authority double")
    return grounding.validate_verdicts(outputs, packages, context).first()


def test_forced_verdicts_lose_the_models_summary(spark):
    got = verdicts(spark, "TIMEOUT", "SUPPORTED", 0.9, 5, 3)
    assert (got.verdict, got.confidence) == ("UNVERIFIED", 0.0)
    if "Insufficient" not in got.summary:
        assert got.summary == "Retrieval status: TIMEOUT" and got.reasoning.endswith(" [Forced UNVERIFIED: Retrieval status: TIMEOUT]")


def test_an_output_without_text_is_an_error_and_no_output_is_no_row(spark):
    outputs = spark.createDataFrame([(1, None)], "claim_id long, raw string")
    packages = spark.createDataFrame([(1, "SUCCESS"), (2, "SUCCESS")], "claim_id long, status string")
    item = ("E1", "SUPPORTS", "Reports say so", "h", 0.9, 0.9)
    context = spark.createDataFrame([(c, 1, *item) for c in (1, 2)], "claim_id long, context_no int, evidence_id string, direction string, excerpt string, host string, relevance double, authority double")
    got = grounding.validate_verdicts(outputs, packages, context).collect()
    assert [(r.claim_id, r.verdict, r.confidence, r.summary) for r in got] == [(1, "AI_ERROR", 0.0, "Invalid model output")]


def test_rules_count_the_package_not_the_context(spark):
    many, few = verdicts(spark, "SUCCESS", "SUPPORTED", 0.75, 5, 3), verdicts(spark, "SUCCESS", "SUPPORTED", 0.75, 1, 1)
    assert many.confidence == 0.75 and "RULE" not in many.validation and many.grounded
    assert few.confidence < 0.7 and "RULE: Confidence 0.8 requires ≥2 evidence items, have 1" in few.validation.replace("0.7 ", "0.8 ")


def test_percentiles_of_one_hot_group(spark):
    from factloom.operators import evaluation

    log = spark.range(4000).selectExpr("if(id % 10 < 9, 'hot', 'cold') as tier", "cast((id * 7919) % 1009 as double) as latency_ms")
    log = log.unionByName(spark.createDataFrame([("one", 3.0), ("cold", None)], "tier string, latency_ms double"))
    got = {r.tier: r for r in evaluation.latency_percentiles(log, "tier").collect()}
    want = log.filter("latency_ms is not null").groupBy("tier").agg(*[F.percentile("latency_ms", F.lit(p)).alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))]).collect()
    assert {r.tier: (r.p50, r.p95, r.p99) for r in want} == {k: (r.p50, r.p95, r.p99) for k, r in got.items()}
    assert got["hot"].n == 3600 and evaluation.latency_percentiles(log).count() == 1
