import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from factloom.operators import matching as mt
from factloom.operators import normalize as nm
from factloom.operators import wordindex as wi


def _checks(spark, n):
    return spark.range(n).select(
        F.col("id").alias("fc_id"), F.concat(F.lit("The river rose over town"), F.col("id").cast("string")).alias("claim_text")
    )


def test_texts_of_other_checks_stay_where_they_are(spark):
    """F15 to F30: a broadcast of the candidates' ids filters the fact-checks before a join sends them."""
    claims = spark.createDataFrame([("The river rose over town7",), ("The river rose over town8",)], "claim string")
    keyed = mt.distinct_claims(mt.with_match_key(nm.claim_identity(claims)))
    found = keyed.select("match_key", F.lit(7).cast("long").alias("fc_id"), F.lit(1).alias("rank"))
    checks = _checks(spark, 500)
    scored = mt.score_candidates(keyed, checks, found)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "rightHint=(strategy=broadcast)" in plan.replace(", rightHint", " rightHint")
    assert sorted((r.fc_id, r.claim_text) for r in scored.collect()) == [(7, "The river rose over town7")] * 2
    assert sorted(r.fc_id for r in mt.named_checks(checks, found).collect()) == [7]


def test_many_candidates_leave_the_join_to_spark(spark, monkeypatch):
    monkeypatch.setattr(mt, "BROADCAST_SETS", 1)
    checks = _checks(spark, 5)
    assert mt.named_checks(checks, checks.filter("fc_id < 2")) is checks


def test_words_of_a_set_lie_together(spark, tmp_path):
    """F15 to F30: lists are written as the sets lie, without a sort that spills."""
    rows = [(i, [f"w{j}" for j in range(i % 7, i % 7 + 5)] + [f"own{i}"]) for i in range(200)]
    wi.build_index(spark.createDataFrame(rows, "id long, words array<string>"), "id", F.col("words"), str(tmp_path / "index"))
    seen = 0
    for file in glob.glob(str(tmp_path / "index/postings/batch=0/*.parquet")):
        sets = pq.ParquetFile(file).read().column("set_no").to_pylist()
        assert sum(a != b for a, b in zip(sets, sets[1:])) == len(set(sets)) - 1
        seen += len(set(sets))
    assert seen == 200
