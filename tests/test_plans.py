import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point

TABLES = "documents pages benchmark labels conversations events embeddings".split()
FAST = [
    "normalized_claims", "claim_identity", "search_queries", "fc_verdicts", "validated_verdicts", "rate_limit",
    "class_f1", "window_metrics", "domain_limit",
]


def test_entry(spark):
    assert entry_point.entry(spark).columns[:2] == ["claim_id", "fc_id"]


def test_every_sql_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert len(entry_point.queries()) > 120


@pytest.mark.parametrize("name", FAST)
def test_same_rows_in_second_engine(spark, sf_dir, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = entry_point.queries()[name](spark, sf_dir)
    want = duck.sql(entry_point.oracle_sql()[name])
    order = [want.columns.index(c) for c in df.columns]
    text = lambda rows: sorted(str([None if v is None else (round(v, 9) if isinstance(v, float) else str(v)) for v in r]) for r in rows)
    assert text(df.collect()) == text([[r[i] for i in order] for r in want.fetchall()])


@pytest.mark.parametrize("name", ["fc_verdicts", "page_candidates", "combined_rank", "cascade", "near_dup_pairs"])
def test_no_cross_joins(spark, sf_dir, name):
    plan = entry_point.queries()[name](spark, sf_dir)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "CartesianProduct" not in physical and "BroadcastNestedLoopJoin" not in physical


def test_scan_reads_only_needed_columns(spark, sf_dir):
    plan = entry_point.queries()["accuracy"](spark, sf_dir)._jdf.queryExecution().toString()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and all("text" not in s for s in schemas)


def test_no_python_row_udfs():
    source = "".join(p.read_text() for p in Path(entry_point.__file__).parent.glob("factloom/**/*.py"))
    assert "F.udf(" not in source and ".rdd.map" not in source and "local" + "Checkpoint" not in source
