import duckdb
import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from factloom.llm import queries

TABLES = "documents pages embeddings benchmark conversations".split()


def test_one_query_for_each_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14)) and "pipeline" in entry_point.queries()
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) <= set(entry_point.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_in_second_engine(spark, sf_dir, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, sf_dir), duck.sql(queries.ORACLE_SQL[name])
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())


def plain_text(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def test_pipeline_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, sf_dir).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        was, now = before.collect(), after.collect()
        if name != "sentencepiece":
            assert after.columns == docs.columns
            assert {tuple(r) for r in now} <= {tuple(r) for r in was}
        if name == "language_id":
            assert len(now) >= 0.98 * len(was)
        if name == "exact_dedup":
            assert len(now) == len({plain_text(r.text) for r in was})
        if name == "near_dedup":
            left = {r.doc_id for r in now}
            words = {r.doc_id: r.text.lower().split() for r in was}
            sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, w in words.items()}
            gone = [r.doc_id for r in was if r.doc_id not in left]
            assert len(gone) < 0.1 * len(was)
            for k in gone:  # each has a near copy in the table
                assert max(len(sets[k] & s) / len(sets[k] | s) for j, s in sets.items() if j != k) > 0.5
            high = [(a, b) for a in left for b in left if a < b and len(sets[a] & sets[b]) > 0.9 * len(sets[a] | sets[b])]
            assert not high
        if name == "mixing":
            copies = {}
            for r in now:
                copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
            assert max(copies.values()) <= 3
        if name == "sentencepiece":
            assert sorted(r.doc_id for r in now) == sorted(r.doc_id for r in was)
        before = after


def test_pipeline_of_messy_and_no_rows(spark, messy, none):
    for start in (messy, none):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stored(stage(spark, docs, ""), name)
        assert docs.columns[:2] == ["doc_id", "n_tokens"]
        assert (docs.count() > 0) == (start is messy)


@pytest.mark.parametrize("stage", [corpus_pipeline.exact_dedup, corpus_pipeline.near_dedup, corpus_pipeline.mixing])
def test_rows_stay_the_same_when_the_input_is_split_anew(spark, tmp_path, stage):
    texts = [" ".join(f"w{k * 100 + i}" for i in range(60)) for k in range(40)] * 2
    rows = [(i, t, "ab"[i % 2]) for i, t in enumerate(texts)]
    path = f"{tmp_path}/docs"
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8).write.parquet(path)
    docs = spark.read.parquet(path)
    want = sorted(map(tuple, stage(spark, docs, "").collect()))
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "2k")
        later = stage(spark, docs, "")
        spark.conf.set(name, "1g")
        assert sorted(map(tuple, later.collect())) == want
    finally:
        spark.conf.set(name, before)
