from pyspark.sql import functions as F

from factloom.llm import simhash


def _rows(spark, n):
    name = F.struct(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("key"))
    return spark.range(n).select(name.alias("id"), F.concat(F.lit("text "), "id").alias("text"))


def test_no_row_that_is_asked_for_is_missed_and_few_others_come(spark, monkeypatch):
    rows = _rows(spark, 20_000)
    wanted = rows.filter("id.doc_id % 10 = 3")
    got = {r.doc_id for r in simhash.among(rows, wanted.select("id")).select("id.doc_id").collect()}
    assert set(range(3, 20_000, 10)) <= got and len(got) < 2000 * 2
    monkeypatch.setattr(simhash, "FILTER_PIECES", 1)  # a full filter still misses none
    assert {r.doc_id for r in simhash.among(rows, wanted.select("id")).select("id.doc_id").collect()} >= set(range(3, 20_000, 10))
    assert simhash.among(rows, wanted.filter("false").select("id")).count() == 0


def test_texts_are_not_sent_to_find_those_that_are_compared(spark, monkeypatch):
    """pipeline: beyond the broadcast threshold the texts of all rows were dealt by id."""
    plans = []

    def seen(texts, words, real=simhash.shingle_sets):
        plans.append(texts._jdf.queryExecution().executedPlan().toString())
        return real(texts, words)

    monkeypatch.setattr(simhash, "shingle_sets", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64")
    try:
        texts = [(i, " ".join(f"w{i // 2}x{j}" for j in range(60)) + f" own{i % 2}") for i in range(40)]
        docs = spark.createDataFrame(texts, "id long, text string")
        got = {r.id: r.component_id for r in simhash.similar_groups(docs, 5, 0.8, id_col="id").collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {i: i - i % 2 for i in range(40)}
    assert plans and not any("SortMergeJoin" in p for p in plans)
