import random
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from factloom.functions.text import one_digit
from factloom.functions.udfs import main_text, page_text_udf
from factloom.operators import simjoin, wordindex


def test_one_digit_rounds_the_exact_value(spark):
    """F8: as Python's ``.1f``, which reads 0.85 as 0.84999..."""
    rng = random.Random(8)
    values = [0.0, 1.0, 0.25, 0.75, 0.05, 0.15, 0.35, 0.65, 0.85, 0.95, 0.6, 0.7, 0.8, 0.9, 0.7999999999999999, 0.30000000000000004]
    values += [rng.random() for _ in range(2000)] + [k / 1000 for k in range(1001)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", one_digit(F.col("v")).alias("got")).collect():
        assert r.got == f"{r.v:.1f}"


def _planted(spark):
    """Groups whose members are linked to each other, among texts that share common words only."""
    rng = random.Random(11)
    common = [f"the{i}" for i in range(300)]
    rows = []
    for g in range(12):
        base = rng.sample(common, 40) + [f"g{g}w{i}" for i in range(20)]
        rows += [base[:i] + base[i + 1 + i % 4 :] for i in range(6)] + [base]
    rows += [rng.sample(common, 60) for _ in range(200)]
    return [(i, w) for i, w in enumerate(rows)]


def test_sketches_lose_no_similar_pair(spark):
    """most candidates go before their tokens are sent, none that qualifies does."""
    rows = _planted(spark)
    sets = simjoin.distinct_sets(spark.createDataFrame(rows, "id long, words array<string>"), "words").cache()
    pairs = sets.select(F.col("set_id").alias("a")).crossJoin(sets.select(F.col("set_id").alias("b"))).filter("a < b")
    sketches = simjoin._sketches(sets)
    close = {(r.a, r.b) for r in simjoin._close(pairs, sketches, sketches, 0.85).collect()}
    words = {r.set_id: set(r.tokens) for r in sets.collect()}
    near = {(a, b) for a in words for b in words if a < b and len(words[a] & words[b]) >= 0.85 * len(words[a] | words[b])}
    assert near and near <= close and len(close) < pairs.count() / 20
    sets.unpersist()


def test_near_dup_pairs_lists_links_between_members(spark, tmp_path):
    """a link between two members that are not the smallest of their group."""
    rows = [(i, " ".join(w)) for i, w in _planted(spark)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.left_doc, r.right_doc): r.similarity for r in entry_point.queries()["near_dup_pairs"](spark, str(tmp_path)).collect()}
    words = {}
    for i, text in rows:
        words.setdefault(frozenset(text.split()), i)
    one = sorted((i, w) for w, i in words.items())
    want = {(i, j): len(a & b) / len(a | b) for i, a in one for j, b in one if i < j and len(a & b) / len(a | b) >= 0.85}
    assert got == {k: round(v, 6) for k, v in want.items()} and (1, 2) in got


def test_later_looks_write_only_sets_that_can_win(spark, monkeypatch):
    """F14 to F31: hits below the best score known are dropped before they are written; sets go by number."""
    written = []

    def counting(df, path, real=wordindex._kept):
        out = real(df, path)
        if path.endswith("/found"):
            written.append(out.count())
        return out

    monkeypatch.setattr(wordindex, "_kept", counting)
    monkeypatch.setattr(wordindex, "FIRST_LOOK", 30)
    rows = [(i, [f"rare{i // 4}", "common", f"mid{i % 9}"]) for i in range(900)] + [(900, ["a\nb", "common"])]
    index = wordindex.build_index(spark.createDataFrame(rows, "id long, words array<string>"), "id", F.col("words"))
    assert dict(index.postings.dtypes)["set_no"] == "bigint" and "set_id" not in index.postings.columns
    assert index.sets.select("set_no").distinct().count() == index.sets.count() == 901
    assert index.sets.filter(F.array_contains("words", "a\nb")).count() == 1
    queries = spark.createDataFrame([("q", ["rare7", "mid1", "mid2", "mid3", "common"])], "query string, words array<string>")
    best = wordindex.best_members(index, wordindex.best_sets(index, queries, 3), 3).collect()
    assert [r.id for r in sorted(best, key=lambda r: r.rank)] == [28, 29, 30]
    assert len(written) == 2 and written[1] < 10


def test_pages_are_read_a_few_at_a_time():
    """a batch is never held as Python strings, neither its pages nor its texts."""
    html = "<html><body><main>" + "<p>some words of a page, é</p>" * 400 + "</main></body></html>"
    pages = pa.array([html + f"<!-- {i} -->" for i in range(600)] + [None, ""])
    extract = page_text_udf(200, 50000).func
    tracemalloc.start()
    got = extract(pages)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[0].as_py() == main_text(html, 200, 50000) and got[600].as_py() is None and len(got) == 602
    assert peak < pages.nbytes / 4  # a batch's texts alone are as long as its pages
