import math
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import matching as mt
from factloom.operators import normalize as nm
from factloom.operators import wordindex as wi


def plain_best(rows, queries, k):
    """Every row scored for every query; rows are (id, words)."""
    sets = {frozenset(w) for _, w in rows if w}
    uses = {t: sum(t in s for s in sets) for s in sets for t in s}
    weight = {t: max(1, math.floor(math.log(len(sets) / n) * 1000)) for t, n in uses.items()}
    out = {}
    for name, words in queries:
        words = set(words)
        found = []
        for i, w in set((i, frozenset(w)) for i, w in rows):
            both = words & w
            if both:
                found.append((-sum(weight[t] for t in both), -len(both) / (len(words) + len(w) - len(both)), i))
        out[name] = [(r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found)[:k])]
    return out


def search(index, queries, k):
    got = {}
    best = wi.best_sets(index, queries, k)
    for r in wi.best_members(index, best, k).collect():
        got.setdefault(r.query, []).append((r.rank, r.id, r.score))
    return {q: sorted(rows) for q, rows in got.items()}


def corpus(rng, n):
    words = [f"w{i}" for i in range(80)]
    odds = [1 / (i + 1) for i in range(80)]
    rows = [(i, sorted(set(rng.choices(words, odds, k=rng.randrange(1, 9))))) for i in range(n)]
    return rows + [(n + i, ["w0", "w1"]) for i in range(n // 3)] + [(2 * n, [])]


@pytest.mark.parametrize("look", [1, 40, 10_000])
def test_best_sets_against_brute_force(spark, monkeypatch, look):
    """One, several or no further looks; a third of the rows are one set."""
    monkeypatch.setattr(wi, "FIRST_LOOK", look)
    rng = random.Random(look)
    rows = corpus(rng, 300)
    queries = [(f"q{i}", list(set(rng.choices([f"w{j}" for j in range(90)], k=rng.randrange(1, 8))))) for i in range(25)] + [("none", ["absent"]), ("common", ["w0"])]
    index = wi.build_index(spark.createDataFrame(rows, "id long, words array<string>"), "id", F.col("words"))
    got = search(index, spark.createDataFrame(queries, "query string, words array<string>"), 5)
    want = {q: r for q, r in plain_best(rows, queries, 5).items() if r}
    assert got == want


def test_appended_batches(spark):
    rng = random.Random(9)
    rows, more = corpus(rng, 120), [(1000 + i, w) for i, w in corpus(rng, 60)]
    schema = "id long, words array<string>"
    index = wi.build_index(spark.createDataFrame(rows, schema), "id", F.col("words"))
    for _ in range(2):  # a batch that is repeated replaces itself
        index = wi.append(index, spark.createDataFrame(more, schema), "id", F.col("words"), 1)
    queries = [(f"q{i}", [f"w{i}", f"w{2 * i}", "w0"]) for i in range(12)]
    got = search(index, spark.createDataFrame(queries, "query string, words array<string>"), 4)
    assert got == {q: r for q, r in plain_best(rows + more, queries, 4).items() if r}


def test_empty_index_and_no_queries(spark):
    schema = "id long, words array<string>"
    queries = spark.createDataFrame([("q", ["a"])], "query string, words array<string>")
    empty = wi.build_index(spark.createDataFrame([], schema), "id", F.col("words"))
    assert search(empty, queries, 3) == {}
    index = wi.build_index(spark.createDataFrame([(1, ["a"]), (2, ["b"])], schema), "id", F.col("words"))
    assert search(index, queries.filter("false"), 3) == {}
    assert search(index, queries, 3) == {"q": [(1, 1, 693)]}


def test_distant_paraphrase_is_found(spark):
    """Word Jaccard of 0.2: no floor hides the only fact-check there is."""
    claim = "the old lighthouse of Brakmar burned down after lightning struck during storms"
    texts = ["Brakmar lighthouse destroyed by fire says coastguard report", "stock markets fell sharply today", "rain is wet everywhere"]
    keyed = mt.with_match_key(nm.claim_identity(spark.createDataFrame([(1, claim)], "claim_id long, claim string")))
    checks = spark.createDataFrame(list(enumerate(texts)), "fc_id long, claim_text string")
    found = mt.fact_check_candidates(mt.distinct_claims(keyed), checks).collect()
    assert [r.fc_id for r in found] == [0] and found[0].overlap < 0.3
    assert mt.fact_check_candidates(mt.distinct_claims(keyed), checks, min_overlap=0.5).collect() == []


def test_probe_reads_no_text_again(spark):
    checks = spark.createDataFrame([(1, "earth is round and big")], "fc_id long, claim_text string")
    index = mt.index_fact_checks(checks)
    keyed = mt.with_match_key(nm.claim_identity(spark.createDataFrame([(1, "Earth is round")], "claim_id long, claim string")))
    assert mt.fact_check_candidates(mt.distinct_claims(keyed), None, index=index).collect()[0].fc_id == 1
