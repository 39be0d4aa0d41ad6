import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.functions.udfs import jaro_winkler_batch
from factloom.operators import matching as mt
from factloom.operators import normalize as nm
from factloom.operators import ratings as rt
from factloom.operators.simjoin import distinct_sets, similar_sets


def plain_jaro_winkler(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    window = max(len(a), len(b)) // 2 - 1
    if window < 0:
        return 0.0
    used, left = set(), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - window), min(len(b), i + window + 1)):
            if j not in used and b[j] == ch:
                used.add(j)
                left.append(ch)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [b[j] for j in sorted(used)]
    t = sum(x != y for x, y in zip(left, right)) / 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def test_jaro_winkler_differential():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    a, b = pd.Series(words), pd.Series(words[1:] + words[:1])
    got = jaro_winkler_batch(a, b)
    for x, y, g in zip(a, b, got):
        assert g == pytest.approx(plain_jaro_winkler(x, y), abs=1e-12)
        assert 0.0 <= g <= 1.0


def test_similar_sets_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["the"] * 30 + [f"w{i}" for i in range(40)]
    sets = [sorted({rng.choice(vocabulary) for _ in range(rng.randint(1, 9))}) for _ in range(150)]
    sets += [["the", "w1", "w2"]] * 60
    df = spark.createDataFrame([(s,) for s in sets], "words array<string>")
    for t in (0.5, 0.85):
        ids = distinct_sets(df, "words")
        names = {r.set_id: frozenset(r.tokens) for r in ids.collect()}
        got = {frozenset((names[r.left_set], names[r.right_set])) for r in similar_sets(ids, None, t).collect()}
        unique = list(set(names.values()))
        want = {
            frozenset((a, b)) for i, a in enumerate(unique) for b in unique[:i] if len(a & b) / len(a | b) >= t
        }
        assert got == want


def _fact_checks(spark, texts, rating="False"):
    rows = [(i, t, None, None, ("P", None), (None, f"https://p.org/{i}", "2024-01-01", rating)) for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows,
        "fc_id long, claim_text string, claimant string, claim_date string, publisher struct<name:string,site:string>, "
        "review struct<title:string,url:string,review_date:string,textual_rating:string>",
    )


def _match(spark, claim, texts):
    keyed = mt.with_match_key(nm.claim_identity(spark.createDataFrame([(1, claim)], "claim_id long, claim string")))
    return mt.match_fact_checks(keyed, _fact_checks(spark, texts), min_overlap=0.2).collect()


def test_best_match_cases(spark):
    assert _match(spark, "vaccines cause autism", []) == []
    same = _match(spark, "vaccines cause autism in children", ["vaccines cause autism in children"])
    assert same[0].match_type in ("HIGH_CONFIDENCE", "EXACT") and same[0].total > 0.8
    assert _match(spark, "vaccines do not cause autism", ["vaccines do cause autism"]) == []
    assert _match(spark, "vaccine is 95% effective today", ["vaccine is 50% effective today"]) == []
    assert _match(spark, "NASA confirms darkness soon", ["ESA confirms darkness soon"]) == []
    best = _match(spark, "earth is round and big", ["earth is flat and big", "earth is round and big", "the earth is round and so big"])
    assert best[0].fc_id == 1
    assert _match(spark, "bananas are yellow fruit", ["stock markets fell sharply"]) == []


def test_copies_are_capped_exactly(spark):
    """A third of the table being one text changes nothing: the lowest ids win."""
    texts = ["earth is round and big"] * 50 + [f"other text number{i} entirely" for i in range(100)]
    keyed = mt.with_match_key(nm.claim_identity(spark.createDataFrame([(1, "Earth is round and big")], "claim_id long, claim string")))
    found = mt.fact_check_candidates(mt.distinct_claims(keyed), _fact_checks(spark, texts)).collect()
    assert sorted(r.fc_id for r in found) == list(range(10))


RATINGS = [
    ("True", "SUPPORTED"), ("Correct", "SUPPORTED"), ("Geppetto Checkmark", "SUPPORTED"), ("valid", "SUPPORTED"),
    ("False", "FALSE"), ("Pants on Fire!", "FALSE"), ("Four Pinocchios", "FALSE"), ("Completely false", "FALSE"),
    ("Half True", "MISLEADING"), ("Mostly True", "MISLEADING"), ("Mostly false", "MISLEADING"), ("Missing Context", "MISLEADING"),
    ("Unproven", "UNVERIFIED"), ("Satire", "UNVERIFIED"), ("One Pinocchio", "UNVERIFIED"), ("gibberish", "UNVERIFIED"),
]


def test_ratings(spark):
    df = spark.createDataFrame(RATINGS, "rating string, want string")
    for r in rt.rate(df, F.col("rating")).collect():
        assert r.rated_verdict == r.want
        assert r.rated_confidence == (0.3 if r.rating == "gibberish" else r.rated_confidence)


def test_confidence_order_and_safeguards(spark):
    rows = [("EXACT", 1.0, 1.0, 1.0), ("HIGH_CONFIDENCE", 0.9, 1.0, 1.0), ("LOW_CONFIDENCE", 0.7, 1.0, 1.0), ("EXACT", 1.0, 0.0, 1.0), ("EXACT", 1.0, 1.0, 0.0)]
    df = spark.createDataFrame(
        [(i, *r, ("P",), ("https://p.org", "False")) for i, r in enumerate(rows)],
        "i int, match_type string, total double, negation double, number double, publisher struct<name:string>, review struct<url:string,textual_rating:string>",
    )
    got = {r.i: r for r in rt.combine(rt.rate(df, F.col("review.textual_rating"))).collect()}
    assert got[0].confidence > got[1].confidence > got[2].confidence
    assert all(got[i].verdict == "UNVERIFIED" and got[i].confidence == 0.1 for i in (3, 4))
