import pytest
from pyspark.sql import functions as F

from factloom.operators import cascade as cs
from factloom.operators import evidence as ev
from factloom.operators import matching as mt
from factloom.operators import normalize as nm
from factloom.operators import retrieval as rt

def now():
    return F.lit("2024-01-01").cast("timestamp")


SOURCES = "array<struct<title:string,url:string,publisher:string,publish_date:string,reliability:double>>"


@pytest.fixture
def tables(spark):
    claims = spark.createDataFrame(
        [(i, f"h{i}", "n", f"k{i}", i != 5) for i in range(6)], "claim_id long, claim_hash string, normalized string, match_key string, provider_ok boolean"
    )
    cache = spark.createDataFrame(
        [("h0", "FALSE", 0.9, "e", "AI_RAG", "2024-01-02", [("t", "u", "p", "d", 0.5)]), ("h1", "FALSE", 0.9, "e", "AI_RAG", "2023-01-01", [])],
        f"claim_hash string, verdict string, confidence double, explanation string, source_tier string, expires_at string, sources {SOURCES}",
    ).withColumn("expires_at", F.col("expires_at").cast("timestamp"))
    matches = spark.createDataFrame(
        [("k0", "EXACT", 1.0, "FALSE", 0.9, "m", [("t", "a", "p", "d", 0.5)]), ("k1", "HIGH_CONFIDENCE", 0.9, "SUPPORTED", 0.8, "m", [("t", "b", "p", "d", 0.5)]),
         ("k2", "LOW_CONFIDENCE", 0.7, "FALSE", 0.4, "m", [("t", "c", "p", "d", 0.5)])],
        f"match_key string, match_type string, total double, verdict string, confidence double, explanation string, sources {SOURCES}",
    )
    model = spark.createDataFrame([(i, "MISLEADING", 0.5, "x") for i in (0, 1, 3)], "claim_id long, verdict string, confidence double, explanation string")
    return claims, cache, matches, model


def test_tiers_see_only_what_is_open(tables):
    claims, cache, matches, model = tables
    seen = {}

    def search(misses):
        seen["search"] = sorted(r.claim_id for r in misses.collect())
        return matches

    def answer(still_open):
        seen["answer"] = sorted(r.claim_id for r in still_open.collect())
        return model.join(still_open.select("claim_id"), "claim_id", "left_semi")

    got = {r.claim_id: r for r in cs.verify_in_stages(claims, cache, search, answer, now()).collect()}
    assert seen == {"search": [1, 2, 3, 4, 5], "answer": [2, 3, 4, 5]}
    assert {k: (r.outcome, r.verdict, r.cached, [s.url for s in r.sources]) for k, r in got.items()} == {
        0: ("HIT", "FALSE", True, ["u"]), 1: ("MATCH", "SUPPORTED", False, ["b"]), 2: ("UNRELIABLE", "UNVERIFIED", False, []),
        3: ("MODEL", "MISLEADING", False, []), 4: ("NO_MATCH", "UNVERIFIED", False, []), 5: ("ERROR", "UNVERIFIED", False, []),
    }
    assert len({r.verified_at for r in got.values()}) == 1 and got[0].verified_at.year == 2024
    assert got[0].source_tier == "AI_RAG" and got[3].source_tier == "AI_RAG"


def test_tiers_switched_off(tables):
    claims, cache, matches, _ = tables
    assert {r.outcome for r in cs.verify_in_stages(claims, None, None, None, now()).collect()} == {"DISABLED"}
    got = cs.verify_in_stages(claims, None, lambda misses: matches, None, now()).collect()
    assert {r.claim_id: r.outcome for r in got}[0] == "MATCH"
    assert cs.verify_in_stages(claims.filter("false"), cache, lambda m: matches, None, now()).collect() == []


def test_configurations_of_one_pass_equal_single_runs(tables):
    claims, cache, matches, model = tables
    wide = cs.tier_outcomes(claims, cache, matches, model, now())
    configs = {"full": cs.TIERS, "no_model": ("cache", "fact_check"), "no_cache": ("fact_check", "model"), "none": ()}
    got = {(r.config, r.claim_id): (r.verdict, r.outcome) for r in cs.ablation(wide, configs).collect()}
    single = {
        "full": dict(cache=cache, matches=matches, model_verdicts=model), "no_model": dict(cache=cache, matches=matches), "no_cache": dict(matches=matches, model_verdicts=model), "none": {},
    }
    for name, tiers in single.items():
        for r in cs.verify(claims, as_of=now(), **tiers).collect():
            assert got[name, r.claim_id] == (r.verdict, r.outcome), (name, r)
    truth = claims.sparkSession.createDataFrame([(0, "FALSE"), (1, "SUPPORTED"), (3, "FALSE")], "claim_id long, truth string")
    m = {r.config: r for r in cs.ablation_metrics(cs.ablation(wide, configs), truth).collect()}
    assert (m["full"].claims, m["full"].judged, m["full"].decided, m["full"].hits, m["full"].model_calls) == (6, 3, 3, 1, 1)
    assert m["full"].accuracy == m["full"].precision == 2 / 3 and m["none"].coverage == 0.0 and m["none"].precision is None
    with pytest.raises(ValueError):
        cs.configured(["cash"])


def test_from_claim_to_verdict(spark):
    """One claim is stored, one has a fact-check, one needs evidence, one has none; the model sees only what has evidence."""
    texts = ["Old bridge opened in Veltra", "NASA confirms Moon water today", "Veltra river water is unsafe", "zzqx qqzz"]
    claims = spark.createDataFrame(list(enumerate(texts)), "claim_id long, claim string")
    keyed = mt.with_match_key(nm.claim_identity(claims))
    first = keyed.filter("claim_id = 0").select("claim_hash").first()[0]
    cache = spark.createDataFrame([(first, "FALSE", 0.9, "e", "AI_RAG")], "claim_hash string, verdict string, confidence double, explanation string, source_tier string")
    cache = cache.withColumn("expires_at", F.lit("2025-01-01").cast("timestamp"))
    checks = spark.createDataFrame(
        [(1, "NASA confirms Moon water today", None, None, ("P", None), (None, "https://p.org/1", "2024-01-01", "True")), (2, "Other words entirely", None, None, ("P", None), (None, "https://p.org/2", "2024-01-01", "False"))],
        "fc_id long, claim_text string, claimant string, claim_date string, publisher struct<name:string,site:string>, review struct<title:string,url:string,review_date:string,textual_rating:string>",
    )
    body = "The Veltra river water is unsafe, a report confirmed, and the study shows that water is unsafe in Veltra.\n" * 4
    pages = spark.createDataFrame(
        [(1, "https://a.org/x", "T", None, body), (2, "https://b.org/y", "T", None, body.replace("unsafe", "unsafe now")), (3, "https://c.org/z", "T", None, "unrelated text " * 40)],
        "page_id long, url string, title string, published_at timestamp, text string",
    )
    asked = []

    def model(prompts, context):
        asked.extend(r.claim_id for r in prompts.collect())
        assert all("EVIDENCE id=E1" in r.context for r in prompts.collect())
        return prompts.select("claim_id", F.lit('{"verdict": "SUPPORTED", "confidence": 0.9, "summary": "Agreed.", "reasoning": "They agree.", "supporting_evidence": ["E1"], "contradicting_evidence": [], "contextual_evidence": []}').alias("raw"))

    got = {r.claim_id: r for r in rt.check_claims(keyed, cache, checks, pages, model, now(), "2024-01-01 00:00:00", chunks=ev.line_chunks).collect()}
    assert {k: r.outcome for k, r in got.items()} == {0: "HIT", 1: "MATCH", 2: "MODEL", 3: "MODEL"}
    assert asked == [2] and len(got[2].sources) > 0 and got[2].verdict in ("SUPPORTED", "UNVERIFIED")
    assert got[3].verdict == "UNVERIFIED" and got[3].confidence == 0 and list(got[3].sources) == []
    assert got[1].sources[0].url == "https://p.org/1"
