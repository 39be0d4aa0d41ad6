"""The tier cascade: stored verdict, else fact-check, else evidence."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ratio
from ..session import stored
from .cache import outcome_ttl
from .matching import is_reliable, percent_text

RESULT = ["claim_id", "claim_hash", "normalized", "verdict", "confidence", "explanation", "source_tier", "cached", "outcome"]


def fact_check_outcome(misses: DataFrame, matches: DataFrame | None, provider_ok: str = "provider_ok") -> DataFrame:
    """Tier-2 result per claim: reliable match, unreliable or no match, provider error or disabled."""
    if matches is None:
        return misses.select(
            "*", F.lit("UNVERIFIED").alias("verdict"), F.lit(0.0).alias("confidence"),
            F.lit("Fact-check service disabled").alias("explanation"), F.lit("DISABLED").alias("outcome"),
        )
    m = matches.select(
        "match_key", "match_type", "total", F.col("verdict").alias("m_verdict"),
        F.col("confidence").alias("m_confidence"), F.col("explanation").alias("m_explanation"),
    )
    df = misses.join(m, "match_key", "left")
    ok = F.col(provider_ok) if provider_ok in misses.columns else F.lit(True)
    good = F.coalesce(is_reliable(F.col("match_type")), F.lit(False))
    weak = F.concat(
        F.lit("Found fact-checks but none reliably match (best: "), "match_type", F.lit(", "),
        percent_text(F.col("total")), F.lit("% confidence)"),
    )
    outcome = (
        F.when(~ok, "ERROR").when(good, "MATCH").when(F.col("match_type").isNotNull(), "UNRELIABLE").otherwise("NO_MATCH")
    )
    return df.withColumn("outcome", outcome).select(
        *misses.columns, "outcome",
        F.when(F.col("outcome") == "MATCH", F.col("m_verdict")).otherwise("UNVERIFIED").alias("verdict"),
        F.when(F.col("outcome") == "MATCH", F.col("m_confidence")).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(F.col("outcome") == "MATCH", F.col("m_explanation"))
        .when(F.col("outcome") == "UNRELIABLE", weak)
        .when(F.col("outcome") == "ERROR", "Fact-check API error")
        .otherwise("No fact-checks found matching this claim").alias("explanation"),
    )


def verify(
    claims: DataFrame,
    cache: DataFrame | None = None,
    matches: DataFrame | None = None,
    model_verdicts: DataFrame | None = None,
    as_of=None,
) -> DataFrame:
    """One verdict row per claim.  A tier given as None is switched off.

    ``claims``: claim_id, claim_hash, normalized, match_key (and optionally provider_ok).
    ``cache``: claim_hash, verdict, confidence, explanation, source_tier, expires_at.
    ``matches``: one rated match per match_key.  ``model_verdicts``: one verdict per claim_id.
    A stored verdict keeps the tier that produced it.  Tier 3 only sees claims that
    tier 2 left UNVERIFIED with confidence 0.
    """
    parts = []
    misses = claims
    if cache is not None:
        live = cache.filter(F.col("expires_at") >= as_of)
        hits = claims.join(live.select("claim_hash", "verdict", "confidence", "explanation", "source_tier"), "claim_hash")
        parts.append(hits.select(*RESULT[:7], F.lit(True).alias("cached"), F.lit("HIT").alias("outcome")))
        misses = claims.join(live.select("claim_hash"), "claim_hash", "left_anti")
    checked = fact_check_outcome(misses, matches).withColumn("source_tier", F.lit("FACT_CHECK_API")).withColumn("cached", F.lit(False))
    if model_verdicts is not None:
        m = model_verdicts.select(
            "claim_id", F.col("verdict").alias("t3_verdict"), F.col("confidence").alias("t3_confidence"),
            F.col("explanation").alias("t3_explanation"),
        )
        need = (F.col("verdict") == "UNVERIFIED") & (F.col("confidence") == 0)
        joined = checked.join(m, "claim_id", "left")
        use = need & F.col("t3_verdict").isNotNull()
        checked = joined.withColumn("_use", use).select(
            *[c for c in checked.columns if c not in ("verdict", "confidence", "explanation", "source_tier", "outcome")],
            *[
                F.when(F.col("_use"), F.col(new)).otherwise(F.col(old)).alias(old)
                for old, new in (("verdict", "t3_verdict"), ("confidence", "t3_confidence"), ("explanation", "t3_explanation"))
            ],
            F.when(F.col("_use"), "AI_RAG").otherwise(F.col("source_tier")).alias("source_tier"),
            F.when(F.col("_use"), "MODEL").otherwise(F.col("outcome")).alias("outcome"),
        )
    parts.append(checked.select(*RESULT))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def to_cache_rows(results: DataFrame) -> DataFrame:
    """Rows worth storing with their lifetime; stored hits and errors are left out."""
    fresh = results.filter(~F.col("cached")).withColumn("ttl", outcome_ttl(F.col("outcome")))
    return fresh.filter(F.col("ttl").isNotNull())


SOURCE = "array<struct<title:string,url:string,publisher:string,publish_date:string,reliability:double>>"


def _sources(df: DataFrame) -> Column:
    """The ``sources`` of a table as result sources; none where the table has no such column."""
    return F.coalesce(F.col("sources"), F.array().cast(SOURCE)).cast(SOURCE) if "sources" in df.columns else F.array().cast(SOURCE)


def verify_in_stages(
    claims: DataFrame,
    cache: DataFrame | None,
    search: Callable[[DataFrame], DataFrame] | None,
    answer: Callable[[DataFrame], DataFrame] | None,
    as_of: Column,
) -> DataFrame:
    """One verdict row per claim, with its sources and time; a tier given as None is switched off.

    Every stage stores what is still open, and the next tier sees only that: ``search``
    gets the claims without a live stored verdict and returns rated matches, one per
    match_key; ``answer`` gets the claims that search left UNVERIFIED with confidence 0 and
    returns claim_id, verdict, confidence, explanation and, if it has them, sources.  Both
    may therefore cost much per claim.  ``claims``: claim_id, claim_hash, normalized,
    match_key, anything else that the tiers need, and optionally provider_ok.
    """
    columns = [*RESULT, "sources", "verified_at"]
    done = []
    misses = claims
    if cache is not None:
        live = cache.filter(F.col("expires_at") >= as_of)
        live = live.select("claim_hash", "verdict", "confidence", "explanation", "source_tier", _sources(live).alias("sources"))
        hits = claims.select("claim_id", "claim_hash", "normalized").join(live, "claim_hash")
        done.append(hits.select("*", F.lit(True).alias("cached"), F.lit("HIT").alias("outcome")))
        misses = stored(claims.join(live.select("claim_hash"), "claim_hash", "left_anti"), "misses")
    matches = None if search is None else stored(search(misses), "matches")
    checked = fact_check_outcome(misses, matches)
    if matches is not None:
        checked = checked.join(matches.select("match_key", _sources(matches).alias("_sources")), "match_key", "left")
    found = F.when(F.col("outcome") == "MATCH", F.col("_sources")) if matches is not None else F.lit(None).cast(SOURCE)
    checked = checked.withColumn("sources", F.coalesce(found, F.array().cast(SOURCE))).withColumn("source_tier", F.lit("FACT_CHECK_API"))
    checked = stored(checked.withColumn("cached", F.lit(False)).drop("_sources"), "checked")
    if answer is not None:
        unsure = (F.col("verdict") == "UNVERIFIED") & (F.col("confidence") == 0)
        still_open = stored(checked.filter(unsure).select(*claims.columns), "open")
        answers = answer(still_open)
        answers = stored(answers.select("claim_id", "verdict", "confidence", "explanation", _sources(answers).alias("sources")), "answers")
        told = still_open.select("claim_id", "claim_hash", "normalized").join(answers, "claim_id")
        done.append(told.select("*", F.lit("AI_RAG").alias("source_tier"), F.lit(False).alias("cached"), F.lit("MODEL").alias("outcome")))
        checked = checked.join(answers.select("claim_id"), "claim_id", "left_anti")
    done.append(checked)
    result = None
    for part in done:
        rows = part.withColumn("verified_at", as_of).select(*columns)
        result = rows if result is None else result.unionByName(rows)
    return result


#: tiers of a configuration: which of them it may use
TIERS = ("cache", "fact_check", "model")


def tier_outcomes(claims: DataFrame, cache: DataFrame, matches: DataFrame, model_verdicts: DataFrame, as_of: Column) -> DataFrame:
    """One wide row per claim with what each tier would say: ``claim_id, cache, fact_check, model``.

    Each is ``struct<verdict, confidence, outcome>``, null where the tier has nothing.  Every
    table is read once, whatever the number of configurations compared on the result.
    """
    live = cache.filter(F.col("expires_at") >= as_of)
    tier = lambda outcome: F.struct("verdict", "confidence", outcome.alias("outcome"))
    checked = fact_check_outcome(claims, matches).select("claim_id", "claim_hash", tier(F.col("outcome")).alias("fact_check"))
    return (
        checked.join(live.select("claim_hash", tier(F.lit("HIT")).alias("cache")), "claim_hash", "left")
        .join(model_verdicts.select("claim_id", tier(F.lit("MODEL")).alias("model")), "claim_id", "left")
        .select("claim_id", "cache", "fact_check", "model")
    )


def configured(use: Iterable[str]) -> Column:
    """The verdict of a configuration over a row of :func:`tier_outcomes`."""
    use = set(use)
    if not use <= set(TIERS):
        raise ValueError(f"unknown tiers: {sorted(use - set(TIERS))}")
    none = F.struct(F.lit("UNVERIFIED").alias("verdict"), F.lit(0.0).alias("confidence"), F.lit("DISABLED").alias("outcome"))
    checked = F.col("fact_check") if "fact_check" in use else none
    if "model" in use:
        unsure = (checked["verdict"] == "UNVERIFIED") & (checked["confidence"] == 0)
        checked = F.when(unsure & F.col("model").isNotNull(), F.col("model")).otherwise(checked)
    return F.coalesce(F.col("cache"), checked) if "cache" in use else checked


def ablation(outcomes: DataFrame, configs: dict[str, Iterable[str]]) -> DataFrame:
    """``claim_id, config, verdict, confidence, outcome`` of every configuration, from one pass over the wide rows."""
    each = F.array(*[F.struct(F.lit(name).alias("config"), configured(use).alias("r")) for name, use in configs.items()])
    return outcomes.select("claim_id", F.explode(each).alias("c")).select("claim_id", "c.config", "c.r.verdict", "c.r.confidence", "c.r.outcome")


def ablation_metrics(runs: DataFrame, truth: DataFrame) -> DataFrame:
    """Metrics of each configuration against ``truth`` (claim_id, truth); claims without truth count for the rates only.

    ``decided`` are verdicts other than UNVERIFIED; ``searches`` and ``model_calls`` are the
    claims that needed those tiers.
    """
    joined = runs.join(truth, "claim_id", "left")
    right, decided = F.col("verdict") == F.col("truth"), F.col("verdict") != "UNVERIFIED"
    known = F.col("truth").isNotNull()
    return joined.groupBy("config").agg(
        F.count(F.lit(1)).alias("claims"), F.count_if(decided).alias("decided"), F.count_if(known).alias("judged"),
        ratio(F.count_if(known & right), F.count_if(known)).alias("accuracy"),
        ratio(F.count_if(known & right & decided), F.count_if(known & decided)).alias("precision"),
        ratio(F.count_if(decided), F.count(F.lit(1))).alias("coverage"),
        F.count_if(F.col("outcome") == "HIT").alias("hits"),
        F.count_if(~F.col("outcome").isin("HIT", "DISABLED")).alias("searches"),
        F.count_if(F.col("outcome") == "MODEL").alias("model_calls"),
    )
