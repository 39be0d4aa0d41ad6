"""From open claims to checked verdicts: search, sources, passages, ranking, context, model, validation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import analyze, cascade, evidence, grounding, matching, ranking, ratings, sources
from .wordindex import WordIndex


@dataclass(frozen=True)
class Retrieved:
    """``packages``: one row per claim with evidence, counts and status. ``context``: the items shown to the model."""

    packages: DataFrame
    context: DataFrame


def retrieve(
    claims: DataFrame, pages: DataFrame, as_of: str, index: WordIndex | None = None,
    chunks: Callable[[DataFrame], DataFrame] = evidence.chunk_pages, min_words: int = 50,
) -> Retrieved:
    """Evidence for claims (claim_id, claim) from pages (page_id, url, title, published_at, text)."""
    queries = analyze.generate_queries(analyze.analyze_claims(claims))
    found = sources.search_pages(queries, pages, index=index).join(pages.drop("text"), "page_id")
    chosen = stored(sources.score_sources(sources.prepare_sources(found), as_of).drop("query_no", "rank", "score"), "sources")
    wanted = pages.join(chosen.select("page_id").distinct(), "page_id", "left_semi")
    passages = stored(evidence.extract_evidence(claims, chunks(wanted), chosen), "passages")
    ranked = stored(ranking.rank_evidence(passages), "ranked")
    usable = wanted.filter(evidence.word_count(F.col("text")) >= min_words)
    packages = stored(ranking.package_evidence(claims, ranked, chosen, usable, passages), "packages")
    return Retrieved(packages, ranking.select_context(ranked))


def answer_with_evidence(
    claims: DataFrame, pages: DataFrame, model: Callable[[DataFrame, DataFrame], DataFrame], as_of: str, **retrieval
) -> DataFrame:
    """Verdicts of the evidence tier: ``claim_id, verdict, confidence, explanation, sources``.

    ``model`` gets claims with their prompt context (claim_id, claim, context) and the
    context items, only of claims that have any and whose status asks for a model, and
    returns claim_id, raw.  Its output is validated against the evidence; an unusable one
    is UNVERIFIED with confidence 0, as a verdict about the claim must not come from it.
    """
    got = retrieve(claims, pages, as_of, **retrieval)
    asked = got.packages.filter(~F.col("status").isin(grounding.lx.NO_MODEL_STATUSES) & (F.col("items") > 0)).select("claim_id")
    prompts = ranking.context_text(claims.join(asked, "claim_id", "left_semi"), got.context)
    raw = stored(model(claims.select("claim_id", "claim").join(prompts, "claim_id"), got.context), "outputs")
    final = grounding.validate_verdicts(raw, got.packages, got.context)
    shown = ranking.source_list(got.packages).select(
        "claim_id", F.transform("sources", lambda s: F.struct(s["title"], s["url"], s["publisher"], s["publish_date"], s["relevance"].alias("reliability"))).alias("sources")
    )
    usable = F.col("verdict") != "AI_ERROR"
    return final.join(shown, "claim_id", "left").select(
        "claim_id", F.when(usable, F.col("verdict")).otherwise("UNVERIFIED").alias("verdict"), F.when(usable, F.col("confidence")).otherwise(0.0).alias("confidence"),
        F.col("summary").alias("explanation"), "sources",
    )


def check_claims(
    keyed: DataFrame, cache: DataFrame | None, fact_checks: DataFrame, pages: DataFrame, model: Callable[[DataFrame, DataFrame], DataFrame],
    as_of: Column, evidence_as_of: str, fact_check_index: WordIndex | None = None, **retrieval,
) -> DataFrame:
    """From claims to verdicts: stored verdict, else earlier fact-check, else evidence and model.

    ``keyed`` are the rows of :func:`normalize.claim_identity` with a match key.  Fact-checks
    are searched for cache misses only, and pages only for what that left open.
    """

    def search(misses: DataFrame) -> DataFrame:
        return ratings.map_ratings(matching.match_fact_checks(misses, fact_checks, index=fact_check_index))

    def answer(still_open: DataFrame) -> DataFrame:
        return answer_with_evidence(still_open, pages, model, evidence_as_of, **retrieval)

    return cascade.verify_in_stages(keyed, cache, search, answer, as_of)
