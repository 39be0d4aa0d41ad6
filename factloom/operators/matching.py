"""Earlier fact-checks of the same claim: candidate search, agreement, best match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions.text import find_all, jaccard, round_half_up, word_set
from ..functions.udfs import jaro_winkler
from ..session import stored
from .normalize import claim_metadata, collapse_spaces
from .simjoin import set_key
from .wordindex import WordIndex, best_members, best_sets, build_index

#: ids of fact-checks that are broadcast at most, 8 bytes each
BROADCAST_SETS = 500_000
COMPARED = ["numbers", "entities", "dates", "negation"]


def search_query(normalized: Column, limit: int | None = None) -> Column:
    """The text to search; with a limit, as remote services have, the first and last halves of it."""
    if limit is None:
        return normalized
    half = limit // 2
    both = F.concat(F.substring(normalized, 1, half), F.lit(" ... "), F.right(normalized, F.lit(half)))
    return F.when(F.length(normalized) <= limit, normalized).otherwise(both)


def search_words(text: Column) -> Column:
    """Distinct lower-case words of three or more letters, digits or underscores."""
    return F.array_distinct(find_all(F.lower(text), r"[\p{L}\p{N}_]{3,}"))


def match_key(normalized: Column, metadata: Column) -> Column:
    """Claims that must get the same match: equal text, numbers, entities, dates and negation."""
    parts = [F.array_join(metadata[f], "\u0001") for f in COMPARED[:3]]
    negated = (F.size(metadata["negation"]) > 0).cast("string")
    return F.coalesce(F.sha2(F.concat_ws("\u0002", normalized, *parts, negated), 256), F.lit(""))


def recent(fact_checks: DataFrame, as_of: str, max_age_days: int) -> DataFrame:
    return fact_checks.filter(F.date_diff(F.to_date(F.lit(as_of)), F.to_date("review.review_date")) <= max_age_days)


def index_fact_checks(fact_checks: DataFrame, path: str | None = None) -> WordIndex:
    """The words of all fact-checks, stored; a search or a micro-batch probes it without reading a text again."""
    return build_index(fact_checks, "fc_id", search_words(F.col("claim_text")), path)


def fact_check_candidates(
    claims: DataFrame,
    fact_checks: DataFrame | None,
    k: int = lx.SEARCH_PAGE_SIZE,
    min_overlap: float | None = None,
    as_of: str | None = None,
    max_age_days: int | None = None,
    index: WordIndex | None = None,
) -> DataFrame:
    """(match_key, fc_id, score, overlap, rank): the ``k`` best fact-checks per claim.

    Best by the weight of shared words, then word Jaccard (``overlap``), then lower
    ``fc_id``; there is no floor.  Claims with equal words are searched once, and of
    fact-checks with equal words only the ``k`` lowest ids are carried.  ``min_overlap``
    drops results of the ``k`` best, for callers that want no distant ones.  ``index`` is
    a stored index to probe; without one, ``fact_checks`` are indexed first.
    """
    if index is None:
        if max_age_days is not None:
            fact_checks = recent(fact_checks, as_of, max_age_days)
        index = index_fact_checks(fact_checks)
    elif max_age_days is not None:
        raise ValueError("an index has no dates: index the fact-checks of the wanted age")
    wanted = claims.select("match_key", search_words(search_query(F.col("normalized"))).alias("words"))
    wanted = stored(wanted.withColumn("query", set_key(F.col("words"))), "wanted")
    queries = wanted.groupBy("query").agg(F.first("words").alias("words"))
    close = stored(best_sets(index, queries, k), "best")
    top = best_members(index, close, k)
    if min_overlap is not None:
        top = top.filter(F.col("overlap") >= min_overlap)
    found = wanted.select("match_key", "query").join(top, "query")
    return stored(found.select("match_key", F.col("id").alias("fc_id"), "score", "overlap", "rank"), "candidates")


def named_checks(fact_checks: DataFrame, found: DataFrame) -> DataFrame:
    """Fact-checks whose ``fc_id`` is in ``found``: the others stay where they are.

    More ids than a broadcast takes leave the table as it is; the join that follows decides.
    """
    ids = stored(found.select("fc_id").distinct(), "named")
    return fact_checks.join(F.broadcast(ids), "fc_id", "left_semi") if ids.count() <= BROADCAST_SETS else fact_checks


def _leading_number(text: Column) -> Column:
    return F.regexp_extract(text, r"^\d+(?:\.\d+)?", 0).cast("double")


def _empties(left: Column, right: Column, otherwise: Column) -> Column:
    return (
        F.when((F.size(left) == 0) & (F.size(right) == 0), F.lit(1.0))
        .when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.5))
        .otherwise(otherwise)
    )


def _first_hit(left: Column, right: Column, compare) -> Column:
    """First non-null comparison over all pairs in order, else 0."""
    hits = F.array_compact(
        F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: compare(a, b))))
    )
    return F.coalesce(F.get(hits, F.lit(0)), F.lit(0.0))


def number_agreement(left: Column, right: Column) -> Column:
    def compare(a, b):
        x, y = _leading_number(a), _leading_number(b)
        gap = F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1.0))
        return F.when((x == y) | (a == b), F.lit(1.0)).when(gap < F.lit(0.05), F.lit(0.8))

    return _empties(left, right, _first_hit(left, right, compare))


def entity_agreement(left: Column, right: Column) -> Column:
    a = F.array_distinct(F.transform(left, F.lower))
    b = F.array_distinct(F.transform(right, F.lower))
    share = F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b)).cast("double")
    step = (
        F.when(share >= F.lit(0.75), F.lit(1.0))
        .when(share >= F.lit(0.4), F.lit(0.6))
        .when(share > F.lit(0.0), F.lit(0.3))
        .otherwise(F.lit(0.0))
    )
    return _empties(left, right, step)


def date_agreement(left: Column, right: Column) -> Column:
    def year(d):
        return F.nullif(F.regexp_extract(d, r"(?<![A-Za-z0-9_])(?:19|20)\d{2}(?![A-Za-z0-9_])", 0), F.lit(""))

    def compare(a, b):
        return F.when(a == b, F.lit(1.0)).when(year(a) == year(b), F.lit(0.6))

    return _empties(left, right, _first_hit(left, right, compare))


def negation_agreement(left: Column, right: Column) -> Column:
    return F.when((F.size(left) > 0) == (F.size(right) > 0), F.lit(1.0)).otherwise(F.lit(0.0))


def agreement(mine: str, theirs: str) -> list[Column]:
    return [
        entity_agreement(F.col(f"{mine}.entities"), F.col(f"{theirs}.entities")).alias("entity"),
        number_agreement(F.col(f"{mine}.numbers"), F.col(f"{theirs}.numbers")).alias("number"),
        date_agreement(F.col(f"{mine}.dates"), F.col(f"{theirs}.dates")).alias("date"),
        negation_agreement(F.col(f"{mine}.negation"), F.col(f"{theirs}.negation")).alias("negation"),
    ]


def weighted_total(text: Column, weights: dict[str, float] = lx.MATCH_WEIGHTS) -> Column:
    total = text * F.lit(weights["text"])
    for part in ("entity", "number", "date", "negation"):
        total = total + F.col(part) * F.lit(weights[part])
    return round_half_up(total, 4)


def match_type(total: Column, thresholds: dict[str, float] = lx.MATCH_THRESHOLDS) -> Column:
    kind = F.when(F.lit(False), "")
    for name, least in thresholds.items():
        kind = kind.when(total >= F.lit(least), name)
    return kind.otherwise("NO_MATCH")


def is_reliable(kind: Column) -> Column:
    return kind.isin("EXACT", "HIGH_CONFIDENCE")


def text_similarity(left: Column, right: Column) -> Column:
    """Jaro-Winkler up to 200 characters, word Jaccard beyond; equal texts never reach Python."""
    long = F.greatest(F.length(left), F.length(right)) > lx.LONG_TEXT_CHARS
    easy = (left == right) | (left == "") | (right == "") | long
    scored = jaro_winkler(F.when(~easy, left), F.when(~easy, right))
    return (
        F.when(left == right, F.lit(1.0))
        .when((left == "") | (right == ""), F.lit(0.0))
        .when(long, jaccard(word_set(left), word_set(right)))
        .otherwise(scored)
    )


def score_candidates(
    claims: DataFrame,
    fact_checks: DataFrame,
    candidates: DataFrame,
    weights: dict[str, float] = lx.MATCH_WEIGHTS,
    thresholds: dict[str, float] = lx.MATCH_THRESHOLDS,
    case_insensitive: bool = False,
) -> DataFrame:
    """Pairs that pass the safeguards and reach the lowest threshold, with all scores.

    Safeguards and an upper bound (text similarity at most 1) are filters placed
    before the Python text comparison, so hopeless pairs never leave the JVM.
    """
    mine = claims.select("match_key", "normalized", F.struct(*[f"metadata.{f}" for f in COMPARED]).alias("mine"))
    theirs = named_checks(fact_checks, candidates).select("fc_id", "claim_text")
    pairs = candidates.join(theirs, "fc_id").join(mine, "match_key")
    pairs = pairs.withColumn("theirs", claim_metadata(F.col("claim_text"), COMPARED))
    pairs = pairs.select(
        "match_key", "fc_id", "rank", "claim_text", collapse_spaces(F.col("normalized")).alias("a"),
        collapse_spaces(F.col("claim_text")).alias("b"), "mine", "theirs", *agreement("mine", "theirs"),
    )
    # a zero agreement on numbers or entities only arises when both sides have some
    pairs = pairs.filter(
        (F.col("negation") > 0)
        & (F.col("number") > 0)
        & (F.col("entity") > 0)
        & (weighted_total(F.lit(1.0), weights) >= F.lit(min(thresholds.values())))
    )
    b = F.lower("b") if case_insensitive else F.col("b")
    scored = pairs.withColumn("text", text_similarity(F.col("a"), b))
    scored = scored.withColumn("total", weighted_total(F.col("text"), weights))
    scored = scored.withColumn("match_type", match_type(F.col("total"), thresholds))
    return scored.filter(F.col("match_type") != "NO_MATCH").select(
        "match_key", "fc_id", "rank", "claim_text", "text", "entity", "number", "date", "negation",
        "total", "match_type",
    )


def with_match_key(identities: DataFrame) -> DataFrame:
    return identities.withColumn("match_key", match_key(F.col("normalized"), F.col("metadata")))


def distinct_claims(keyed: DataFrame) -> DataFrame:
    """One row per match key: repeated claims are compared once."""
    return keyed.groupBy("match_key").agg(
        F.first("normalized").alias("normalized"), F.first("metadata").alias("metadata")
    )


def best_matches(scored: DataFrame) -> DataFrame:
    """Highest total per claim; the earlier candidate wins a tie."""
    fields = ["fc_id", "rank", "text", "entity", "number", "date", "negation", "total", "match_type"]
    best = F.max_by(F.struct(*fields), F.struct(F.col("total"), -F.col("rank")))
    return scored.groupBy("match_key").agg(best.alias("m")).select("match_key", "m.*")


def match_fact_checks(
    keyed: DataFrame,
    fact_checks: DataFrame,
    weights: dict[str, float] = lx.MATCH_WEIGHTS,
    thresholds: dict[str, float] = lx.MATCH_THRESHOLDS,
    **search,
) -> DataFrame:
    """Best match per ``match_key`` with publisher and review of the fact-check."""
    claims = distinct_claims(keyed)
    candidates = fact_check_candidates(claims, fact_checks, **search)
    best = stored(best_matches(score_candidates(claims, fact_checks, candidates, weights, thresholds)), "matches")
    detail = named_checks(fact_checks, best).select("fc_id", "claim_text", "claimant", "publisher", "review")
    return best.join(detail, "fc_id")


def percent_text(value: Column) -> Column:
    return F.format_string("%.1f", round_half_up(value * F.lit(100.0), 1))


def match_description(kind: Column, total: Column) -> Column:
    pct = F.concat(F.lit(" match ("), percent_text(total), F.lit("% confidence)"))
    return (
        F.when(kind == "EXACT", F.concat(F.lit("Exact"), pct))
        .when(kind == "HIGH_CONFIDENCE", F.concat(F.lit("High confidence"), pct))
        .when(kind == "LOW_CONFIDENCE", F.concat(F.lit("Low confidence"), pct, F.lit(" - needs verification")))
        .otherwise("No reliable match found")
    )


def match_explanation(verdict: Column) -> Column:
    kind = F.col("match_type")
    how = (
        F.when(kind == "EXACT", "exactly matches")
        .when(kind == "HIGH_CONFIDENCE", "closely matches")
        .when(kind == "LOW_CONFIDENCE", "partially matches")
        .otherwise("does not match")
    )
    dots = F.when(F.length("claim_text") > 200, "...").otherwise("")
    return F.concat(
        F.lit("This claim "), how, F.lit(" a fact-check by "),
        F.coalesce("publisher.name", F.lit("a fact-check organization")),
        F.lit(' which rated it "'), F.col("review.textual_rating"), F.lit('" ('), verdict,
        F.lit("). Match confidence: "), percent_text(F.col("total")),
        F.lit('%. Original claim: "'), F.substring("claim_text", 1, 200), dots, F.lit('"'),
    )


def conflicting_fact_checks(scored: DataFrame, rated: DataFrame) -> DataFrame:
    """Claims whose reliable matches carry different verdicts are contested."""
    verdicts = (
        scored.filter(is_reliable(F.col("match_type")))
        .join(rated.select("fc_id", "verdict"), "fc_id")
        .groupBy("match_key")
        .agg(F.count("*").alias("reliable"), F.count_distinct("verdict").alias("verdicts"), F.max("verdict").alias("one"))
    )
    contested = F.col("verdicts") > 1
    return verdicts.select(
        "match_key", "reliable", "verdicts", contested.alias("contested"),
        F.when(contested, "UNVERIFIED").otherwise(F.col("one")).alias("verdict"),
    )


def match_metrics(claims: DataFrame, best: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """Match, reliable-match and no-match rates over all claims."""
    joined = claims.select("match_key").join(best.select("match_key", "match_type"), "match_key", "left")
    kind = F.col("match_type")
    return joined.agg(
        F.count("*").alias("claims"),
        F.count_if(kind.isNotNull()).alias("matched"),
        F.count_if(F.coalesce(is_reliable(kind), F.lit(False))).alias("reliable"),
        (F.count_if(kind.isNotNull()) / F.count("*").cast("double")).alias("match_rate"),
        (F.count_if(kind.isNull()) / F.count("*").cast("double")).alias("no_match_rate"),
    )
