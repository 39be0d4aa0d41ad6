"""Structure of a claim (entities, predicate, type) and search queries made from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions.text import distinct_ignoring_case, find_all, first_match

QUERY_KINDS = ("direct", "entity_predicate", "evidence", "study", "factcheck")


def clean_for_analysis(claim: Column) -> Column:
    return F.trim(
        F.regexp_replace(F.regexp_replace(claim, r"https?://\S+", ""), r"(?U)\s+", " ")
    )


def _find_each(text: Column, patterns: list[str]) -> Column:
    return F.concat(*[find_all(text, p) for p in patterns])


def organizations(text: Column) -> Column:
    return F.array_distinct(_find_each(text, lx.ORGANIZATION_RULES))


def locations(text: Column) -> Column:
    pattern = (
        r"(?iU)\b(?:" + "|".join(lx.PLACE_PREPOSITIONS) + r")\s+(" + "|".join(lx.PLACES) + r")\b"
    )
    return F.array_distinct(find_all(text, pattern, 1))


def people(text: Column) -> Column:
    return F.array_distinct(find_all(text, lx.PERSON))


def analysis_numbers(text: Column) -> Column:
    """Percentages first, then plain numbers that are not years."""
    plain = F.transform(
        find_all(text, lx.ANALYSIS_NUMBER), lambda n: F.regexp_replace(n, ",", "")
    )
    return F.array_distinct(
        F.concat(
            find_all(text, lx.ANALYSIS_PERCENTAGE),
            F.filter(plain, lambda n: ~n.rlike(r"^(19|20)\d\d$")),
        )
    )


def analysis_dates(text: Column) -> Column:
    return F.array_distinct(F.transform(find_all(text, lx.ANALYSIS_DATE), lambda d: F.trim(d)))


def temporal_expressions(text: Column) -> Column:
    return F.array_distinct(_find_each(text, lx.TEMPORAL_RULES))


def main_predicate(text: Column) -> Column:
    """First verb family in priority order, else an auxiliary with its next word."""
    verbs = [first_match(text, rf"(?iU)\b(?:{family})\b") for family in lx.PREDICATE_FAMILIES]
    fallback = first_match(text, rf"(?iU)\b(?:{lx.AUXILIARIES})\s+\w+")
    return F.lower(F.coalesce(*verbs, fallback))


def _without_lead(text: Column, leads: str) -> Column:
    return F.nullif(F.regexp_replace(F.trim(text), rf"(?i)^(?:{leads})\s+", ""), F.lit(""))


def subject(text: Column, predicate: Column) -> Column:
    at = F.instr(F.lower(text), predicate)
    before = F.when(at > 1, _without_lead(text.substr(F.lit(1), at - 1), "the|a|an"))
    return F.coalesce(
        before, first_match(text, r"^(?:the|a|an)?\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)", 1)
    )


def object_(text: Column, predicate: Column) -> Column:
    at = F.instr(F.lower(text), predicate)
    rest = text.substr(at + F.length(predicate), F.length(text))
    return F.when(at > 0, _without_lead(rest, "that|about|of"))


def claim_type(text: Column) -> Column:
    """First type whose keyword list occurs in the text."""
    lowered = F.lower(text)
    kind = F.when(F.lit(False), "")
    for name, keywords in lx.CLAIM_TYPES.items():
        kind = kind.when(lowered.rlike("|".join(keywords)), name)
    return kind.otherwise("GENERAL")


def analyze_claims(df: DataFrame, col: str = "claim") -> DataFrame:
    """Add the analysis columns.  Predicate is computed once, before its dependants."""
    df = df.withColumn("cleaned", clean_for_analysis(F.col(col)))
    text = F.col("cleaned")
    df = df.select(
        "*",
        organizations(text).alias("organizations"),
        locations(text).alias("locations"),
        people(text).alias("people"),
        analysis_numbers(text).alias("analysis_numbers"),
        analysis_dates(text).alias("analysis_dates"),
        temporal_expressions(text).alias("temporal"),
        main_predicate(text).alias("predicate"),
        claim_type(text).alias("claim_type"),
    )
    entities = F.array_distinct(
        F.transform(F.concat("organizations", "locations", "people"), F.lower)
    )
    return df.select(
        "*",
        entities.alias("entities"),
        subject(text, F.col("predicate")).alias("subject"),
        object_(text, F.col("predicate")).alias("object"),
    )


def _capitalised_words(claim: Column, or_digits: bool, strip: bool) -> Column:
    pieces = F.split(claim, r"(?U)\s+")
    if strip:
        pieces = F.transform(pieces, lambda w: F.btrim(w, F.lit(lx.KEYWORD_STRIP)))
    wanted = r"^\p{Lu}" + (r"|^\d+$" if or_digits else "")
    return F.filter(pieces, lambda w: (F.length(w) > 3) & w.rlike(wanted))


def direct_query(claim: Column) -> Column:
    text = F.regexp_replace(F.trim(claim), r"[.!?]+$", "")
    cut = F.when(F.length(text) > 200, F.concat(F.substring(text, 1, 197), F.lit("...")))
    return F.nullif(F.coalesce(cut, text), F.lit(""))


def entity_predicate_query(claim: Column) -> Column:
    parts = F.concat(
        F.slice("entities", 1, 3),
        F.slice("organizations", 1, 2),
        F.slice("people", 1, 2),
        F.array_compact(F.array("predicate", "subject", "object")),
    )
    names = F.slice(_capitalised_words(claim, or_digits=False, strip=False), 1, 5)
    chosen = F.when(F.size(parts) > 0, parts).otherwise(names)
    return F.when(F.size(chosen) > 0, F.array_join(F.slice(chosen, 1, 8), " "))


def query_keywords(claim: Column) -> Column:
    found = F.concat(
        F.slice("analysis_numbers", 1, 3),
        F.slice("analysis_dates", 1, 2),
        F.slice("entities", 1, 3),
        F.slice("organizations", 1, 2),
        F.slice("people", 1, 1),
    )
    names = _capitalised_words(claim, or_digits=True, strip=True)
    base = F.concat(
        F.when(F.size(found) > 0, found).otherwise(names), F.array_compact(F.array("predicate"))
    )
    unique = distinct_ignoring_case(base)
    return F.when(F.size(unique) > 0, F.array_join(F.slice(unique, 1, 7), " ")).otherwise(
        F.substring(claim, 1, 100)
    )


def generate_queries(
    analyzed: DataFrame,
    id_col: str = "claim_id",
    col: str = "claim",
    max_queries: int = 5,
    kinds: tuple[str, ...] = QUERY_KINDS,
) -> DataFrame:
    """(claim_id, query_no, query): at most ``max_queries`` distinct queries per claim."""
    claim = F.col(col)
    df = analyzed.withColumn("_kw", query_keywords(claim))
    built = {
        "direct": direct_query(claim),
        "entity_predicate": entity_predicate_query(claim),
        "evidence": F.concat("_kw", F.lit(" evidence proof")),
        "study": F.concat("_kw", F.lit(" study research")),
        "factcheck": F.concat("_kw", F.lit(" fact check")),
    }
    df = df.select(
        id_col, F.array_compact(F.array(*[built[k] for k in QUERY_KINDS if k in kinds])).alias("_all")
    )
    unique = F.slice(distinct_ignoring_case(F.col("_all")), 1, max_queries)
    return df.select(id_col, F.posexplode(unique).alias("query_no", "query")).withColumn(
        "query_no", F.col("query_no") + 1
    )


def claim_type_counts(analyzed: DataFrame) -> DataFrame:
    return analyzed.groupBy("claim_type").agg(F.count("*").alias("claims"))
