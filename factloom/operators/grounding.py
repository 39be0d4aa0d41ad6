"""Model outputs checked against the evidence they were given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions.text import find_all, one_digit

OUTPUT_SCHEMA = (
    "verdict string, confidence double, summary string, reasoning string, supporting_evidence array<string>, "
    "contradicting_evidence array<string>, contextual_evidence array<string>"
)


def parse_outputs(outputs: DataFrame, col: str = "raw") -> DataFrame:
    """Strip code fences, parse the JSON and mark rows that break the schema (``valid`` false)."""
    text = F.regexp_replace(F.col(col), r"(?U)^\s*(?:```json|```)?|(?:```)?\s*$", "")
    df = outputs.withColumn("o", F.from_json(text, OUTPUT_SCHEMA))
    verdict = F.upper("o.verdict")
    valid = (
        verdict.isin(lx.VERDICTS + ["AI_ERROR"])
        & F.col("o.confidence").between(0, 1)
        & (F.length("o.summary") > 0)
        & (F.length("o.reasoning") > 0)
    )
    none = F.array().cast("array<string>")
    return df.select(
        *outputs.columns, F.coalesce(valid, F.lit(False)).alias("valid"), verdict.alias("verdict"),
        F.col("o.confidence").alias("confidence"), F.col("o.summary").alias("summary"),
        F.col("o.reasoning").alias("reasoning"),
        *[F.coalesce(f"o.{k}_evidence", none).alias(k) for k in ("supporting", "contradicting", "contextual")],
    )


def numbers_in(text: Column) -> Column:
    return F.array_distinct(find_all(text, lx.GROUNDING_NUMBER, 1))


def names_in(text: Column) -> Column:
    return F.array_distinct(find_all(text, lx.CAPITALIZED_PHRASE))


def years_in(text: Column) -> Column:
    return F.array_distinct(find_all(text, r"(?U)\b(?:19|20)\d{2}\b"))


def evidence_profile(context: DataFrame) -> DataFrame:
    """Per claim: ids, directions, numbers, names, years and averages of its context items.

    A context holds a bounded number of items, so the collected list is small.
    """
    item = F.struct("context_no", "evidence_id", "direction", "excerpt")
    df = context.groupBy("claim_id").agg(
        F.sort_array(F.collect_list(item)).alias("items"),
        F.count("*").alias("evidence_count"),
        F.count_distinct("host").alias("domains"),
        F.avg("relevance").alias("avg_relevance"),
        F.avg("authority").alias("avg_authority"),
    )
    df = df.withColumn("_text", F.array_join("items.excerpt", " "))
    return df.select(
        "claim_id", "items", "evidence_count", "domains", "avg_relevance", "avg_authority",
        F.col("items.evidence_id").alias("ids"),
        numbers_in(F.col("_text")).alias("e_numbers"), names_in(F.col("_text")).alias("e_names"),
        years_in(F.col("_text")).alias("e_years"),
    )


def _number(n: Column) -> Column:
    return F.regexp_replace(n, "[,%]", "").cast("double")


def ungrounded_numbers() -> Column:
    said = numbers_in(F.concat_ws(" ", "reasoning", "summary"))

    def found(n: Column) -> Column:
        bare = F.replace(n, F.lit(","))
        return F.exists(
            "e_numbers",
            lambda e: (bare == F.replace(e, F.lit(",")))
            | ((_number(e) != 0) & (F.abs(_number(n) - _number(e)) / _number(e) < F.lit(0.1))),
        )

    return F.filter(said, lambda n: ~F.replace(n, F.lit(",")).isin(lx.IGNORED_NUMBERS) & ~found(n))


def ungrounded_names() -> Column:
    said = names_in(F.concat_ws(" ", "reasoning", "summary"))

    def found(n: Column) -> Column:
        low = F.lower(n)
        return F.exists("e_names", lambda e: F.contains(F.lower(e), low) | F.contains(low, F.lower(e)))

    return F.filter(
        said, lambda n: (F.length(n) > 3) & ~F.lower(n).isin(lx.IGNORED_ENTITIES) & ~found(n)
    )


def ignored_negations() -> Column:
    """Evidence ids with a negation while the reasoning has neither ``not`` nor ``no`` in it."""
    low = F.lower("reasoning")
    silent = ~F.contains(low, F.lit("not")) & ~F.contains(low, F.lit("no"))
    negated = F.filter("items", lambda i: F.lower(i["excerpt"]).rlike(lx.EVIDENCE_NEGATION))
    return F.when(silent, F.transform(negated, lambda i: i["evidence_id"])).otherwise(
        F.array().cast("array<string>")
    )


def ungrounded_years() -> Column:
    return F.array_except(years_in(F.concat_ws(" ", "reasoning", "summary")), F.col("e_years"))


def factual_sentences() -> Column:
    pieces = F.transform(F.split("reasoning", r"[.!?]+"), lambda s: F.trim(s))
    return F.filter(
        pieces, lambda s: (F.length(s) >= 20) & F.lower(s).rlike("|".join(lx.FACTUAL_CUES))
    )


def unsupported_sentences() -> Column:
    """Factual sentences with numbers that share no number and no name with the evidence."""
    return F.filter(
        factual_sentences(),
        lambda s: (F.size(numbers_in(s)) > 0)
        & ~F.arrays_overlap(numbers_in(s), F.col("e_numbers"))
        & ~F.arrays_overlap(names_in(s), F.col("e_names")),
    )


def direction_mismatches() -> Column:
    def cited(kind: str, opposite: str, label: str) -> Column:
        wrong = F.filter(
            "items", lambda i: F.array_contains(F.col(kind), i["evidence_id"]) & (i["direction"] == opposite)
        )
        return F.transform(
            wrong, lambda i: F.concat(i["evidence_id"], F.lit(f" classified as {opposite} but cited as {label}"))
        )

    return F.concat(cited("supporting", "CONTRADICTS", "SUPPORTS"), cited("contradicting", "SUPPORTS", "CONTRADICTS"))


def capped_confidence() -> Column:
    """Model confidence bounded by retrieval status and evidence quality."""
    ceiling = F.when(F.lit(False), F.lit(0.0))
    for status, value in lx.STATUS_CEILING.items():
        ceiling = ceiling.when(F.col("status") == status, F.lit(value))
    ceiling = ceiling.otherwise(F.lit(0.5))
    quality = (F.col("avg_relevance") + F.col("avg_authority")) / F.lit(2.0)
    ceiling = F.when(F.col("evidence_count") > 0, F.greatest(ceiling * quality, F.lit(0.1))).otherwise(ceiling)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"), ceiling))


def ground(parsed: DataFrame, profile: DataFrame) -> DataFrame:
    """Add the grounding findings, filtered citations, ``warnings`` and ``grounded``."""
    return _findings(parsed.join(profile, "claim_id", "left"))


def _findings(df: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    evidence = ("evidence_count", "domains", "avg_relevance", "avg_authority", "ids", "e_numbers", "e_names", "e_years", "items")
    df = df.select(
        *[c for c in df.columns if c not in evidence], "evidence_count", "domains", "avg_relevance", "avg_authority",
        *[F.coalesce(c, none).alias(c) for c in ("ids", "e_numbers", "e_names", "e_years")],
        F.coalesce("items", F.array().cast("array<struct<context_no:int,evidence_id:string,direction:string,excerpt:string>>")).alias("items"),
    ).fillna({"evidence_count": 0, "domains": 0})
    cited = F.concat("supporting", "contradicting", "contextual")
    df = df.select(
        "*", F.array_except(cited, F.col("ids")).alias("invalid_ids"), F.size(cited).alias("cited"),
        F.size(F.filter(cited, lambda c: F.array_contains("ids", c))).alias("cited_valid"),
        ungrounded_numbers().alias("bad_numbers"), ungrounded_names().alias("bad_names"),
        ignored_negations().alias("bad_negations"), ungrounded_years().alias("bad_years"),
        F.size(factual_sentences()).alias("factual"), unsupported_sentences().alias("unsupported"),
        direction_mismatches().alias("mismatches"),
    )

    def notes(column: str, before: str, after: str) -> Column:
        return F.transform(column, lambda x: F.concat(F.lit(before), x, F.lit(after)))

    warnings = F.concat(
        notes("invalid_ids", "ERROR: Cited evidence ID '", "' not found in context"),
        notes("bad_numbers", "WARNING: Number '", "' in reasoning not found in evidence"),
        notes("bad_names", "WARNING: Entity '", "' in reasoning not found in evidence"),
        notes("bad_negations", "WARNING: Evidence ", " contains negation but reasoning may not reflect it"),
        notes("bad_years", "WARNING: Year '", "' mentioned in reasoning but not found in evidence"),
        F.transform(
            "unsupported",
            lambda s: F.concat(F.lit("WARNING: Potentially unsupported factual claim in reasoning: "), F.substring(s, 1, 100), F.lit("...")),
        ),
        notes("mismatches", "WARNING: Evidence ", ""),
    )
    return df.select(
        "*", warnings.alias("warnings"), (F.size("invalid_ids") == 0).alias("grounded"),
    ).withColumns(
        {k: F.filter(F.col(k), lambda c: F.array_contains("ids", c)) for k in ("supporting", "contradicting", "contextual")}
    ).drop("e_numbers", "e_names", "e_years", "items")


def apply_rules(df: DataFrame) -> DataFrame:
    """Business rules in fixed order on ``verdict``/``confidence``; adds ``rule_notes``.

    Evidence is counted in the package: ``evidence_count`` and ``domains``.  A forced verdict
    replaces the summary and is noted behind the reasoning.
    """
    n = F.col("evidence_count")
    firm = F.col("verdict").isin("SUPPORTED", "FALSE")
    df = df.withColumn("rule_notes", F.array().cast("array<string>"))

    def rule(df: DataFrame, when: Column, note: Column, confidence: Column | None = None, forced: Column | None = None) -> DataFrame:
        df = df.withColumn("_on", F.coalesce(when, F.lit(False)))
        updates = {"rule_notes": F.when(F.col("_on"), F.concat("rule_notes", F.array(note))).otherwise(F.col("rule_notes"))}
        if forced is not None:
            changed = {
                "verdict": F.lit("UNVERIFIED"), "confidence": F.lit(0.0), "summary": forced,
                "reasoning": F.concat("reasoning", F.lit(" [Forced UNVERIFIED: "), forced, F.lit("]")),
            }
            updates |= {k: F.when(F.col("_on"), v).otherwise(F.col(k)) for k, v in changed.items()}
        elif confidence is not None:
            updates["confidence"] = F.when(F.col("_on"), confidence).otherwise(F.col("confidence"))
        return df.withColumns(updates).drop("_on")

    open_verdict = F.col("verdict") != "UNVERIFIED"
    df = rule(df, (n == 0) & open_verdict, F.lit("RULE: No evidence available, forcing UNVERIFIED"), forced=F.lit("No evidence available"))
    df = rule(
        df, F.col("status").isin(lx.UNVERIFIED_STATUSES) & open_verdict,
        F.concat(F.lit("RULE: Retrieval status "), "status", F.lit(" forces UNVERIFIED")),
        forced=F.concat(F.lit("Retrieval status: "), "status"),
    )
    df = rule(
        df, ~F.col("confidence").between(0, 1),
        F.concat(F.lit("RULE: Confidence "), F.col("confidence").cast("string"), F.lit(" out of bounds [0,1], clamping")),
        confidence=F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))),
    )
    df = rule(
        df, ~F.col("verdict").isin(lx.VERDICTS + ["AI_ERROR"]),
        F.concat(F.lit("RULE: Invalid verdict '"), "verdict", F.lit("', defaulting to UNVERIFIED")), forced=F.lit("Invalid verdict from model"),
    )
    df = rule(
        df, (F.col("status") == "CONFLICTING_EVIDENCE") & firm & (F.col("confidence") > F.lit(0.7)),
        F.lit("RULE: Conflicting evidence with high confidence, reducing confidence"),
        confidence=F.least(F.col("confidence"), F.lit(0.6)),
    )
    for threshold, least in lx.EVIDENCE_COUNT_RULES:
        df = rule(
            df, firm & (F.col("confidence") >= F.lit(threshold)) & (n < least),
            F.concat(F.lit("RULE: Confidence "), one_digit(F.col("confidence")), F.lit(f" requires ≥{least} evidence items, have "), n.cast("string")),
            confidence=F.least(F.col("confidence"), F.lit(threshold - 0.1)),
        )
    df = rule(
        df, (F.col("verdict") == "MISLEADING") & ~F.lower("reasoning").rlike("|".join(lx.MISLEADING_CUES)),
        F.lit("RULE: MISLEADING verdict should explain missing context/exaggeration"),
    )
    return rule(
        df, firm & (F.col("domains") < 2) & (F.col("confidence") > F.lit(0.7)),
        F.lit("RULE: Single domain with high confidence, reducing confidence"),
        confidence=F.least(F.col("confidence"), F.lit(0.65)),
    )


#: package columns that replace what the context alone would say
PACKAGE_COUNTS = {"items": "evidence_count", "independent_domains": "domains", "avg_relevance": "avg_relevance", "avg_authority": "avg_authority"}


def validate_verdicts(outputs: DataFrame, packages: DataFrame, context: DataFrame) -> DataFrame:
    """Final verdict per package: ``claim_id, status, verdict, confidence, summary, reasoning, grounded, validation``.

    ``packages``: claim_id, status, and the counts of :func:`ranking.package_evidence`, which
    rules and confidence use; a package without them is counted by its context.  Claims
    without evidence or with a status that needs no model become UNVERIFIED 0 and their
    outputs are not parsed; an unusable output is AI_ERROR, not a verdict about the claim;
    a claim that the model was needed for and has no output has no row.
    """
    counts = [c for c in PACKAGE_COUNTS if c in packages.columns]
    profile = evidence_profile(context)
    sized = packages.select("claim_id", "status", *[F.col(c).alias(f"_{PACKAGE_COUNTS[c]}") for c in counts]).join(profile, "claim_id", "left")
    if counts:
        sized = sized.withColumns({PACKAGE_COUNTS[c]: F.coalesce(f"_{PACKAGE_COUNTS[c]}", PACKAGE_COUNTS[c]) for c in counts})
    none = F.coalesce("evidence_count", F.lit(0)) == 0
    sized = sized.withColumn("skip", none | F.col("status").isin(lx.NO_MODEL_STATUSES)).withColumn("none", none)
    # an output without text is an output: the marker, not the text, tells whether there is one
    said = sized.join(outputs.select("claim_id", "raw", F.lit(True).alias("given")), "claim_id", "left").filter("skip or given")
    parsed = parse_outputs(said.drop("given").withColumn("raw", F.when(~F.col("skip"), F.col("raw"))))
    # findings of unusable outputs are computed on empty texts and never read
    df = parsed.fillna({"reasoning": "", "summary": "", "verdict": "", "confidence": 0.0})
    checked = apply_rules(_findings(df).withColumn("confidence", capped_confidence()))
    usable = ~F.col("skip") & F.col("valid")
    notes = F.array_join(F.transform(F.concat("warnings", "rule_notes"), lambda w: F.concat(F.lit("[VALIDATION] "), w)), "\n")

    def told(skipped: Column, unusable: Column, checked_: Column) -> Column:
        return F.when(F.col("skip"), skipped).when(~F.col("valid"), unusable).otherwise(checked_)

    insufficient = F.when(F.col("none"), "No evidence available for this claim.").otherwise(F.concat(F.lit("Insufficient evidence: "), "status"))
    return checked.select(
        "claim_id", "status", told(F.lit("UNVERIFIED"), F.lit("AI_ERROR"), F.col("verdict")).alias("verdict"),
        F.when(usable, F.col("confidence")).otherwise(0.0).alias("confidence"),
        told(insufficient, F.lit("Invalid model output"), F.col("summary")).alias("summary"),
        F.when(usable, F.col("reasoning")).otherwise("").alias("reasoning"),
        F.when(usable, F.col("grounded")).alias("grounded"), F.when(usable, notes).otherwise("").alias("validation"),
    )
