"""Admission filters and text-safety predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as lx


def injection_rule(text: Column, rules: list[str] = lx.INJECTION_RULES) -> Column:
    """1-based number of the first matching rule, null when none matches."""
    return F.coalesce(*[F.when(text.rlike(rule), F.lit(i)) for i, rule in enumerate(rules, 1)])


def reject_reason(
    text: Column, max_len: int = lx.MAX_CLAIM_CHARS, rules: list[str] = lx.INJECTION_RULES
) -> Column:
    """First failing check: null byte, control character, injection, length."""
    return F.coalesce(
        F.when(F.contains(text, F.lit("\0")), "null_byte"),
        F.when(text.rlike(lx.CONTROL_CHARS), "control_char"),
        F.when(reduce(lambda a, b: a | b, [text.rlike(r) for r in rules]), "injection"),
        F.when(F.length(text) > max_len, "too_long"),
    )


def screen_claims(
    df: DataFrame,
    col: str = "claim",
    max_len: int = lx.MAX_CLAIM_CHARS,
    rules: list[str] = lx.INJECTION_RULES,
) -> DataFrame:
    text = F.col(col)
    return df.withColumn("reject_reason", reject_reason(text, max_len, rules)).withColumn(
        "rule_id", injection_rule(text, rules)
    )


def sanitize(text: Column, max_len: int = lx.MAX_CLAIM_CHARS) -> Column:
    """Struct (valid, error, sanitized)."""
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), lx.CONTROL_CHARS, ""))
    harmful = injection_rule(clean, lx.INJECTION_RULES[: lx.SANITIZE_RULE_COUNT]).isNotNull()
    error = (
        F.when(F.coalesce(text, F.lit("")) == "", "Claim must be a non-empty string")
        .when(clean == "", "Claim cannot be empty")
        .when(F.length(clean) > max_len, f"Claim exceeds maximum length of {max_len} characters")
        .when(harmful, "Claim contains potentially harmful content")
    )
    return F.struct(
        error.isNull().alias("valid"), error.alias("error"),
        F.substring(clean, 1, max_len).alias("sanitized"),
    )


def safe_link(url: Column) -> Column:
    """The trimmed link, or ``#`` when it must not be followed."""
    trimmed = F.trim(url)
    ok = (
        trimmed.rlike(lx.SAFE_LINK)
        & ~trimmed.rlike(lx.DANGEROUS_LINK)
        & ~trimmed.rlike(lx.CONTROL_CHARS)
    )
    return F.when(F.coalesce(ok, F.lit(False)), trimmed).otherwise("#")


def valid_request(df: DataFrame, hash_col: str = "claim_hash", lang_col: str = "lang") -> DataFrame:
    return df.withColumn("hash_ok", F.col(hash_col).rlike(lx.SHA256_HEX)).withColumn(
        "lang_ok", F.lower(F.col(lang_col)).isin(lx.LANGUAGES)
    )


def defense_rate(evidence: DataFrame, col: str, by: str) -> DataFrame:
    """Share of evidence rows without an injection pattern, per group."""
    flagged = injection_rule(F.col(col)).isNotNull()
    return evidence.groupBy(by).agg(
        F.count("*").alias("passages"),
        F.count_if(flagged).alias("flagged"),
        F.avg((~flagged).cast("int")).alias("clean_rate"),
    )
