"""Claim text to canonical text, metadata and identity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions.text import find_all
from ..functions.udfs import nfkc


@dataclass(frozen=True)
class NormConfig:
    apply_ocr_corrections: bool = True
    remove_decorative_punctuation: bool = True
    extract_hashtags: bool = True
    extract_mentions: bool = True
    extract_urls: bool = True
    max_length: int = lx.MAX_NORMALIZE_CHARS


def collapse_spaces(text: Column) -> Column:
    """Control characters and any run of Unicode spaces become one space; trimmed."""
    spaced = F.regexp_replace(text, lx.CONTROL_CHARS, " ")
    return F.trim(F.regexp_replace(spaced, lx.SPACES, " "))


def join_spaced_capitals(text: Column) -> Column:
    """``N A S A`` becomes ``NASA`` for runs of two to five letters only."""
    edge_l = r"(?<![A-Za-z0-9_])(?<!(?<![A-Za-z0-9_])[A-Z]\s)"
    edge_r = r"(?![A-Za-z0-9_])(?!\s[A-Z](?![A-Za-z0-9_]))"
    for letters in (5, 4, 3, 2):
        run = r"\s".join(["([A-Z])"] * letters)
        text = F.regexp_replace(
            text, edge_l + run + edge_r, "".join(f"${i}" for i in range(1, letters + 1))
        )
    return text


def clean_ocr(text: Column) -> Column:
    return collapse_spaces(join_spaced_capitals(F.regexp_replace(text, lx.EMOJI, " ")))


def clean_punctuation(text: Column) -> Column:
    for run in lx.DECORATIVE_RUNS:
        text = F.regexp_replace(text, run, "")
    return collapse_spaces(F.regexp_replace(text, lx.NOT_CANONICAL, " "))


def strip_metadata(text: Column, config: NormConfig = NormConfig()) -> Column:
    for wanted, pattern in (
        (config.extract_urls, lx.URL),
        (config.extract_hashtags, lx.HASHTAG),
        (config.extract_mentions, lx.MENTION),
    ):
        if wanted:
            text = F.regexp_replace(text, pattern, " ")
    return collapse_spaces(text)


def canonical_end(text: Column) -> Column:
    """Collapse, trim and drop closing ``.!?``."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(text, r"\s{2,}", " ")), r"[.!?]+$", ""))


def negation_words(text: Column) -> Column:
    return F.filter(
        F.split(F.lower(text), r"\s+"),
        lambda w: F.regexp_replace(w, r"[^A-Za-z0-9_]", "").isin(lx.NEGATION_WORDS),
    )


METADATA = {
    "hashtags": lambda t: find_all(t, lx.HASHTAG, 1),
    "mentions": lambda t: find_all(t, lx.MENTION, 1),
    "urls": lambda t: find_all(t, lx.URL),
    "numbers": lambda t: find_all(t, lx.NUMBER),
    "dates": lambda t: find_all(t, lx.DATE),
    "percentages": lambda t: find_all(t, lx.PERCENTAGE),
    "units": lambda t: find_all(t, lx.UNIT),
    "currency": lambda t: find_all(t, lx.CURRENCY),
    "entities": lambda t: find_all(t, lx.ENTITY),
    "negation": negation_words,
}


def claim_metadata(text: Column, fields: list[str] | None = None) -> Column:
    return F.struct(*[METADATA[f](text).alias(f) for f in fields or METADATA])


def normalize_claims(
    df: DataFrame, col: str = "claim", config: NormConfig = NormConfig()
) -> DataFrame:
    """Add ``normalized``, ``warnings`` and ``metadata``.

    Only rows with a non-ASCII character are sent to the NFKC UDF; the others
    cross the Arrow boundary as nulls.
    """
    raw = F.col(col)
    kept = F.substring(raw, 1, config.max_length)
    composed = F.coalesce(nfkc(F.when(kept.rlike(r"[^\x00-\x7F]"), kept)), kept)
    df = df.withColumn("_spaced", collapse_spaces(composed))
    cleaned = F.col("_spaced")
    if config.apply_ocr_corrections:
        cleaned = clean_ocr(cleaned)
    if config.remove_decorative_punctuation:
        cleaned = clean_punctuation(cleaned)
    df = df.withColumn("_clean", cleaned)
    df = df.withColumn("metadata", claim_metadata(F.col("_clean")))
    stripped = F.col("_clean")
    if config.extract_urls or config.extract_hashtags or config.extract_mentions:
        stripped = strip_metadata(stripped, config)
    emoji = F.col("_spaced").rlike(lx.EMOJI) if config.apply_ocr_corrections else F.lit(False)
    warnings = F.filter(
        F.array(
            F.when(F.length(raw) > config.max_length, lx.WARN_TRUNCATED),
            F.when(emoji, lx.WARN_EMOJI),
            F.when(
                F.exists("metadata.dates", lambda d: d.rlike(lx.AMBIGUOUS_DATE)), lx.WARN_DATE
            ),
        ),
        lambda w: w.isNotNull(),
    )
    return (
        df.withColumn("normalized", canonical_end(F.lower(stripped)))
        .withColumn("warnings", warnings)
        .drop("_spaced", "_clean")
    )


def claim_hash(normalized: Column) -> Column:
    """Never null, so that joins on it add no null check that repeats the normalisation."""
    return F.coalesce(F.sha2(normalized, 256), F.lit(""))


def short_hash(normalized: Column) -> Column:
    return F.substring(claim_hash(normalized), 1, 16)


def is_valid_hash(value: Column) -> Column:
    return value.rlike(lx.SHA256_HEX)


def legacy_id(raw: Column) -> Column:
    return F.sha2(F.lower(F.trim(raw)), 256)


def cache_key(
    hashed: Column, version: str = lx.CACHE_SCHEMA_VERSION, namespace: str = lx.CACHE_NAMESPACE
) -> Column:
    return F.concat_ws(":", F.lit(namespace), F.lit("claim"), F.lit(version), hashed)


def parse_cache_key(key: Column, namespace: str = lx.CACHE_NAMESPACE) -> Column:
    """Struct (namespace, data_type, version, hash), null for a malformed key."""
    parts = F.split(key, ":", -1)
    ok = (
        (F.size(parts) == 4)
        & (F.try_element_at(parts, F.lit(1)) == namespace)
        & (F.try_element_at(parts, F.lit(2)) == "claim")
        & is_valid_hash(F.try_element_at(parts, F.lit(4)))
    )
    names = ("namespace", "data_type", "version", "hash")
    return F.when(
        ok, F.struct(*[F.try_element_at(parts, F.lit(i)).alias(n) for i, n in enumerate(names, 1)])
    )


def claim_identity(
    df: DataFrame, col: str = "claim", config: NormConfig = NormConfig()
) -> DataFrame:
    """Normalise and add ``claim_hash`` and ``normalization_version``."""
    return normalize_claims(df, col, config).select(
        "*",
        claim_hash(F.col("normalized")).alias("claim_hash"),
        F.lit(lx.NORMALIZATION_VERSION).alias("normalization_version"),
    )


def idempotency_rate(df: DataFrame, col: str = "claim") -> DataFrame:
    once = normalize_claims(df, col).select(F.col("normalized").alias("once"))
    twice = normalize_claims(once, "once")
    stable = (F.col("once") == F.col("normalized")).cast("int")
    return twice.agg(
        F.count("*").alias("claims"),
        F.sum(stable).cast("bigint").alias("stable"),
        F.avg(stable).alias("rate"),
    )


def claim_variants(identities: DataFrame, ts: str | None = None) -> DataFrame:
    """Viral count per claim: sightings, distinct spellings, first and last seen.

    Spellings are counted, not collected, so a very popular claim stays one small row.
    """
    seen = F.col(ts) if ts else F.col("claim_id")
    return identities.groupBy("claim_hash").agg(
        F.count("*").alias("sightings"),
        F.count_distinct("claim").alias("variants"),
        F.min(seen).alias("first_seen"),
        F.max(seen).alias("last_seen"),
    )


def confusable_digits(text: Column) -> Column:
    """Tokens mixing digits with letters often read for digits (O, I, S, B)."""
    letters = "".join(lx.CONFUSABLE_DIGITS)
    return find_all(
        text,
        rf"(?<![A-Za-z0-9_])(?=[0-9{letters}]*[0-9])(?=[0-9{letters}]*[{letters}])"
        rf"[0-9{letters}]+(?![A-Za-z0-9_])",
    )


def sub_claims(posts: DataFrame, id_col: str = "post_id", col: str = "text") -> DataFrame:
    """One row per sentence of a post with its own id.

    Ids leave room for 2^24 sentences in a post, more than an admitted text has characters.
    """
    from ..functions.text import split_sentences

    return posts.select(
        F.col(id_col).alias("post_id"), F.posexplode(split_sentences(F.col(col))).alias("pos", "claim")
    ).withColumn("claim_id", F.col("post_id") * 2**24 + F.col("pos"))
