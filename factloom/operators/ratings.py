"""Publisher ratings to verdicts and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions.text import round_half_up
from .matching import percent_text


def normalize_rating(rating: Column) -> Column:
    bare = F.regexp_replace(F.trim(F.lower(rating)), r"[^A-Za-z0-9_\s]", "")
    return F.regexp_replace(bare, r"\s+", " ")


def rating_dimension(spark: SparkSession, mapping: dict[str, str] = lx.RATING_VERDICTS) -> DataFrame:
    return spark.createDataFrame(list(mapping.items()), "rating_key string, listed string")


def rate(df: DataFrame, rating: Column, dimension: DataFrame | None = None) -> DataFrame:
    """Add ``rating_key``, ``rating_source``, ``rated_verdict``, ``rated_confidence``, ``rating_note``.

    The dictionary has a few dozen fixed rows, so it is broadcast.
    """
    dimension = dimension if dimension is not None else rating_dimension(df.sparkSession)
    df = df.withColumn("rating_key", normalize_rating(rating))
    df = df.join(F.broadcast(dimension), "rating_key", "left")
    key, listed = F.col("rating_key"), F.col("listed")
    rule = F.coalesce(
        *[
            F.when(key.rlike(p), F.struct(F.lit(v).alias("v"), F.lit(c).alias("c")))
            for p, v, c in lx.RATING_RULES
        ]
    )
    df = df.withColumn("_rule", F.when(listed.isNull(), rule))
    source = (
        F.when(listed.isNotNull(), "dictionary")
        .when(F.col("_rule").isNotNull(), "rule")
        .otherwise("unknown")
    )
    verdict = F.coalesce(listed, F.col("_rule.v"), F.lit("UNVERIFIED"))
    confidence = (
        F.when(listed == "UNVERIFIED", F.lit(0.8))
        .when(listed.isNotNull(), F.lit(0.9))
        .otherwise(F.coalesce("_rule.c", F.lit(0.3)))
    )
    quoted = F.concat(F.lit('"'), rating, F.lit('"'))
    note = (
        F.when(listed == "UNVERIFIED", F.concat(F.lit("External rating indicates unverified: "), quoted))
        .when(listed.isNotNull(), F.concat(F.lit("Mapped from external rating: "), quoted, F.lit(" → "), listed))
        .when(F.col("_rule").isNotNull(), F.concat(F.lit("Fuzzy matched "), quoted, F.lit(" → "), F.col("_rule.v")))
        .otherwise(F.concat(F.lit("Unknown rating "), quoted, F.lit(", conservative UNVERIFIED")))
    )
    return df.select(
        "*", source.alias("rating_source"), verdict.alias("rated_verdict"),
        confidence.alias("rated_confidence"), note.alias("rating_note"),
    ).drop("_rule", "listed")


def combine(df: DataFrame) -> DataFrame:
    """Verdict and confidence from the rating and the quality of the match.

    Needs ``match_type``, ``total``, ``negation``, ``number`` and the columns of :func:`rate`.
    """
    kind, verdict = F.col("match_type"), F.col("rated_verdict")
    raw = F.col("rated_confidence") * F.col("total")
    adjusted = (
        F.when(kind == "EXACT", F.least(F.lit(1.0), raw * F.lit(1.1)))
        .when(kind == "LOW_CONFIDENCE", raw * F.lit(0.7))
        .otherwise(raw)
    )
    broken = (F.col("negation") == 0) | (F.col("number") == 0)
    kept = (verdict == "UNVERIFIED") & (kind == "EXACT")
    note = F.col("rating_note")
    return df.select(
        "*",
        F.when(broken, "UNVERIFIED").otherwise(verdict).alias("verdict"),
        F.when(broken, F.lit(0.1))
        .when(kept, F.greatest(F.lit(0.5), adjusted))
        .otherwise(round_half_up(adjusted, 3))
        .alias("confidence"),
        F.when(broken, "Critical safeguard mismatch (negation or numbers) - conservative UNVERIFIED")
        .when(kept, F.concat(note, F.lit(" (but strong text match)")))
        .otherwise(
            F.concat(
                note, F.lit(". Source: "), F.coalesce("publisher.name", F.lit("Unknown publisher")),
                F.lit(" ("), F.col("review.url"), F.lit("). Match: "), kind, F.lit(" ("),
                percent_text(F.col("total")), F.lit("% text similarity)."),
            )
        )
        .alias("explanation"),
    )


def source_struct(as_of: str | None = None) -> Column:
    kind = F.col("match_type")
    reliability = F.when(kind == "EXACT", F.lit(lx.RELIABILITY["EXACT"])).when(
        kind == "HIGH_CONFIDENCE", F.lit(lx.RELIABILITY["HIGH_CONFIDENCE"])
    )
    return F.array(
        F.struct(
            F.coalesce("review.title", "claimant", "publisher.name", F.lit("Fact Check")).alias("title"),
            F.col("review.url").alias("url"),
            F.coalesce("publisher.name", F.lit("Google Fact Check")).alias("publisher"),
            F.coalesce("review.review_date", F.lit(as_of).cast("string")).alias("publish_date"),
            F.coalesce(reliability, F.lit(lx.RELIABILITY["OTHER"])).alias("reliability"),
        )
    )


def map_ratings(
    matches: DataFrame, rating_map: DataFrame | None = None, as_of: str | None = None
) -> DataFrame:
    """Matches of ``match_fact_checks`` with verdict, confidence, explanation and sources."""
    rated = combine(rate(matches, F.col("review.textual_rating"), rating_map))
    return rated.withColumn("sources", source_struct(as_of))


def unknown_ratings(fact_checks: DataFrame) -> DataFrame:
    """Ratings neither listed nor covered by a rule, with their frequency."""
    counts = fact_checks.groupBy(F.col("review.textual_rating").alias("rating")).agg(
        F.count("*").alias("uses")
    )
    return rate(counts, F.col("rating")).filter("rating_source = 'unknown'").select(
        "rating", "rating_key", "uses"
    )
