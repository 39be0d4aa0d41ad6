"""Passages to a ranked evidence package and a bounded context per claim.

A claim has at most (queries x results per query) pages of bounded length, so the
per-claim windows and the near-duplicate fold work on bounded groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions.text import find_all, round_half_up
from ..session import shuffle_width, stored
from .simjoin import set_key, similar_groups


def drop_exact_copies(evidence: DataFrame, order: str = "pos") -> DataFrame:
    w = Window.partitionBy("claim_id", "content_hash").orderBy(order)
    return evidence.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def drop_near_copies(evidence: DataFrame, similarity: float = 0.85, order: str = "pos") -> DataFrame:
    """Greedy: a passage goes if an earlier *kept* one of its claim is similar enough.

    The fold compares word sets only when their sizes allow the similarity.
    """
    columns = [c for c in evidence.columns if c not in ("claim_id", order)]
    words = F.array_distinct(find_all(F.lower("excerpt"), r"(?U)\S+"))
    item = F.struct(order, words.alias("_words"), *columns)

    def similar(a: Column, b: Column) -> Column:
        na, nb = F.size(a["_words"]), F.size(b["_words"])
        both = F.size(F.array_intersect(a["_words"], b["_words"]))
        possible = F.least(na, nb) >= F.greatest(na, nb) * F.lit(similarity) - F.lit(1e-9)
        close = both / (na + nb - both).cast("double") >= F.lit(similarity)
        return F.when((na == 0) | (nb == 0) | ~possible, F.lit(False)).otherwise(close)

    grouped = evidence.groupBy("claim_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    kept = F.aggregate(
        "items",
        F.slice("items", 1, 0),
        lambda kept, x: F.when(F.exists(kept, lambda k: similar(k, x)), kept).otherwise(
            F.concat(kept, F.array(x))
        ),
    )
    return grouped.select("claim_id", F.inline(kept)).drop("_words")


def per_host(evidence: DataFrame, limit: int, order) -> DataFrame:
    w = Window.partitionBy("claim_id", "host").orderBy(*order)
    return evidence.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n")


def combined_score() -> Column:
    score = (
        F.lit(0.4) * F.col("relevance")
        + F.lit(0.3) * F.col("authority")
        + F.lit(0.2) * F.col("recency")
        + F.lit(0.1) * F.when(F.col("direction") == "SUPPORTS", F.lit(1.0)).otherwise(F.lit(0.5))
    )
    score = score * F.when(F.col("direction") == "UNCLEAR", F.lit(0.7)).otherwise(F.lit(1.0))
    boost = F.when(F.lit(False), F.lit(1.0))
    for kind, factor in lx.SCORE_BOOST.items():
        boost = boost.when(F.col("source_type") == kind, F.lit(factor))
    return score * boost.otherwise(F.lit(1.0))


def with_position(evidence: DataFrame) -> DataFrame:
    """``pos``: source order, then relevance order within the page."""
    w = Window.partitionBy("claim_id").orderBy("source_pos", "page_rank")
    return evidence.withColumn("pos", F.row_number().over(w))


def rank_evidence(
    evidence: DataFrame,
    top: int = 10,
    per_host_limit: int = 2,
    similarity: float = 0.85,
    min_relevance: float = 0.3,
) -> DataFrame:
    """The ``top`` passages per claim with ``combined`` and ``evidence_rank``.

    One exchange on the claim key serves all steps: the finer keys of the inner
    windows are clustered by it.
    """
    df = evidence.filter(F.col("relevance") >= min_relevance)
    df = df.repartition(shuffle_width(df), "claim_id")
    df = drop_exact_copies(with_position(df))
    df = per_host(drop_near_copies(df, similarity), per_host_limit, ["pos"])
    df = df.withColumn("combined", combined_score())
    best = Window.partitionBy("claim_id").orderBy(F.desc("combined"), "pos")
    return df.withColumn("evidence_rank", F.row_number().over(best)).filter(
        F.col("evidence_rank") <= top
    )


def retrieval_status(items: Column, supporting: Column, contradicting: Column) -> Column:
    return (
        F.when(items == 0, "NO_USABLE_EVIDENCE")
        .when((supporting >= 2) & (contradicting >= 2), "CONFLICTING_EVIDENCE")
        .when((supporting > 0) | (contradicting > 0), "SUCCESS")
        .otherwise("WEAK_EVIDENCE")
    )


EVIDENCE_FIELDS = [
    "evidence_rank", "direction", "excerpt", "url", "title", "publisher", "published_at",
    "relevance", "authority", "recency", "source_type", "host", "chunk_index", "content_hash",
    "combined",
]


def package_evidence(
    claims: DataFrame,
    ranked: DataFrame,
    sources: DataFrame | None = None,
    usable_pages: DataFrame | None = None,
    evidence: DataFrame | None = None,
) -> DataFrame:
    """One package per claim, also for claims where a stage came up empty.

    ``sources`` (claim_id, page_id), ``usable_pages`` (page_id with text) and ``evidence``
    (all passages) give the funnel counts and the status of claims without evidence.
    """
    supports = F.count_if(F.col("direction") == "SUPPORTS")
    contradicts = F.count_if(F.col("direction") == "CONTRADICTS")
    packed = ranked.groupBy("claim_id").agg(
        F.sort_array(F.collect_list(F.struct(*EVIDENCE_FIELDS))).alias("evidence"),
        F.count("*").alias("items"),
        supports.alias("supporting"),
        contradicts.alias("contradicting"),
        F.count_distinct("host").alias("independent_domains"),
        F.avg("relevance").alias("avg_relevance"),
        F.avg("authority").alias("avg_authority"),
    )
    out = claims.select("claim_id").join(packed, "claim_id", "left")
    zero = {"items": 0, "supporting": 0, "contradicting": 0, "independent_domains": 0}
    if sources is not None:
        counted = sources
        if usable_pages is not None:
            counted = sources.join(
                usable_pages.select("page_id", F.lit(1).alias("usable")), "page_id", "left"
            )
        out = out.join(
            counted.groupBy("claim_id").agg(
                F.count("*").alias("sources"),
                (F.count("usable") if usable_pages is not None else F.count("*")).alias("pages_used"),
            ),
            "claim_id", "left",
        )
        zero |= {"sources": 0, "pages_used": 0}
    if evidence is not None:
        out = out.join(
            evidence.groupBy("claim_id").agg(F.count("*").alias("passages")), "claim_id", "left"
        )
        zero |= {"passages": 0}
    out = out.fillna(zero)
    status = retrieval_status(F.col("items"), F.col("supporting"), F.col("contradicting"))
    if evidence is not None:
        status = F.when(F.col("passages") == 0, "WEAK_EVIDENCE").otherwise(status)
    if sources is not None:
        status = (
            F.when(F.col("sources") == 0, "NO_RESULTS")
            .when(F.col("pages_used") == 0, "NO_USABLE_EVIDENCE")
            .otherwise(status)
        )
    return out.withColumn("status", status)


def evidence_agreement(ranked: DataFrame) -> DataFrame:
    """Independent hosts on each side, and the weighted signal (never a verdict)."""
    weight = F.col("authority") * F.col("relevance")

    def side(name):
        return F.when(F.col("direction") == name, F.lit(1))

    def total(name):
        return F.sum(F.when(F.col("direction") == name, weight).otherwise(F.lit(0.0)))

    return ranked.groupBy("claim_id").agg(
        F.count_distinct(F.when(side("SUPPORTS") == 1, F.col("host"))).alias("supporting_hosts"),
        F.count_distinct(F.when(side("CONTRADICTS") == 1, F.col("host"))).alias("contradicting_hosts"),
        total("SUPPORTS").alias("support_weight"),
        total("CONTRADICTS").alias("contradict_weight"),
    )


def time_alignment(claims: DataFrame, ranked: DataFrame) -> DataFrame:
    """Whether claim and passage share a year, and the gap to the publication year."""

    def years(text: Column) -> Column:
        return F.array_distinct(find_all(text, r"(?<![A-Za-z0-9_])(?:19|20)\d{2}(?![A-Za-z0-9_])"))

    df = ranked.join(claims.select("claim_id", years(F.col("claim")).alias("claim_years")), "claim_id")
    df = df.withColumn("passage_years", years(F.col("excerpt")))
    latest = F.array_max(F.transform("claim_years", lambda y: y.cast("int")))
    return df.select(
        "claim_id", "evidence_rank", F.arrays_overlap("claim_years", "passage_years").alias("same_year"),
        (F.year("published_at") - latest).alias("years_to_publication"),
    )


def _priority(column: str, names: list[str], default: int) -> Column:
    return F.coalesce(
        F.nullif(F.array_position(F.array(*[F.lit(n) for n in names]), F.col(column)), F.lit(0)) - 1,
        F.lit(default),
    )


def select_context(
    ranked: DataFrame, top: int = 8, per_host_limit: int = 2, min_relevance: float = 0.3
) -> DataFrame:
    """Context items with ``evidence_id`` E1, E2, ... numbered once, in context order.

    When no item of a claim is relevant enough, its three most relevant are used.
    """
    claim = Window.partitionBy("claim_id")
    relevant = F.col("relevance") >= min_relevance
    df = ranked.withColumn("_any", F.max(relevant).over(claim))
    df = df.withColumn(
        "_r", F.row_number().over(claim.orderBy(F.desc("relevance"), "evidence_rank"))
    ).filter(relevant | (~F.col("_any") & (F.col("_r") <= 3)))
    order = [
        _priority("source_type", lx.SOURCE_ORDER, 8),
        _priority("direction", lx.DIRECTION_ORDER, 3),
        -(F.col("relevance") + F.col("authority")) / F.lit(2.0),
        F.col("evidence_rank"),
    ]
    df = per_host(df, per_host_limit, order)
    df = df.withColumn("context_no", F.row_number().over(claim.orderBy(*order)))
    return (
        df.filter(F.col("context_no") <= top)
        .withColumn("evidence_id", F.concat(F.lit("E"), F.col("context_no").cast("string")))
        .drop("_any", "_r")
    )


def context_text(claims: DataFrame, context: DataFrame, max_chars: int = 1000) -> DataFrame:
    """The evidence block of a prompt, one text per claim."""

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(label), value, F.lit("\n"))

    def score(name: str) -> Column:
        # nine digits first: a sum that misses a half by its last bit is rounded as the half
        return F.format_string("%.2f", round_half_up(round_half_up(F.col(name), 9), 2))

    section = F.concat(
        line("EVIDENCE id=", F.col("evidence_id")),
        line("SOURCE_TYPE: ", F.col("source_type")),
        line("DIRECTION: ", F.col("direction")),
        line("PUBLISHER: ", F.coalesce(F.nullif("publisher", F.lit("")), F.lit("Unknown"))),
        line("PUBLISHED_AT: ", F.coalesce(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ssxxx"), F.lit("Unknown"))),
        line("URL: ", F.col("url")),
        line("RELEVANCE: ", score("relevance")),
        line("AUTHORITY: ", score("authority")),
        line("RECENCY: ", score("recency")),
        F.lit("CONTENT:\n"), line("", F.substring("excerpt", 1, max_chars)),
    )
    blocks = context.groupBy("claim_id").agg(
        F.sort_array(F.collect_list(F.struct("context_no", section.alias("section")))).alias("s")
    )
    head = F.lit("EVIDENCE\n-------------------\n")
    body = F.concat(head, F.array_join(F.col("s.section"), "\n---\n"), F.lit("\n"))
    return claims.select("claim_id").join(blocks, "claim_id", "left").select(
        "claim_id",
        F.coalesce(body, F.concat(head, F.lit("No evidence available.\n"))).alias("context"),
    )


def near_copy_groups(rows: DataFrame, row_id: str, words: Column, threshold: float = 0.85) -> DataFrame:
    """(row_id, representative, group_size, copies): one row per row with its group of near copies.

    Rows whose word sets have a Jaccard similarity of ``threshold`` are linked, equal sets
    too; a group is what links connect and its smallest id represents it.  ``copies`` are
    the rows with the very same words.  Pairs inside a group are never written out.
    """
    named = rows.select(F.col(row_id).alias("id"), words.alias("words"), F.monotonically_increasing_id().alias("row"))
    named = stored(named.withColumn("set_id", set_key(F.col("words"))), "words")
    labelled = stored(similar_groups(named, threshold), "groups")
    heads = labelled.groupBy("label").agg(F.min("first").alias("representative"), F.sum("copies").alias("group_size"))
    found = labelled.join(heads, "label").select("set_id", "representative", "group_size", "copies")
    return named.select(F.col("id").alias(row_id), "set_id").join(found, "set_id").drop("set_id")


def independent_sources(sources: DataFrame, groups: DataFrame) -> DataFrame:
    """Effective independent sources per claim: hosts whose first page is no near copy of another host's.

    ``sources``: claim_id, page_id, host, source_pos. ``groups``: page_id, representative.
    """
    first = sources.groupBy("claim_id", "host").agg(F.min_by("page_id", F.struct("source_pos", "page_id")).alias("page_id"))
    named = first.join(groups.select("page_id", "representative"), "page_id", "left")
    return named.groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("hosts"), F.count_distinct(F.coalesce("representative", "page_id")).alias("independent_sources")
    )


def source_list(packages: DataFrame) -> DataFrame:
    """Sources shown with a verdict: snippet of 300 characters, defaults for missing fields."""
    return packages.select(
        "claim_id",
        F.transform(
            "evidence",
            lambda e: F.struct(
                e["title"].alias("title"), e["url"].alias("url"),
                F.coalesce(e["publisher"], F.lit("Unknown")).alias("publisher"),
                F.coalesce(e["published_at"].cast("string"), F.lit("")).alias("publish_date"),
                e["relevance"].alias("relevance"), F.substring(e["excerpt"], 1, 300).alias("snippet"),
            ),
        ).alias("sources"),
    )
