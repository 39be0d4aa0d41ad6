"""Search results to filtered, classified and scored sources; page search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..session import shuffle_width, stored
from .matching import search_words
from .wordindex import WordIndex, best_members, best_sets, build_index

_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _URL, group)


def url_host(url: Column) -> Column:
    """Lower-case host without user, port and the brackets of an IPv6 address; empty when there is none."""
    netloc = F.regexp_replace(_part(url, 2), r"^.*@", "")
    return F.lower(F.regexp_replace(F.regexp_replace(netloc, r":\d*$", ""), r"^\[|\]$", ""))


def normalize_url(
    url: Column, schemes: tuple[str, ...] = ("https", "http"), blocked: tuple[str, ...] = ()
) -> Column:
    """Canonical url without user, port, tracking parameters and fragment; null if refused."""
    scheme, host = F.lower(_part(url, 1)), url_host(url)
    params = F.filter(
        F.split(_part(url, 4), "&"),
        lambda p: ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(lx.TRACKING_PARAMS),
    )
    joined = F.array_join(params, "&")
    query = F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise("")
    ok = scheme.isin(*schemes) & (host != "")
    if blocked:
        ok = ok & ~host.isin(*blocked)
    return F.when(ok, F.concat(scheme, F.lit("://"), host, _part(url, 3), query))


def is_private_ip(host: Column) -> Column:
    return host.rlike(lx.PRIVATE_IPV4)


def is_safe_url(url: Column, schemes: tuple[str, ...] = ("https", "http")) -> Column:
    host = url_host(url)
    return (
        (host != "")
        & ~is_private_ip(host)
        & ~host.isin(lx.METADATA_IPS + lx.LOCAL_HOSTS)
        & F.lower(_part(url, 1)).isin(*schemes)
    )


def publisher_of(url: Column) -> Column:
    """First host label in title case, also after digits and hyphens (``Spam-Farm``)."""
    label = F.split_part(F.replace(url_host(url), F.lit("www.")), F.lit("."), F.lit(1))
    return F.replace(F.initcap(F.regexp_replace(label, "([^a-z])", "$1 ")), F.lit(" "))


def prepare_sources(
    results: DataFrame,
    per_host: int = 3,
    schemes: tuple[str, ...] = ("https", "http"),
    blocked: tuple[str, ...] = (),
    order: tuple[str, ...] = ("query_no", "rank"),
) -> DataFrame:
    """Normalise, drop unsafe, keep the first of equal urls, at most ``per_host`` per host.

    Adds ``host`` and ``source_pos`` (place in the kept list).  All windows share the
    claim key, so one exchange serves them.
    """
    df = results.withColumn("host", url_host(F.col("url")))
    df = df.filter(is_safe_url(F.col("url"), schemes))
    if blocked:
        df = df.filter(~F.col("host").isin(*blocked))
    df = df.withColumn("url", normalize_url(F.col("url"), schemes)).repartition(shuffle_width(df), "claim_id")
    first = Window.partitionBy("claim_id", F.lower("url")).orderBy(*order)
    df = df.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    hosts = Window.partitionBy("claim_id", "host").orderBy(*order)
    df = df.withColumn("_n", F.row_number().over(hosts)).filter(F.col("_n") <= per_host)
    place = Window.partitionBy("claim_id").orderBy(*order)
    return df.select(
        *[c for c in df.columns if c not in ("_n", "publisher")],
        F.coalesce(F.col("publisher") if "publisher" in df.columns else F.lit(None), publisher_of(F.col("url"))).alias("publisher"),
        F.row_number().over(place).alias("source_pos"),
    )


def _quoted(names: list[str]) -> str:
    return "|".join(n.replace(".", r"\.") for n in names)


def classify_host(host: Column, url: Column | None = None) -> Column:
    """Source type of a host; with ``url`` path-style fact-check entries can match too."""
    domain = F.replace(host, F.lit("www."))
    listed = domain.rlike(_quoted(lx.FACT_CHECK_DOMAINS))
    if url is not None:
        listed = listed | F.replace(F.lower(url), F.lit("www.")).rlike(
            "^[a-z]+://(?:" + _quoted([d for d in lx.FACT_CHECK_DOMAINS if "/" in d]) + ")"
        )
    return (
        F.when(listed, "FACT_CHECK_ORG")
        .when(domain.rlike(f"(?:{_quoted(lx.GOVERNMENT_SUFFIXES)})$") | domain.isin(lx.GOVERNMENT_DOMAINS), "GOVERNMENT")
        .when(domain.rlike(f"(?:{_quoted(lx.ACADEMIC_SUFFIXES)})$") | domain.isin(lx.ACADEMIC_DOMAINS), "ACADEMIC")
        .when(domain.isin(lx.NEWS_DOMAINS), "MAJOR_NEWS")
        .when(domain.isin(lx.SOCIAL_DOMAINS), "FORUM_SOCIAL")
        .when(domain.rlike("|".join(lx.OFFICIAL_KEYWORDS)), "PRIMARY_OFFICIAL")
        .otherwise("UNKNOWN")
    )


def authority(source_type: Column) -> Column:
    score = F.when(F.lit(False), F.lit(0.0))
    for name, value in lx.AUTHORITY.items():
        score = score.when(source_type == name, F.lit(value))
    return score.otherwise(F.lit(lx.AUTHORITY["UNKNOWN"]))


def recency(published_at: Column, as_of: Column) -> Column:
    """Step score of the age in whole days; unknown dates get the middle score."""
    age = F.floor((F.unix_seconds(as_of) - F.unix_seconds(published_at)) / F.lit(86400.0))
    score = F.when(published_at.isNull(), F.lit(lx.RECENCY_UNKNOWN))
    for days, value in lx.RECENCY_STEPS:
        score = score.when(age <= days, F.lit(value))
    return score.otherwise(F.lit(lx.RECENCY_OLD))


def score_sources(df: DataFrame, as_of: str) -> DataFrame:
    """Add ``source_type``, ``authority`` and ``recency``; naive times are UTC."""
    df = df.withColumn("source_type", classify_host(F.col("host")))
    return df.select(
        "*",
        authority(F.col("source_type")).alias("authority"),
        recency(F.col("published_at"), F.lit(as_of).cast("timestamp")).alias("recency"),
    )


def source_mix(sources: DataFrame) -> DataFrame:
    return sources.groupBy("source_type").agg(
        F.count("*").alias("results"),
        F.count_distinct("host").alias("hosts"),
        F.count_distinct("publisher").alias("publishers"),
    )


def index_pages(pages: DataFrame, path: str | None = None) -> WordIndex:
    """The words of all pages, found once and stored."""
    return build_index(pages, "page_id", search_words(F.col("text")), path)


def search_pages(queries: DataFrame, pages: DataFrame | None, per_query: int = 10, index: WordIndex | None = None) -> DataFrame:
    """(claim_id, query_no, page_id, score, rank): the best pages per query.

    Score = sum of ``floor(1000 * ln(word sets / word sets with the word))``, one at least, over
    the query's distinct words in the page; there is no least share of words; ties by word Jaccard, then page id.  Pages
    with equal words are one word set of the index, and of such copies only ``per_query``
    are carried.  Equal queries are searched once.  ``index`` is a stored index of the pages.
    """
    index = index_pages(pages) if index is None else index
    wanted = stored(
        queries.select("claim_id", "query_no", F.coalesce(F.sha2(F.lower("query"), 256), F.lit("")).alias("query"), search_words(F.col("query")).alias("words")), "wanted"
    )
    best = stored(best_sets(index, wanted.groupBy("query").agg(F.first("words").alias("words")), per_query), "best")
    top = best_members(index, best, per_query).select("query", F.col("id").alias("page_id"), "score", "rank")
    return wanted.drop("words").join(top, "query").drop("query")
