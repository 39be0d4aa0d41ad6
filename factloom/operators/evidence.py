"""Pages to scored passages for a claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions.text import find_all
from ..functions.udfs import page_text_udf


def page_text(pages: DataFrame, min_chars: int = 200, max_chars: int = 50000) -> DataFrame:
    """Readable text and word count; each page is parsed once, pages without text are dropped."""
    extract = page_text_udf(min_chars, max_chars)
    df = pages.withColumn("text", extract(F.col("html"))).drop("html")
    return df.filter(F.col("text").isNotNull()).withColumn(
        "word_count", F.size(find_all(F.col("text"), r"(?U)\S+"))
    )


def clean_text(text: Column, max_chars: int = 50000) -> Column:
    """At most one blank line, single blanks, trimmed, cut with an ellipsis."""
    tidy = F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " ")
    tidy = F.regexp_replace(tidy, r"(?U)^\s+|\s+$", "")
    cut = F.concat(F.substring(tidy, 1, max_chars), F.lit("..."))
    return F.when(F.length(tidy) > max_chars, cut).otherwise(tidy)


def word_count(text: Column) -> Column:
    return F.size(find_all(text, r"\S+"))


_HELD = "array<struct<t:string,n:int>>"


def _pieces(text: Column, max_words: int) -> Column:
    """Sentences, and the parts between commas of those that are too long: ``array<struct<t, n, part>>``."""
    counted = lambda t, part: F.struct(t.alias("t"), word_count(t).alias("n"), F.lit(part).alias("part"))
    sentences = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: counted(s, False))
    parts = lambda s: F.transform(F.split(s["t"], r"(?<=,)\s+"), lambda p: counted(p, True))
    return F.flatten(F.transform(sentences, lambda s: F.when(s["n"] > max_words, parts(s)).otherwise(F.array(s))))


def chunks(text: Column, min_words: int = 50, max_words: int = 500, overlap: int = 1) -> Column:
    """Chunks filled with whole sentences, each beginning with the last ``overlap`` sentences of the one before.

    A fold over the sentences whose state is the chunk being filled.  A chunk of fewer than
    ``min_words`` is dropped when a sentence does not fit, and at the end; parts of a
    sentence of more than ``max_words`` are dealt without overlap.
    """
    size = lambda held: F.aggregate(held, F.lit(0), lambda s, x: s + x["n"])
    closed = lambda a: F.array_append(a["chunks"], F.array_join(a["held"]["t"], " "))

    def step(a: Column, x: Column) -> Column:
        item = F.struct(x["t"].alias("t"), x["n"].alias("n"))
        fits = a["size"] + x["n"] <= max_words
        more = F.array_append(a["held"], item)
        carried = F.array_append(F.slice(a["held"], F.greatest(F.lit(1), F.size(a["held"]) - overlap + 1), F.lit(overlap)), item) if overlap else F.array(item)
        held = F.when(fits | (x["part"] & (F.size(a["held"]) == 0)), more).when(x["part"], F.array(item)).otherwise(carried)
        close = ~fits & F.when(x["part"], F.size(a["held"]) > 0).otherwise(a["size"] >= min_words)
        return F.struct(F.when(close, closed(a)).otherwise(a["chunks"]).alias("chunks"), held.alias("held"), F.when(fits, a["size"] + x["n"]).otherwise(size(held)).alias("size"))

    start = F.struct(F.array().cast("array<string>").alias("chunks"), F.array().cast(_HELD).alias("held"), F.lit(0).alias("size"))
    last = lambda a: F.when((F.size(a["held"]) > 0) & (a["size"] >= min_words), closed(a)).otherwise(a["chunks"])
    return F.aggregate(_pieces(text, max_words), start, step, last)


def chunk_pages(
    pages: DataFrame, min_words: int = 50, max_words: int = 500, overlap: int = 1
) -> DataFrame:
    """(page_id, chunk_index, chunk): overlapping chunks, computed once per page."""
    long_enough = pages.filter(word_count(F.col("text")) >= min_words)
    return long_enough.select(
        "page_id", F.posexplode(chunks(F.col("text"), min_words, max_words, overlap)).alias("chunk_index", "chunk")
    )


def line_chunks(pages: DataFrame, min_words: int = 50) -> DataFrame:
    """Every non-empty line of a page as one passage."""
    long_enough = pages.filter(word_count(F.col("text")) >= min_words)
    return long_enough.select(
        "page_id",
        F.posexplode(find_all(F.col("text"), r"[^\n ](?:[^\n]*[^\n ])?")).alias("chunk_index", "chunk"),
    )


def claim_keywords(claim: Column) -> Column:
    """Names and numbers (latest first), then content words; twenty at most."""
    base = F.filter(
        find_all(F.lower(claim), r"(?U)\w+"),
        lambda w: ~w.isin(lx.STOP_WORDS) & (F.length(w) > 2),
    )
    named = F.filter(
        F.transform(F.split(claim, r"(?U)\s+"), lambda w: F.btrim(w, F.lit(lx.KEYWORD_STRIP))),
        lambda w: w.rlike(r"^\p{Lu}") | F.regexp_replace(w, "[,.]", "").rlike(r"^\d+$"),
    )
    fresh = F.array_distinct(F.array_except(F.transform(named, F.lower), base))
    return F.slice(F.concat(F.reverse(fresh), base), 1, 20)


def claim_features(claims: DataFrame, col: str = "claim") -> DataFrame:
    """Arrays the relevance score needs, computed once per claim before any join."""
    text = F.col(col)
    df = claims.select(
        "claim_id",
        claim_keywords(text).alias("keywords"),
        F.array_distinct(find_all(text, lx.EVIDENCE_NUMBER)).alias("c_numbers"),
        F.array_distinct(find_all(text, lx.CAPITALIZED_PHRASE)).alias("c_names"),
        F.array_distinct(find_all(F.lower(text), r"(?U)\w+")).alias("c_words"),
    )
    pairs = F.zip_with(
        F.slice("keywords", F.lit(1), F.greatest(F.size("keywords") - 1, F.lit(0))),
        F.slice("keywords", F.lit(2), F.greatest(F.size("keywords") - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return df.withColumn("bigrams", F.when(F.size("keywords") > 1, pairs).otherwise(F.array().cast("array<string>")))


def chunk_features(chunks: DataFrame) -> DataFrame:
    """Arrays and direction counts per passage, computed once before any join."""
    text, lowered = F.col("chunk"), F.lower("chunk")

    def signals(groups):
        return sum((lowered.rlike(rf"(?U)\b(?:{g})\b").cast("int") for g in groups), F.lit(0))

    return chunks.select(
        "page_id", "chunk_index", "chunk", lowered.alias("lowered"),
        F.array_distinct(find_all(text, lx.EVIDENCE_NUMBER)).alias("p_numbers"),
        F.array_distinct(find_all(text, lx.CAPITALIZED_PHRASE)).alias("p_names"),
        F.array_distinct(find_all(lowered, r"(?U)\w+")).alias("p_words"),
        signals(lx.CONTRADICTION_SIGNALS).alias("against"),
        signals(lx.SUPPORT_SIGNALS).alias("in_favour"),
        F.concat(F.lit("sha256:"), F.substring(F.sha2(text, 256), 1, 16)).alias("content_hash"),
    )


def _shared(a: str, b: str) -> Column:
    return F.size(F.array_intersect(a, b))


def relevance() -> Column:
    """Keyword share plus bounded bonuses for adjacent keywords, numbers and names; at most 1."""

    def hits(terms):
        return F.size(F.filter(terms, lambda k: F.contains(F.col("lowered"), k)))

    score = (
        hits("keywords") / F.size("keywords").cast("double")
        + hits("bigrams") * F.lit(0.1)
        + F.least(_shared("c_numbers", "p_numbers") * F.lit(0.15), F.lit(0.3))
        + F.least(_shared("c_names", "p_names") * F.lit(0.1), F.lit(0.2))
    )
    return F.when(F.size("keywords") == 0, F.lit(0.0)).otherwise(F.least(score, F.lit(1.0)))


def direction() -> Column:
    return (
        F.when(F.col("in_favour") > F.col("against"), "SUPPORTS")
        .when(F.col("against") > F.col("in_favour"), "CONTRADICTS")
        .when(_shared("c_words", "p_words") > 3, "CONTEXTUAL")
        .otherwise("UNCLEAR")
    )


def extract_evidence(
    claims: DataFrame, chunks: DataFrame, pairs: DataFrame, min_relevance: float = 0.3
) -> DataFrame:
    """Passages of each (claim_id, page_id) pair that are relevant to the claim.

    ``pairs`` carries the source columns, which are kept.  ``page_rank`` orders the
    passages of a page by relevance.
    """
    wanted = chunks.join(pairs.select("page_id").distinct(), "page_id", "left_semi")
    joined = (
        pairs.join(chunk_features(wanted), "page_id")
        .join(claim_features(claims), "claim_id")
        # scored inside the generator, so that filtering does not compute the score twice
        .withColumn(
            "relevance",
            F.explode(F.filter(F.array(relevance()), lambda r: r >= F.lit(min_relevance))),
        )
        .withColumn("direction", direction())
        .drop("lowered", "keywords", "bigrams", "c_numbers", "p_numbers", "c_names", "p_names", "c_words", "p_words", "against", "in_favour")
        .withColumnRenamed("chunk", "excerpt")
    )
    order = Window.partitionBy("claim_id", "page_id").orderBy(F.desc("relevance"), "chunk_index")
    return joined.withColumn("page_rank", F.row_number().over(order))


def context_window(chunks: DataFrame, reach: int = 1) -> DataFrame:
    """Each passage with its neighbours on the same page."""
    w = Window.partitionBy("page_id").orderBy("chunk_index")
    parts = [F.lag("chunk", i).over(w) for i in range(reach, 0, -1)] + [F.col("chunk")]
    parts += [F.lead("chunk", i).over(w) for i in range(1, reach + 1)]
    return chunks.withColumn("in_context", F.concat_ws(" ", *parts))


def content_changes(snapshots: DataFrame) -> DataFrame:
    """Pages whose content hash differs from the previous snapshot of the same url."""
    w = Window.partitionBy("url").orderBy("snapshot")
    hashed = snapshots.select("url", "snapshot", F.sha2("html", 256).alias("hash"))
    return hashed.withColumn("previous", F.lag("hash").over(w)).withColumn(
        "changed", F.coalesce(F.col("previous") != F.col("hash"), F.lit(False))
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two float vectors, summed in element order in double."""

    def dot(x, y):
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
