"""A training corpus from raw documents: language, copies, near copies, source weights, token ids.

``run`` applies ``STAGES`` to the documents table.  Every stage is written as Parquet and
read again before the next one starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import content_sort, language_gru, pivotal, sentencepiece_bpe, simhash
from factloom.llm.common import stored
from factloom.llm.queries import tokenizer_file

#: a text whose best language has less probability is of no known language
LEAST_LANGUAGE_SCORE = 0.3
#: near copies: Jaccard similarity of 0.8 of the sets of five-word shingles
WORDS, SIMILARITY = 5, 0.8


def _keyed(docs: DataFrame) -> DataFrame:
    """``key, row``: every whole row with a digest of all its columns.

    The key is read again the same however the table is split, and rows that share it are
    equal, so a decision names its rows by key and no numbered copy of the table is written.
    """
    parts = [F.coalesce(F.sha2(F.col(f"`{c}`").cast("string").cast("binary"), 256), F.lit("null")) for c in docs.columns]
    return docs.select(F.unhex(F.sha2(F.concat(*parts), 256)).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def _taken(keyed: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows that a table ``key, rows, take`` keeps: ``take`` in place of each key's ``rows`` equal ones."""
    decided = stored(decided.filter("take > 0"), "decided")
    out = keyed.join(decided.filter("rows = 1"), "key").select("row", "take")
    if not decided.filter("rows > 1").isEmpty():  # equal rows meet before the shuffle
        again = keyed.join(decided.filter("rows > 1"), "key").groupBy("key").agg(F.first("row").alias("row"), F.first("take").alias("take"))
        out = out.unionByName(again.select("row", "take"))
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("take").cast("int")))).select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter (null and empty ones too) and texts of no known language.

    The network learns from a bounded sample of the labelled documents.  Without any
    labelled text no language is known, and only texts without a letter go.
    """
    net = language_gru.fit(docs, learn=F.lit(True))
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = language_gru.identify(rows, net, carry=("row",))
    if net is None:
        return found.filter(language_gru.has_letter(F.col("row.text"))).select("row.*")
    kept = (F.col("lang_pred") != language_gru.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return found.filter(kept).select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for ASCII white space one stays: most code points, then smallest id.

    Null texts count as empty, and all empty ones are one group.  Rows equal in every column
    are one row.  An empty table stays empty; column names never clash with its own.
    """
    keyed = _keyed(docs)
    found = content_sort.content_groups(keyed.select("key", "row.doc_id", "row.text"), carry=("key",))
    return _taken(keyed, found.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("kept").cast("long")).alias("take")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the row with the smallest id stays (null ids last, then by key).

    Null and empty texts are one group, as are short ones of the same words.  Of rows equal
    in every column one stays.  An empty table stays empty; column names never clash.
    """
    keyed = _keyed(docs)
    name = F.struct(F.coalesce(F.col("row.doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc_id"), "key")
    found = simhash.similar_groups(keyed.select(name.alias("id"), "row.text"), WORDS, SIMILARITY, id_col="id")
    stays = (F.col("id.key") == F.col("component_id.key")).cast("long")
    return _taken(keyed, found.groupBy(F.col("id.key").alias("key")).agg(F.count(F.lit(1)).alias("rows"), F.max(stays).alias("take")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; the sources come to their target weights.

    Null is a source of its own; texts without words, null ones too, leave.  Rows equal in
    every column are separate documents.  An empty table stays empty; names never clash.
    """
    keyed = _keyed(docs)
    mixed = pivotal.mix(keyed.select("key", "row.doc_id", "row.text", "row.source"), row_col="key")
    return _taken(keyed, mixed.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.sum("copies").alias("take")))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256`` of every document in the mix.

    Null and empty texts have the end id alone; whole texts of any length are encoded.
    Repeated rows are encoded each; an empty table gives no rows; other columns are not read.
    """
    model = tokenizer_file("piece_bpe_32k.model")
    return sentencepiece_bpe.encode(docs, model, round_trip=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]

#: SQL can't express the trained network, the shingle hashes, the random rounding or the token ids
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
