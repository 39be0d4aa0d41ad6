"""Queries of the corpus operators over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import content_sort, context_tree, cross_polytope, language_gru, merkle, pivotal, ranked_search, role_repair, sentencepiece_bpe, simhash, suffix_dedup, token_records, warc
from .common import fold

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_file("piece_bpe_32k.model")
    return sentencepiece_bpe.encode(_table(spark, sf_dir, "documents"), model, round_trip=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spark, _table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.content_groups(_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, distance=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    net = language_gru.fit(docs, learn=fold("doc_id", 3) != 1)
    return language_gru.identify(docs, net).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.search(_table(spark, sf_dir, "embeddings"))


def op8_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = context_tree.score(_table(spark, sf_dir, "documents"), learn=fold("doc_id", 7) != 2)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = token_records.token_round_trip(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivotal.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_repair.repair(_table(spark, sf_dir, "conversations"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.against_next(_table(spark, sf_dir, "documents"))
    own, edited = F.col("tree"), F.col("edited_tree")
    parts = found.select("*", merkle.pieces(own).alias("own_pieces"), merkle.pieces(edited).alias("edited_pieces"))
    return parts.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), merkle.fingerprint(own).alias("fingerprint"), merkle.fingerprint(edited).alias("edited_fingerprint"),
        merkle.likeness(own["root"], F.col("own_pieces"), edited["root"], F.col("edited_pieces")).alias("near_edited"),
        merkle.likeness(own["root"], F.col("own_pieces"), F.col("next_root"), F.col("next_pieces")).alias("near_next"),
        F.size(F.array_except(merkle.paragraph_nodes(edited), merkle.paragraph_nodes(own))).cast("long").alias("changed_paragraphs"),
    )


QUERIES: dict[str, Query] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_warc": op2_warc,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_simhash": op4_simhash,
    "op5_language": op5_language,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_neighbours": op7_neighbours,
    "op8_context_tree": op8_context_tree,
    "op9_token_records": op9_token_records,
    "op10_mixing": op10_mixing,
    "op11_ranked_search": op11_ranked_search,
    "op12_role_repair": op12_role_repair,
    "op13_merkle": op13_merkle,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": """
with p as (select page_id, sha256(coalesce(html, '')) as payload_digest,
    octet_length(encode(coalesce(html, ''))) as payload_bytes from pages),
f as (select *, min(page_id) over (partition by payload_digest) as first_id from p)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
  case when payload_bytes >= 100 and first_id <> page_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and first_id <> page_id then first_id end as refers_to
from f""",
    "op3_exact_dedup": r"""
with t as (select doc_id, length(coalesce(text, '')) as points,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as n from documents),
r as (select doc_id, sha256(n) as text_sha256, count(*) over (partition by n) as group_size,
    first_value(doc_id) over (partition by n order by points desc, doc_id) as keep_id from t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from r""",
    "op6_suffix_dedup": """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
w as (select doc_id, p, substring(h, 2 * p + 1, 200) as s from (select *, unnest(range(n - 99)) as p from d where n >= 100)),
again as (select doc_id, p from (select doc_id, p, row_number() over (partition by s order by doc_id, p) as k from w) where k > 1),
edges as (select *, coalesce(p > lag(p) over (partition by doc_id order by p) + 100, true) as opens from again),
runs as (select *, sum(case when opens then 1 else 0 end) over (partition by doc_id order by p) as run from edges),
spans as (select doc_id, min(p) as b, max(p) + 100 as e from runs group by doc_id, run),
pieces as (select s.doc_id, s.b, s.e, coalesce(lag(s.e) over (partition by s.doc_id order by s.b), 0) as kept_from from spans s),
kept as (select p.doc_id, count(*) as n_spans, sum(p.e - p.b) as n_removed, max(p.e) as behind,
    string_agg(substring(d.h, 2 * p.kept_from + 1, 2 * (p.b - p.kept_from)), '' order by p.b) as begun
  from pieces p join d on d.doc_id = p.doc_id group by p.doc_id)
select d.doc_id, cast(d.n as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans,
  sha256(unhex(case when k.doc_id is null then d.h else concat(begun, substring(d.h, 2 * behind + 1)) end)) as kept_sha256
from d left join kept k on k.doc_id = d.doc_id""",
    "op11_ranked_search": r"""
with d as (select doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{80}-\x{10FFFF}]+') as ts from documents),
q as (select item_id, t, count(*) as times from (select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) as t from benchmark) group by all),
s as (select count(*) as n, sum(len(ts))::bigint as l from d where len(ts) > 0),
p as (select id, t, size, count(*) as tf from (select id, len(ts) as size, unnest(ts) as t from d) group by all),
w as (select t, floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1)))::bigint as w from p, s group by t, n),
r as (select item_id, id as doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * size * n) // l))))::bigint as score
  from q join w using (t) join p using (t), s group by all)
select item_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from r where score > 0)
where rank <= 20""",
    "op13_merkle": r"""
with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('+' || doc_id || ':' || coalesce(text, '')) as k from documents),
f as (select *, coalesce(lead(t) over w, first_value(t) over w) as nt, coalesce(lead(doc_id) over w, first_value(doc_id) over w) as next_id
  from d window w as (order by doc_id desc, k rows between unbounded preceding and unbounded following)),
e as (select *, substring(t, 1, n - n // 2) || substring(nt, 1, n // 2) as edited from f),
texts as (select doc_id, 'own' as kind, t from e union all select doc_id, 'edited', edited from e),
lines as (select doc_id, kind, unnest(l) as p, unnest(range(len(l))) as i from (select doc_id, kind, regexp_extract_all(t, '[^\n]*\n|[^\n]+') as l from texts)),
leaves as (select *, list_transform(regexp_extract_all(p,
    '(?:[^\x20\x09-\x0D]{0,39}[^\x20\x09-\x0D.!?][\x20\x09-\x0D]+){0,7}[^\x20\x09-\x0D]{1,40}[\x20\x09-\x0D]*|[\x20\x09-\x0D]+'), lambda x: sha256(x)) as h from lines),
nodes as (select *, sha256('p' || array_to_string(h, '')) as node, list_transform(h, lambda x: substring(x, 1, 16)) as short from leaves),
parts as (select *, sum(case when node like '0%' or regexp_full_match(p, '[\x20\x09-\x0D]*') then 1 else 0 end)
  over (partition by doc_id, kind order by i rows between unbounded preceding and 1 preceding) as sec from nodes),
sections as (select doc_id, kind, coalesce(sec, 0) as sec, sha256('s' || string_agg(node, '' order by i)) as node,
  string_agg(':' || substring(node, 1, 16) || '=' || array_to_string(short, ','), '' order by i) as below,
  flatten(list(short)) as pieces, list(substring(node, 1, 16)) as paragraphs from parts group by all),
trees as (select doc_id, kind, sha256('r' || string_agg(node, '' order by sec)) as root, string_agg(';' || substring(node, 1, 16) || below, '' order by sec) as branches,
  list_distinct(flatten(list(pieces))) as pieces, list_distinct(flatten(list(paragraphs))) as paragraphs from sections group by all),
whole as (select x.doc_id, x.kind, coalesce(root, sha256('r')) as root, coalesce(branches, '') as branches, coalesce(pieces, []) as pieces, coalesce(paragraphs, []) as paragraphs
  from texts x left join trees t on x.doc_id = t.doc_id and x.kind = t.kind)
select e.doc_id, e.n as n_chars, sha256(e.edited) as edited_sha256, a.root || a.branches as fingerprint, b.root || b.branches as edited_fingerprint,
  2.0::double * (len(list_intersect(a.pieces, b.pieces)) + (a.root = b.root)::int) / (len(a.pieces) + len(b.pieces) + 2) as near_edited,
  2.0::double * (len(list_intersect(a.pieces, c.pieces)) + (a.root = c.root)::int) / (len(a.pieces) + len(c.pieces) + 2) as near_next,
  len(list_filter(b.paragraphs, lambda x: not list_contains(a.paragraphs, x))) as changed_paragraphs
from e join whole a on a.doc_id = e.doc_id and a.kind = 'own' join whole b on b.doc_id = e.doc_id and b.kind = 'edited'
join whole c on c.doc_id = e.next_id and c.kind = 'own'""",
}
