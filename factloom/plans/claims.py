"""Queries over claims: screening, canonical text, metadata, identity, analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicon as lx
from ..operators import analyze as an
from ..operators import normalize as nm
from ..operators import screening as sc
from . import sqltext as st
from .catalog import query
from .tables import SQL_ALL, SQL_BENCH, all_claims, read

UPPER = "translate(claim, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
NORM_SQL = f"with {SQL_ALL}, {st.normalized_ctes('claims')}"


def identities(spark, sf_dir):
    return nm.claim_identity(all_claims(spark, sf_dir))


# ------------------------------------------------------------- screening
def _rule_case(col: str, rules) -> str:
    return "case " + " ".join(
        f"when regexp_matches({col}, {st.q(r)}) then {i}" for i, r in enumerate(rules, 1)
    ) + " end"


@query(
    "screen_claims",
    f"""with {SQL_ALL}, s as (select claim_id, claim, {_rule_case('claim', lx.INJECTION_RULES)} as rule_id from claims)
select claim_id, case when contains(claim, chr(0)) then 'null_byte'
    when regexp_matches(claim, {st.q(lx.CONTROL_CHARS)}) then 'control_char'
    when rule_id is not null then 'injection' when length(claim) > 5000 then 'too_long' end as reject_reason,
  rule_id from s""",
)
def screen_claims(spark, sf_dir):
    return sc.screen_claims(all_claims(spark, sf_dir)).select("claim_id", "reject_reason", "rule_id")


@query(
    "document_screening",
    f"""with s as (select doc_id, lang, text, {_rule_case('text', lx.INJECTION_RULES)} as rule_id from documents)
select lang, coalesce(case when contains(text, chr(0)) then 'null_byte'
    when regexp_matches(text, {st.q(lx.CONTROL_CHARS)}) then 'control_char'
    when rule_id is not null then 'injection' when length(text) > 5000 then 'too_long' end, 'accepted') as outcome,
  count(*) as n from s group by 1, 2""",
)
def document_screening(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("lang", "text")
    return (
        sc.screen_claims(docs, "text")
        .groupBy("lang", F.coalesce("reject_reason", F.lit("accepted")).alias("outcome"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "injection_flags",
    "with " + SQL_ALL + "\n" + " union all ".join(
        f"select {i} as rule_id, count_if(regexp_matches(claim, {st.q(r)})) as hits from claims"
        for i, r in enumerate(lx.INJECTION_RULES, 1)
    ),
)
def injection_flags(spark, sf_dir):
    claims = all_claims(spark, sf_dir)
    hits = claims.agg(
        *[F.count_if(F.col("claim").rlike(r)).alias(str(i)) for i, r in enumerate(lx.INJECTION_RULES, 1)]
    )
    return hits.unpivot([], [str(i) for i in range(1, 11)], "rule_id", "hits").withColumn(
        "rule_id", F.col("rule_id").cast("int")
    )


@query(
    "sanitized_claims",
    f"""with {SQL_ALL}, s as (select claim_id, claim, trim(regexp_replace(claim, {st.q(lx.CONTROL_CHARS)}, '', 'g')) as c from claims)
select claim_id, e is null as valid, e as error, substring(c, 1, 5000) as sanitized from (select *,
  case when claim = '' then 'Claim must be a non-empty string' when c = '' then 'Claim cannot be empty'
  when length(c) > 5000 then 'Claim exceeds maximum length of 5000 characters'
  when {_rule_case('c', lx.INJECTION_RULES[:8])} is not null then 'Claim contains potentially harmful content' end as e from s)""",
)
def sanitized_claims(spark, sf_dir):
    return all_claims(spark, sf_dir).select("claim_id", sc.sanitize(F.col("claim")).alias("r")).select(
        "claim_id", "r.*"
    )


LINK_VARIANT = """case page_id % 6 when 1 then concat('javascript:', url) when 2 then concat('  ', url, ' ')
  when 3 then concat('data:image/png;', url) when 4 then concat('/p/', cast(page_id as varchar(20)))
  when 5 then concat('vbscript:', url) else url end"""


@query(
    "safe_links",
    f"""with l as (select page_id, {LINK_VARIANT} as link from pages)
select page_id, case when regexp_matches(trim(link), {st.q(lx.SAFE_LINK)})
  and not regexp_matches(trim(link), '(?i)^(javascript:|vbscript:)')
  and not regexp_matches(trim(link), {st.q(lx.CONTROL_CHARS)}) then trim(link) else '#' end as href from l""",
)
def safe_links(spark, sf_dir):
    return read(spark, sf_dir, "pages").select(
        "page_id", sc.safe_link(F.expr(LINK_VARIANT)).alias("href")
    )


@query(
    "request_validity",
    f"""{NORM_SQL}, r as (select claim_id, case when claim_id % 3 = 0 then sha256(normalized)
    when claim_id % 3 = 1 then upper(sha256(normalized)) else substring(sha256(normalized), 1, 60) end as h,
    list_extract(['en', 'FR', 'xx', 'de', 'pt'], claim_id % 5 + 1) as lang from norm)
select regexp_matches(h, '^[a-f0-9]{{64}}$') as hash_ok, lower(lang) in {st.in_list(lx.LANGUAGES)} as lang_ok,
  count(*) as n from r group by 1, 2""",
)
def request_validity(spark, sf_dir):
    h = F.col("claim_hash")
    rows = identities(spark, sf_dir).select(
        F.when(F.col("claim_id") % 3 == 0, h)
        .when(F.col("claim_id") % 3 == 1, F.upper(h))
        .otherwise(F.substring(h, 1, 60)).alias("claim_hash"),
        F.expr("element_at(array('en', 'FR', 'xx', 'de', 'pt'), cast(claim_id % 5 + 1 as int))").alias("lang"),
    )
    return sc.valid_request(rows).groupBy("hash_ok", "lang_ok").agg(F.count("*").alias("n"))


@query(
    "evidence_defense",
    f"""select lang, count(*) as passages, count_if({_rule_case('text', lx.INJECTION_RULES)} is not null) as flagged,
  avg(case when {_rule_case('text', lx.INJECTION_RULES)} is null then 1 else 0 end) as clean_rate
from documents group by lang""",
)
def evidence_defense(spark, sf_dir):
    return sc.defense_rate(read(spark, sf_dir, "documents"), "text", "lang")


# --------------------------------------------------- canonical claim text
@query(
    "normalize_steps",
    f"{NORM_SQL} select claim_id, s1 as spaced, s4 as ocr_clean, clean, stripped, normalized from norm",
)
def normalize_steps(spark, sf_dir):
    df = nm.normalize_claims(all_claims(spark, sf_dir))
    spaced = nm.collapse_spaces(F.substring("claim", 1, lx.MAX_NORMALIZE_CHARS))
    df = df.withColumn("spaced", spaced).withColumn("ocr_clean", nm.clean_ocr(F.col("spaced")))
    df = df.withColumn("clean", nm.clean_punctuation(F.col("ocr_clean")))
    return df.select(
        "claim_id", "spaced", "ocr_clean", "clean",
        nm.strip_metadata(F.col("clean")).alias("stripped"), "normalized",
    )


@query(
    "normalized_claims",
    f"""{NORM_SQL} select claim_id, normalized, array_to_string(list_filter([
  case when length(claim) > 10000 then {st.q(lx.WARN_TRUNCATED)} end,
  case when regexp_matches(s1, {st.q(lx.EMOJI)}) then {st.q(lx.WARN_EMOJI)} end,
  case when len(list_filter({st.metadata('dates')}, lambda d: regexp_matches(d, '\\d{{1,2}}/\\d{{1,2}}/\\d{{2,4}}'))) > 0
    then {st.q(lx.WARN_DATE)} end], lambda w: w is not null), '|') as warnings from norm""",
)
def normalized_claims(spark, sf_dir):
    return nm.normalize_claims(all_claims(spark, sf_dir)).select(
        "claim_id", "normalized", F.array_join("warnings", "|").alias("warnings")
    )


def _register_metadata(name: str) -> None:
    @query(
        f"claim_metadata_{name}",
        f"{NORM_SQL} select claim_id, {st.joined(st.metadata(name))} as found, len({st.metadata(name)}) as n from norm",
    )
    def run(spark, sf_dir):
        found = F.col(f"metadata.{name}")
        return nm.normalize_claims(all_claims(spark, sf_dir)).select(
            "claim_id", F.array_join(found, "|").alias("found"), F.size(found).alias("n")
        )


for _name in nm.METADATA:
    _register_metadata(_name)


@query(
    "claim_identity",
    f"""{NORM_SQL} select claim_id, sha256(normalized) as claim_hash, substring(sha256(normalized), 1, 16) as short_hash,
  sha256(lower(trim(claim))) as legacy_id, 'v1' as normalization_version from norm""",
)
def claim_identity(spark, sf_dir):
    return identities(spark, sf_dir).select(
        "claim_id", "claim_hash",
        nm.short_hash(F.col("normalized")).alias("short_hash"),
        nm.legacy_id(F.col("claim")).alias("legacy_id"),
        "normalization_version",
    )


@query(
    "claim_variants",
    f"""{NORM_SQL} select sha256(normalized) as claim_hash, count(*) as sightings, count(distinct claim) as variants,
  min(claim_id) as first_seen, max(claim_id) as last_seen from norm group by 1""",
)
def claim_variants(spark, sf_dir):
    return nm.claim_variants(identities(spark, sf_dir))


@query(
    "cache_keys",
    f"""{NORM_SQL}, k as (select claim_id, case claim_id % 4
    when 0 then concat('factloom:claim:v1:', sha256(normalized)) when 1 then concat('factloom:claim:v2:', sha256(normalized))
    when 2 then concat('other:claim:v1:', sha256(normalized)) else concat('factloom:claim:', sha256(normalized)) end as key from norm),
p as (select claim_id, key, string_split(key, ':') as x from k)
select claim_id, key, ok as valid, case when ok then x[3] end as version, case when ok then x[4] end as hash
from (select *, len(x) = 4 and x[1] = 'factloom' and x[2] = 'claim' and regexp_matches(x[4], '^[a-f0-9]{{64}}$') as ok from p)""",
)
def cache_keys(spark, sf_dir):
    h = F.col("claim_hash")
    key = (
        F.when(F.col("claim_id") % 4 == 0, nm.cache_key(h))
        .when(F.col("claim_id") % 4 == 1, nm.cache_key(h, "v2"))
        .when(F.col("claim_id") % 4 == 2, nm.cache_key(h, namespace="other"))
        .otherwise(F.concat(F.lit("factloom:claim:"), h))
    )
    df = identities(spark, sf_dir).select("claim_id", key.alias("key"))
    df = df.withColumn("p", nm.parse_cache_key(F.col("key")))
    return df.select(
        "claim_id", "key", F.col("p").isNotNull().alias("valid"), "p.version", "p.hash"
    )


@query(
    "idempotency_rate",
    f"""{NORM_SQL}, again as (select normalized as once from norm), {st.normalized_ctes('again', 'once', 'norm2', 'z')}
select count(*) as claims, count_if(once = normalized) as stable,
  avg(case when once = normalized then 1 else 0 end) as rate from norm2""",
)
def idempotency_rate(spark, sf_dir):
    return nm.idempotency_rate(all_claims(spark, sf_dir))


@query(
    "hash_determinism",
    f"""with {SQL_BENCH}, v as (select claim_id, claim from claims union all select claim_id, {UPPER} from claims
  union all select claim_id, concat('  ', replace(claim, ' ', '   '), '!!!') from claims), {st.normalized_ctes('v')},
g as (select claim_id, count(distinct sha256(normalized)) as hashes from norm group by 1)
select count(*) as groups, count_if(hashes = 1) as one_hash, count_if(hashes = 1) / count(*)::double as determinism from g""",
)
def hash_determinism(spark, sf_dir):
    from ..operators.evaluation import hash_determinism_rate
    from .tables import bench_claims

    claims = bench_claims(spark, sf_dir).select(
        "claim_id",
        F.explode(
            F.array(
                F.col("claim"), F.expr(UPPER),
                F.concat(F.lit("  "), F.replace("claim", F.lit(" "), F.lit("   ")), F.lit("!!!")),
            )
        ).alias("claim"),
    )
    return hash_determinism_rate(nm.claim_identity(claims), "claim_id", "claim_hash")


@query(
    "digit_confusion",
    f"""with {SQL_ALL}, t as (select claim_id, list_filter(regexp_extract_all(claim, '\\b[0-9OISB]+\\b'),
  lambda x: regexp_matches(x, '[0-9]') and regexp_matches(x, '[OISB]')) as found from claims)
select claim_id, {st.joined('found')} as found, len(found) > 0 as suspicious from t""",
)
def digit_confusion(spark, sf_dir):
    found = nm.confusable_digits(F.col("claim"))
    return all_claims(spark, sf_dir).select(
        "claim_id", F.array_join(found, "|").alias("found"), (F.size(found) > 0).alias("suspicious")
    )


@query(
    "sub_claims",
    f"with {SQL_ALL} select post_id, pos, post_id * 16777216 + pos as claim_id, b as claim from sentences",
)
def sub_claims(spark, sf_dir):
    bench = read(spark, sf_dir, "benchmark").selectExpr("item_id as post_id", "text")
    turns = read(spark, sf_dir, "conversations").filter("role = 'user'").selectExpr(
        "1000000 + conv_id * 1000 + turn as post_id", "text"
    )
    return nm.sub_claims(bench.unionByName(turns))


# --------------------------------------------------------- claim analysis
_B = r"[\p{L}\p{N}_]"
_ORG = [
    ("WHO|CDC|FDA|NIH|UN|EU|NATO|IMF|World  Bank|WTO", True),
    (rf"(?:University|Institute|College)\s+of\s+{_B}+", True),
    (rf"{_B}+\s+(?:University|Institute|Hospital|Clinic|Foundation|Corporation|Inc|Ltd|LLC)", True),
]
_MON = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"


def _cat(*lists: str) -> str:
    out = lists[0]
    for item in lists[1:]:
        out = f"list_concat({out}, {item})"
    return out


def _predicate() -> str:
    verbs = ", ".join(st.first_unicode("cleaned", f, "i") for f in lx.PREDICATE_FAMILIES)
    aux = st.first_unicode("cleaned", rf"(?:{lx.AUXILIARIES})\s+{_B}+", "i")
    return f"lower(coalesce({verbs}, {aux}))"


def _type_case() -> str:
    return "case " + " ".join(
        f"when regexp_matches(lower(cleaned), {st.q('|'.join(k))}) then '{n}'"
        for n, k in lx.CLAIM_TYPES.items()
    ) + " else 'GENERAL' end"


_TEMPORAL = [
    r"(?:by|before|after|since|until)\s+\d{4}", r"(?:in|during)\s+(?:19|20)\d{2}",
    r"(?:last|this|next)\s+(?:week|month|year|quarter)", "yesterday|today|tomorrow",
    "recently|currently|now",
]
_NUMS = _cat(
    st.find_unicode("cleaned", r"\d+(?:\.\.\d+)?\s*%%", end=False),
    "list_filter(list_transform("
    + st.find_unicode("cleaned", r"\d+(?:,,\d{3})*(?:\.\.\d+)?")
    + ", lambda n: replace(n, ',', '')), lambda n: not regexp_matches(n, '^(19|20)\\d\\d$'))",
)
_DATES = st.find_unicode(
    "cleaned",
    rf"(?:19|20)\d{{2}}|{_MON}[a-z]*\s+\d{{1,2}}(?:,,)?\s+\d{{4}}|\d{{1,2}}\s+{_MON}[a-z]*\s+\d{{4}}"
    rf"|yesterday|today|tomorrow|last\s+{_B}+|this\s+{_B}+|next\s+{_B}+",
    "i",
)
_PLACES = st.find_unicode("cleaned", rf"(?:in|from|at|to|near|around)\s+(?:{'|'.join(lx.PLACES)})", "i")
ANALYZED = f"""
a0 as (select *, trim(regexp_replace(regexp_replace(claim, 'https?://\\S+', '', 'g'), '\\s+', ' ', 'g')) as cleaned from claims),
a1 as (select *, {_cat(*[st.find_unicode('cleaned', p, 'i') for p, _ in _ORG])} as orgs0,
  list_transform({_PLACES}, lambda m: regexp_extract(m, '\\s(\\S+)$', 1)) as locs0,
  {st.find_unicode('cleaned', rf'(?:Dr|Prof|Professor|Mr|Ms|Mrs)[.][.]\s+{_B}+(?:\s+{_B}+)?', 'i')} as people0,
  {_NUMS} as nums0, {_DATES} as dates0,
  {_cat(*[st.find_unicode('cleaned', p, 'i') for p in _TEMPORAL])} as temporal0,
  {_predicate()} as predicate, {_type_case()} as claim_type from a0),
a2 as (select *, {st.distinct_in_order('orgs0')} as orgs, {st.distinct_in_order('locs0')} as locs,
  {st.distinct_in_order('people0')} as people, {st.distinct_in_order('nums0')} as nums,
  {st.distinct_in_order('dates0')} as dates, {st.distinct_in_order('temporal0')} as temporal,
  strpos(lower(cleaned), predicate) as at_pos from a1),
a3 as (select *, list_transform(list_concat(list_concat(orgs, locs), people), lambda x: lower(x)) as ents0,
  coalesce(case when at_pos > 1 then nullif(regexp_replace(trim(substring(cleaned, 1, at_pos - 1)), '(?i)^(?:the|a|an)\\s+', ''), '') end,
    nullif(regexp_extract(cleaned, '^(?:the|a|an)?\\s*([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*)', 1), '')) as subject,
  case when at_pos > 0 then nullif(regexp_replace(trim(substring(cleaned, at_pos + length(predicate))), '(?i)^(?:that|about|of)\\s+', ''), '') end as object
  from a2),
analyzed as (select *, {st.distinct_in_order('ents0')} as ents from a3)"""
AN_SQL = f"with {SQL_ALL}, {ANALYZED}"


def analyzed(spark, sf_dir):
    return an.analyze_claims(all_claims(spark, sf_dir))


def _register_analysis(name: str, spark_col: str, sql_col: str) -> None:
    @query(name, f"{AN_SQL} select claim_id, {st.joined(sql_col)} as found from analyzed")
    def run(spark, sf_dir):
        return analyzed(spark, sf_dir).select("claim_id", F.array_join(spark_col, "|").alias("found"))


for _n, _c, _s in [
    ("claim_orgs", "organizations", "orgs"), ("claim_locations", "locations", "locs"),
    ("claim_people", "people", "people"), ("claim_entities", "entities", "ents"),
    ("claim_numbers", "analysis_numbers", "nums"), ("claim_dates", "analysis_dates", "dates"),
    ("claim_temporal", "temporal", "temporal"),
]:
    _register_analysis(_n, _c, _s)


@query("claim_predicate", f"{AN_SQL} select claim_id, cleaned, predicate from analyzed")
def claim_predicate(spark, sf_dir):
    return analyzed(spark, sf_dir).select("claim_id", "cleaned", "predicate")


@query("claim_subject_object", f"{AN_SQL} select claim_id, subject, object from analyzed")
def claim_subject_object(spark, sf_dir):
    return analyzed(spark, sf_dir).select("claim_id", "subject", "object")


@query("claim_type_counts", f"{AN_SQL} select claim_type, count(*) as claims from analyzed group by 1")
def claim_type_counts(spark, sf_dir):
    return an.claim_type_counts(analyzed(spark, sf_dir))


_STRIP = st.q(lx.KEYWORD_STRIP)
QUERIES_SQL = f"""
q0 as (select *, regexp_replace(trim(claim), '[.!?]+$', '') as direct0,
  list_concat(list_concat(list_concat(ents[1:3], orgs[1:2]), people[1:2]), list_filter([predicate, subject, object], lambda x: x is not null)) as parts,
  list_filter(string_split_regex(claim, '\\s+'), lambda w: length(w) > 3 and regexp_matches(w, '^\\p{{Lu}}'))[1:5] as caps5,
  list_concat(list_concat(list_concat(list_concat(nums[1:3], dates[1:2]), ents[1:3]), orgs[1:2]), people[1:1]) as kw0,
  list_filter(list_transform(string_split_regex(claim, '\\s+'), lambda w: trim(w, {_STRIP})),
    lambda w: length(w) > 3 and regexp_matches(w, '^\\p{{Lu}}|^\\d+$')) as kwcaps from analyzed),
q1 as (select *, case when length(direct0) > 200 then concat(substring(direct0, 1, 197), '...') else nullif(direct0, '') end as direct,
  case when len(parts) > 0 then parts else caps5 end as chosen,
  list_concat(case when len(kw0) > 0 then kw0 else kwcaps end, list_filter([predicate], lambda x: x is not null)) as kw1 from q0),
q2 as (select *, {st.distinct_in_order('kw1', lower=True)} as kw2 from q1),
q3 as (select *, case when len(kw2) > 0 then array_to_string(kw2[1:7], ' ') else substring(claim, 1, 100) end as kw,
  case when len(chosen) > 0 then array_to_string(chosen[1:8], ' ') end as ep from q2),
q4 as (select claim_id, list_filter([direct, ep, concat(kw, ' evidence proof'), concat(kw, ' study research'), concat(kw, ' fact check')],
  lambda x: x is not null) as qs from q3),
q5 as (select claim_id, ({st.distinct_in_order('qs', lower=True)})[1:5] as qs from q4),
search_queries as (select claim_id, unnest(range(1, len(qs) + 1)) as query_no, unnest(qs) as query from q5)"""


@query("search_queries", f"{AN_SQL}, {QUERIES_SQL} select claim_id, query_no, query from search_queries")
def search_queries(spark, sf_dir):
    return an.generate_queries(analyzed(spark, sf_dir))
