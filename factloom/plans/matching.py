"""Queries over fact-check search, agreement, best match and ratings."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions.text import jaccard, round_half_up, word_set
from ..operators import matching as mt
from ..operators import normalize as nm
from ..operators import ratings as rt
from ..session import stored
from . import sqltext as st
from .catalog import query
from .tables import RATINGS, SQL_BENCH, SQL_FACT_CHECKS, bench_claims, fact_checks, read


def keyed_claims(spark, sf_dir):
    return mt.with_match_key(nm.claim_identity(bench_claims(spark, sf_dir)))


def _candidates(spark, sf_dir):
    keyed = keyed_claims(spark, sf_dir)
    checks = fact_checks(spark, sf_dir)
    return keyed, checks, mt.fact_check_candidates(mt.distinct_claims(keyed), checks)


def _pairs(spark, sf_dir):
    """Candidate pairs with metadata of both sides."""
    keyed, checks, found = _candidates(spark, sf_dir)
    return (
        keyed.select("match_key", "claim_id", "normalized", F.col("metadata").alias("mine"))
        .join(found, "match_key")
        .join(mt.named_checks(checks, found).select("fc_id", "claim_text"), "fc_id")
        .withColumn("theirs", nm.claim_metadata(F.col("claim_text"), mt.COMPARED))
    )


def _words(col: str) -> str:
    bare = f"lower(regexp_replace({col}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'))"
    return f"list_distinct(list_filter(string_split_regex({bare}, '\\s+'), lambda w: length(w) >= 3))"


def word_list(col: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower({col}), '\\s+'), lambda w: length(w) > 2))"


def _jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return (
        f"case when len({a}) = 0 and len({b}) = 0 then 1.0::double when len({a}) = 0 or len({b}) = 0 then 0.0::double "
        f"else {both} / (len({a}) + len({b}) - {both})::double end"
    )


SEARCHED = f"""
cw as (select claim_id, normalized, clean, {_words("normalized")} as w from norm),
fw as (select *, {_words('claim_text')} as fwords from fact_checks),
fd as (select list_sort(fwords) as fset, row_number() over () as set_no from fw where len(fwords) > 0 group by 1),
ft as (select set_no, unnest(fset) as token from fd),
fq as (select claim_id, unnest(w) as token from cw),
fu as (select token, greatest(1, floor(ln((select count(*) from fd) / count(*)::double) * 1000))::bigint as weight from ft group by 1),
hit as (select claim_id, set_no, sum(weight)::bigint as score, count(*) as shared from fq join fu using (token) join ft using (token) group by 1, 2),
sim as (select h.claim_id, set_no, score, fset, shared / (len(w) + len(fset) - shared)::double as overlap from hit h join fd using (set_no) join cw on cw.claim_id = h.claim_id),
cand as (select * from (select claim_id, fc_id, score, overlap, row_number() over (partition by claim_id order by score desc, overlap desc, fc_id) as rank
  from (select * from (select *, rank() over (partition by claim_id order by score desc) as place from sim) where place <= 10) s join fw on s.fset = list_sort(fw.fwords)) where rank <= 10),
pairs as (select c.claim_id, c.fc_id, c.rank, c.overlap, n.normalized, n.clean, f.claim_text, f.rating, f.publisher, f.url, f.review_date,
  {", ".join(f"{st.metadata(m, 'n.clean')} as my_{m}, {st.metadata(m, 'f.claim_text')} as their_{m}" for m in mt.COMPARED)}
  from cand c join norm n using (claim_id) join fact_checks f on f.fc_id = c.fc_id)"""
BASE = f"with recursive {SQL_BENCH}, {SQL_FACT_CHECKS}, {st.normalized_ctes('claims')}, {SEARCHED}"


def _empties(a: str, b: str, other: str) -> str:
    return (
        f"case when len({a}) = 0 and len({b}) = 0 then 1.0::double when len({a}) = 0 or len({b}) = 0 then 0.5::double "
        f"else {other} end"
    )


def _first_hit(a: str, b: str, case: str) -> str:
    return (
        f"coalesce(list_filter(flatten(list_transform({a}, lambda x: list_transform({b}, lambda y: {case}))), "
        "lambda z: z is not null)[1], 0.0::double)"
    )


def _num(v: str) -> str:
    return f"regexp_extract({v}, '^\\d+(?:\\.\\d+)?')::double"


def _year(v: str) -> str:
    return f"nullif(regexp_extract({v}, '\\b(?:19|20)\\d{{2}}\\b'), '')"


NUMBER_SQL = _empties(
    "my_numbers", "their_numbers",
    _first_hit(
        "my_numbers", "their_numbers",
        f"case when {_num('x')} = {_num('y')} or x = y then 1.0::double when abs({_num('x')} - {_num('y')}) / "
        f"greatest({_num('x')}, {_num('y')}, 1.0::double) < 0.05::double then 0.8::double end",
    ),
)
DATE_SQL = _empties(
    "my_dates", "their_dates",
    _first_hit(
        "my_dates", "their_dates",
        f"case when x = y then 1.0::double when {_year('x')} = {_year('y')} then 0.6::double end",
    ),
)
_EA = "list_distinct(list_transform(my_entities, lambda x: lower(x)))"
_EB = "list_distinct(list_transform(their_entities, lambda x: lower(x)))"
_SHARE = f"len(list_intersect({_EA}, {_EB})) / greatest(len({_EA}), len({_EB}))::double"
ENTITY_SQL = _empties(
    "my_entities", "their_entities",
    f"case when {_SHARE} >= 0.75 then 1.0::double when {_SHARE} >= 0.4 then 0.6::double when {_SHARE} > 0 then 0.3::double else 0.0::double end",
)
NEGATION_SQL = "case when (len(my_negation) > 0) = (len(their_negation) > 0) then 1.0::double else 0.0::double end"

# Jaro-Winkler character by character for all pairs at once
JARO_SQL = """
jp as (select claim_id, fc_id, trim(normalized) as s, trim(claim_text) as t from pairs),
js as (select claim_id, fc_id, s, t, greatest(length(s), length(t)) // 2 - 1 as w, 0 as i,
    []::bigint[] as used, '' as m1 from jp where s <> t and s <> '' and t <> '' and greatest(length(s), length(t)) <= 200
  union all
  select claim_id, fc_id, s, t, w, i + 1, case when j is null then used else list_append(used, j) end,
    case when j is null then m1 else concat(m1, s[i + 1]) end
  from (select *, list_filter(range(greatest(0, i - w), least(i + w + 1, length(t))),
      lambda j: t[j + 1] = s[i + 1] and not list_contains(used, j))[1] as j from js where i < length(s))),
jf as (select *, len(used) as m, list_sort(used) as u from js where i = length(s)),
jr as (select *, len(list_filter(range(1, m + 1), lambda k: m1[k] <> t[u[k] + 1])) / 2.0::double as swaps,
    case when s[1] <> t[1] then 0 when s[2] <> t[2] or least(length(s), length(t)) < 2 then 1
      when s[3] <> t[3] or least(length(s), length(t)) < 3 then 2
      when s[4] <> t[4] or least(length(s), length(t)) < 4 then 3 else 4 end as prefix from jf),
jj as (select *, case when m = 0 or w < 0 then 0.0::double else
    (m / length(s)::double + m / length(t)::double + (m - swaps) / m::double) / 3 end as jaro from jr),
jw as (select claim_id, fc_id, case when m = 0 or w < 0 then 0.0::double
    else jaro + prefix * 0.1::double * (1 - jaro) end as jw from jj)"""
SCORED = f"""{JARO_SQL},
agree as (select p.*, {ENTITY_SQL} as entity, {NUMBER_SQL} as number, {DATE_SQL} as date, {NEGATION_SQL} as negation,
  case when trim(p.normalized) = trim(claim_text) then 1.0::double
    when greatest(length(trim(p.normalized)), length(trim(claim_text))) > 200
      then {_jaccard(word_list('trim(p.normalized)'), word_list('trim(claim_text)'))}
    else jw end as text
  from pairs p left join jw on jw.claim_id = p.claim_id and jw.fc_id = p.fc_id),
scored0 as (select *, {st.half_up('text * 0.5::double + entity * 0.2::double + number * 0.15::double + date * 0.1::double + negation * 0.05::double', 4)} as total from agree),
scored as (select *, case when total >= 1.0 then 'EXACT' when total >= 0.85 then 'HIGH_CONFIDENCE' else 'LOW_CONFIDENCE' end as match_type
  from scored0 where total >= 0.6 and negation > 0 and number > 0 and entity > 0),
best as (select * from (select *, row_number() over (partition by claim_id order by total desc, rank) as pick from scored) where pick = 1)"""


def _bare(col: str) -> str:
    return f"regexp_replace(regexp_replace(trim(lower({col})), '[^A-Za-z0-9_\\s]', '', 'g'), '\\s+', ' ', 'g')"


_DIM = ", ".join(f"({st.q(k)}, {st.q(v)})" for k, v in lx.RATING_VERDICTS.items())


def _rule(index: int) -> str:
    return "case " + " ".join(
        f"when regexp_matches(rating_key, {st.q(r[0])}) then {st.q(r[1]) if index == 1 else str(r[2]) + '::double'}"
        for r in lx.RATING_RULES
    ) + " end"


def rated_ctes(source: str, out: str = "rated") -> str:
    return f"""
dim(key, listed) as (values {_DIM}),
r0 as (select s.*, {_bare('rating')} as rating_key from {source} s),
r1 as (select r0.*, listed, {_rule(1)} as rule_v, {_rule(2)} as rule_c from r0 left join dim on dim.key = r0.rating_key),
{out} as (select *, case when listed is not null then 'dictionary' when rule_v is not null then 'rule' else 'unknown' end as rating_source,
  coalesce(listed, rule_v, 'UNVERIFIED') as rated_verdict,
  case when listed = 'UNVERIFIED' then 0.8::double when listed is not null then 0.9::double else coalesce(rule_c, 0.3::double) end as rated_confidence,
  case when listed = 'UNVERIFIED' then concat('External rating indicates unverified: "', rating, '"')
    when listed is not null then concat('Mapped from external rating: "', rating, '" → ', listed)
    when rule_v is not null then concat('Fuzzy matched "', rating, '" → ', rule_v)
    else concat('Unknown rating "', rating, '", conservative UNVERIFIED') end as rating_note from r1)"""


def pct(expr: str) -> str:
    return f"printf('%.1f', {st.half_up(f'{expr} * 100.0::double', 1)})"


VERDICT_CTES = f"""{rated_ctes('best')},
verdicts0 as (select *, case when match_type = 'EXACT' then least(1.0::double, rated_confidence * total * 1.1::double)
   when match_type = 'LOW_CONFIDENCE' then rated_confidence * total * 0.7::double else rated_confidence * total end as adj from rated),
fc_verdicts as (select *, rated_verdict as verdict, case when rated_verdict = 'UNVERIFIED' and match_type = 'EXACT' then greatest(0.5::double, adj)
   else {st.half_up('adj', 3)} end as confidence,
  case when rated_verdict = 'UNVERIFIED' and match_type = 'EXACT' then concat(rating_note, ' (but strong text match)')
   else concat(rating_note, '. Source: ', publisher, ' (', url, '). Match: ', match_type, ' (', {pct('total')}, '% text similarity).') end as explanation
  from verdicts0)"""
FULL = f"{BASE}, {SCORED}, {VERDICT_CTES}"


# --------------------------------------------------------------- queries
@query("fc_candidates", f"{BASE} select claim_id, fc_id, rank, overlap from cand")
def fc_candidates(spark, sf_dir):
    keyed, _, found = _candidates(spark, sf_dir)
    return keyed.select("match_key", "claim_id").join(found, "match_key").select(
        "claim_id", "fc_id", "rank", "overlap"
    )


@query(
    "fc_jaccard",
    f"{BASE}, w as (select claim_id, fc_id, {word_list('normalized')} as a, {word_list('claim_text')} as b from pairs) "
    f"select claim_id, fc_id, {_jaccard('a', 'b')} as jaccard from w",
)
def fc_jaccard(spark, sf_dir):
    return _pairs(spark, sf_dir).select(
        "claim_id", "fc_id", jaccard(word_set(F.col("normalized")), word_set(F.col("claim_text"))).alias("jaccard")
    )


def _register_agreement(name: str, sql: str, index: int) -> None:
    @query(f"fc_{name}_agreement", f"{BASE} select claim_id, fc_id, {sql} as agreement from pairs")
    def run(spark, sf_dir):
        column = mt.agreement("mine", "theirs")[index]
        return _pairs(spark, sf_dir).select("claim_id", "fc_id", column.alias("agreement"))


for _i, (_n, _s) in enumerate(
    [("entity", ENTITY_SQL), ("number", NUMBER_SQL), ("date", DATE_SQL), ("negation", NEGATION_SQL)]
):
    _register_agreement(_n, _s, _i)


@query("fc_text_similarity", f"{BASE}, {SCORED} select claim_id, fc_id, {st.half_up('text', 9)} as text from agree")
def fc_text_similarity(spark, sf_dir):
    a, b = nm.collapse_spaces(F.col("normalized")), nm.collapse_spaces(F.col("claim_text"))
    pairs = _pairs(spark, sf_dir).select("claim_id", "fc_id", a.alias("a"), b.alias("b"))
    return pairs.select(
        "claim_id", "fc_id", round_half_up(mt.text_similarity(F.col("a"), F.col("b")), 9).alias("text")
    )


def scored(spark, sf_dir):
    keyed, checks, found = _candidates(spark, sf_dir)
    return keyed, checks, mt.score_candidates(mt.distinct_claims(keyed), checks, found)


@query(
    "fc_scores",
    f"{BASE}, {SCORED} select claim_id, fc_id, entity, number, date, negation, total, match_type from scored",
)
def fc_scores(spark, sf_dir):
    keyed, _, pairs = scored(spark, sf_dir)
    return keyed.select("match_key", "claim_id").join(pairs, "match_key").select(
        "claim_id", "fc_id", "entity", "number", "date", "negation", "total", "match_type"
    )


_DESCRIBE = f"""case match_type when 'EXACT' then concat('Exact match (', {pct('total')}, '% confidence)')
  when 'HIGH_CONFIDENCE' then concat('High confidence match (', {pct('total')}, '% confidence)')
  else concat('Low confidence match (', {pct('total')}, '% confidence) - needs verification') end"""


@query(
    "fc_best_match",
    f"""{BASE}, {SCORED} select claim_id, fc_id, total, match_type, match_type in ('EXACT', 'HIGH_CONFIDENCE') as reliable,
  {_DESCRIBE} as description from best""",
)
def fc_best_match(spark, sf_dir):
    keyed, checks, pairs = scored(spark, sf_dir)
    kind = F.col("match_type")
    return keyed.select("match_key", "claim_id").join(mt.best_matches(pairs), "match_key").select(
        "claim_id", "fc_id", "total", "match_type", mt.is_reliable(kind).alias("reliable"),
        mt.match_description(kind, F.col("total")).alias("description"),
    )


def verdict_rows(spark, sf_dir):
    keyed = keyed_claims(spark, sf_dir)
    matches = mt.match_fact_checks(keyed, fact_checks(spark, sf_dir))
    return keyed.select("match_key", "claim_id").join(rt.map_ratings(matches), "match_key")


@query(
    "fc_verdicts",
    f"{FULL} select claim_id, fc_id, match_type, total, verdict, confidence, explanation from fc_verdicts",
)
def fc_verdicts(spark, sf_dir):
    return verdict_rows(spark, sf_dir).select(
        "claim_id", "fc_id", "match_type", "total", "verdict", "confidence", "explanation"
    )


_HOW = "case match_type when 'EXACT' then 'exactly matches' when 'HIGH_CONFIDENCE' then 'closely matches' else 'partially matches' end"


@query(
    "fc_explanations",
    f"""{FULL} select claim_id, concat('This claim ', {_HOW}, ' a fact-check by ', publisher, ' which rated it "', rating, '" (', verdict,
  '). Match confidence: ', {pct('total')}, '%. Original claim: "', substring(claim_text, 1, 200),
  case when length(claim_text) > 200 then '...' else '' end, '"') as explanation,
  publisher as title, url, case match_type when 'EXACT' then 0.95::double when 'HIGH_CONFIDENCE' then 0.85::double else 0.7::double end as reliability,
  review_date as publish_date from fc_verdicts""",
)
def fc_explanations(spark, sf_dir):
    return verdict_rows(spark, sf_dir).select(
        "claim_id", mt.match_explanation(F.col("verdict")).alias("explanation"), F.col("sources")[0].alias("s")
    ).select("claim_id", "explanation", "s.title", "s.url", "s.reliability", "s.publish_date")


@query(
    "fc_conflicts",
    f"""{BASE}, {SCORED}, {rated_ctes("(select * from scored where match_type <> 'LOW_CONFIDENCE')")},
g as (select claim_id, count(*) as reliable, count(distinct rated_verdict) as verdicts, max(rated_verdict) as one from rated group by 1)
select claim_id, reliable, verdicts, verdicts > 1 as contested, case when verdicts > 1 then 'UNVERIFIED' else one end as verdict from g""",
)
def fc_conflicts(spark, sf_dir):
    keyed, checks, pairs = scored(spark, sf_dir)
    pairs = stored(pairs, "scored")
    rated = rt.rate(mt.named_checks(checks, pairs).select("fc_id", "review"), F.col("review.textual_rating")).select(
        "fc_id", F.col("rated_verdict").alias("verdict")
    )
    conflicts = mt.conflicting_fact_checks(pairs, rated)
    return keyed.select("match_key", "claim_id").join(conflicts, "match_key").drop("match_key")


@query(
    "match_metrics",
    f"""{BASE}, {SCORED}, j as (select c.claim_id, match_type from claims c left join best b using (claim_id))
select count(*) as claims, count_if(match_type is not null) as matched, count_if(match_type in ('EXACT', 'HIGH_CONFIDENCE')) as reliable,
  count_if(match_type is not null) / count(*)::double as match_rate, count_if(match_type is null) / count(*)::double as no_match_rate from j""",
)
def match_metrics(spark, sf_dir):
    keyed, _, pairs = scored(spark, sf_dir)
    return mt.match_metrics(keyed, mt.best_matches(pairs))


@query(
    "rating_map",
    f"""with {SQL_FACT_CHECKS}, u as (select rating, count(*) as uses from fact_checks group by 1), {rated_ctes('u')}
select rating, uses, rating_key, rating_source, rated_verdict, rated_confidence, rating_note from rated""",
)
def rating_map(spark, sf_dir):
    uses = fact_checks(spark, sf_dir).groupBy(F.col("review.textual_rating").alias("rating")).agg(
        F.count("*").alias("uses")
    )
    return rt.rate(uses, F.col("rating")).select(
        "rating", "uses", "rating_key", "rating_source", "rated_verdict", "rated_confidence", "rating_note"
    )


@query(
    "rating_unknown",
    f"""with {SQL_FACT_CHECKS}, u as (select rating, count(*) as uses from fact_checks group by 1), {rated_ctes('u')}
select rating, rating_key, uses from rated where rating_source = 'unknown'""",
)
def rating_unknown(spark, sf_dir):
    return rt.unknown_ratings(fact_checks(spark, sf_dir))


# every combination of rating, match class and agreement that documents can produce
_COMBOS = """
combos as (select doc_id, doc_id % 12 as rating_no, list_extract(['EXACT', 'HIGH_CONFIDENCE', 'LOW_CONFIDENCE'], doc_id % 3 + 1) as match_type,
  case doc_id % 3 when 0 then 1.0::double when 1 then 0.9::double else 0.7::double end as total,
  case when doc_id % 11 = 0 then 0.0::double else 1.0::double end as negation,
  case when doc_id % 13 = 0 then 0.0::double else 1.0::double end as number, source as publisher from documents)"""


@query(
    "verdict_confidence",
    f"""with {_COMBOS}, c2 as (select combos.*, list_extract({RATINGS!r}, rating_no + 1) as rating from combos),
{rated_ctes('c2')}, v as (select *, case when match_type = 'EXACT' then least(1.0::double, rated_confidence * total * 1.1::double)
   when match_type = 'LOW_CONFIDENCE' then rated_confidence * total * 0.7::double else rated_confidence * total end as adj from rated)
select doc_id, case when negation = 0 or number = 0 then 'UNVERIFIED' else rated_verdict end as verdict,
  case when negation = 0 or number = 0 then 0.1::double when rated_verdict = 'UNVERIFIED' and match_type = 'EXACT' then greatest(0.5::double, adj)
   else {st.half_up('adj', 3)} end as confidence from v""",
)
def verdict_confidence(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    rows = docs.select(
        "doc_id",
        F.expr("element_at(array('EXACT', 'HIGH_CONFIDENCE', 'LOW_CONFIDENCE'), cast(doc_id % 3 + 1 as int))").alias("match_type"),
        F.expr("case doc_id % 3 when 0 then 1.0D when 1 then 0.9D else 0.7D end").alias("total"),
        F.expr("case when doc_id % 11 = 0 then 0.0D else 1.0D end").alias("negation"),
        F.expr("case when doc_id % 13 = 0 then 0.0D else 1.0D end").alias("number"),
        F.struct(F.col("source").alias("name")).alias("publisher"),
        F.struct(
            F.lit("").alias("url"),
            F.element_at(F.array(*[F.lit(r) for r in RATINGS]), (F.col("doc_id") % 12 + 1).cast("int")).alias("textual_rating"),
        ).alias("review"),
    )
    return rt.combine(rt.rate(rows, F.col("review.textual_rating"))).select("doc_id", "verdict", "confidence")
