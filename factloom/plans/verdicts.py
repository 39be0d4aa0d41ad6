"""Queries over model outputs: parsing, grounding, confidence, rules, final verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions.text import find_all, ratio, round_half_up
from ..operators import grounding as gr
from . import sqltext as st
from .catalog import query
from .tables import read

# every document is a package: its lines are the evidence, its output is written from them
STATUS = ["SUCCESS", "SUCCESS", "CONFLICTING_EVIDENCE", "WEAK_EVIDENCE", "SUCCESS", "NO_RESULTS", "TIMEOUT", "SUCCESS", "SUCCESS"]
SAID = ["SUPPORTED", "false", "MISLEADING", "FALSE", "UNVERIFIED", "MAYBE"]
REASONING = """concat('The study found ', cast(claim_id % 120 as varchar(9)), ' percent of cases in ', cast(1990 + claim_id % 40 as varchar(9)), '. According to ',
  replace(line1, '"', ''), ' most agree. In ', cast(n_chars as varchar(9)), case when claim_id % 2 = 0 then ' reports there is not any doubt by John Smith.' else ' reports cases rise!' end)"""
RAW = """concat(case when claim_id % 5 = 0 then '```json' else '' end, '{"verdict": "', said, '", "confidence": ', case when claim_id % 13 = 0 then '1.5' else concat(cast(claim_id % 11 as varchar(9)), 'e-1') end,
  ', "summary": "', case when claim_id % 19 = 0 then '' else concat('Seen in ', cast(2000 + claim_id % 25 as varchar(9))) end, '", "reasoning": "', reasoning,
  '", "supporting_evidence": ["E1", "E7"], "contradicting_evidence": ["E2"], "contextual_evidence": []', case when claim_id % 17 = 0 then '' else '}' end, case when claim_id % 5 = 0 then '```' else '' end)"""


def evidence_lines(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("claim_id"), "text")
    lines = docs.select("claim_id", F.posexplode(find_all(F.col("text"), r"[^\n ](?:[^\n]*[^\n ])?")).alias("i", "excerpt"))
    return lines.select(
        "claim_id", (F.col("i") + 1).alias("context_no"), F.concat(F.lit("E"), (F.col("i") + 1).cast("string")).alias("evidence_id"),
        F.expr("element_at(array('SUPPORTS','CONTRADICTS','CONTEXTUAL','UNCLEAR'), cast((claim_id + i) % 4 + 1 as int))").alias("direction"),
        "excerpt", F.expr("concat('h', cast((claim_id + i) % 3 as string))").alias("host"),
        F.expr("cast((claim_id * 7 + i * 13) % 100 as double) / 100").alias("relevance"),
        F.expr("cast((claim_id * 3 + i * 5) % 100 as double) / 100").alias("authority"),
    )


def _pick(values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("claim_id") % len(values) + 1).cast("int"))


def outputs(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("claim_id"), "text", "n_chars")
    first = F.coalesce(F.get(find_all(F.col("text"), r"[^\n ](?:[^\n]*[^\n ])?"), F.lit(0)), F.lit(""))
    return (
        docs.select("claim_id", "n_chars", first.alias("line1"), _pick(SAID).alias("said"), _pick(STATUS).alias("status"))
        .withColumn("reasoning", F.expr(REASONING))
        .select("claim_id", "status", F.expr(RAW).alias("raw"))
    )


def grounded(spark, sf_dir):
    parsed = gr.parse_outputs(outputs(spark, sf_dir)).filter("valid")
    return gr.ground(parsed, gr.evidence_profile(evidence_lines(spark, sf_dir)))


_TEXT = "concat_ws(' ', reasoning, summary)"
_NUM = st.find_unicode("{}", r"\d+(?:\.\.\d+)?").replace("{}", "@@")
_NAME = st.find_unicode("@@", r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*")
_YEAR = st.find_unicode("@@", r"(?:19|20)\d{2}")


def _in(finder: str, text: str) -> str:
    return f"list_distinct({finder.replace('@@', text)})"


_FACTUAL = f"""list_filter(list_transform(string_split_regex(reasoning, '[.!?]+'), lambda s: trim(s)),
  lambda s: length(s) >= 20 and regexp_matches(lower(s), {st.q('|'.join(lx.FACTUAL_CUES))}))"""
_NEG = r"(?:^|[^\p{L}\p{N}_])(?:not|no|never|neither|nor|without|absence of|lack of)(?:[^\p{L}\p{N}_]|$)"
#: outputs (claim_id, status, raw) -> parsed
PARSE_SQL = f"""
j0 as (select claim_id, status, regexp_replace(regexp_replace(trim(raw), '^(?:```json|```)', ''), '```$', '') as body from outs),
j1 as (select *, json_valid(body) as good, case when json_valid(body) then body::json end as o from j0),
j2 as (select claim_id, status, good, upper(o->>'verdict') as verdict, (o->>'confidence')::double as confidence, o->>'summary' as summary,
  o->>'reasoning' as reasoning, (o->'supporting_evidence')::varchar[] as supporting, (o->'contradicting_evidence')::varchar[] as contradicting from j1),
parsed as (select *, coalesce(good and verdict in {st.in_list(lx.VERDICTS + ['AI_ERROR'])} and confidence between 0 and 1 and length(summary) > 0 and length(reasoning) > 0, false) as valid from j2),"""


def grounding_sql(counts: str = "count(*) as evidence_count, count(distinct host) as domains, avg(relevance) as avg_relevance, avg(authority) as avg_authority") -> str:
    """parsed and ev -> ground; ``counts`` are the package's counts, by default those of its context."""
    return f"""
prof0 as (select claim_id, {counts},
  list(evidence_id order by i) as ids, string_agg(excerpt, ' ' order by i) as txt, list(struct_pack(id := evidence_id, d := direction, x := excerpt) order by i) as its from ev group by claim_id),
prof as (select *, {_in(_NUM, 'txt')} as e_numbers, {_in(_NAME, 'txt')} as e_names, {_in(_YEAR, 'txt')} as e_years from prof0),
g0 as (select p.*, coalesce(evidence_count, 0) as evidence_count, coalesce(domains, 0) as domains, avg_relevance, avg_authority, coalesce(ids, []) as ids,
  coalesce(e_numbers, []) as e_numbers, coalesce(e_names, []) as e_names, coalesce(e_years, []) as e_years, coalesce(its, []) as its,
  list_concat(supporting, contradicting) as cites from parsed p left join prof using (claim_id) where valid),
g1 as (select *, list_filter(cites, lambda c: not list_contains(ids, c)) as invalid_ids,
  list_filter({_in(_NUM, _TEXT)}, lambda n: n not in {st.in_list(lx.IGNORED_NUMBERS)} and len(list_filter(e_numbers, lambda e: e = n or (e::double <> 0 and abs(n::double - e::double) / e::double < 0.1::double))) = 0) as bad_numbers,
  list_filter({_in(_NAME, _TEXT)}, lambda n: length(n) > 3 and lower(n) not in {st.in_list(lx.IGNORED_ENTITIES)}
    and len(list_filter(e_names, lambda e: contains(lower(e), lower(n)) or contains(lower(n), lower(e)))) = 0) as bad_names,
  case when contains(lower(reasoning), 'no') then [] else list_transform(list_filter(its, lambda t: regexp_matches(lower(t.x), '{_NEG}')), lambda t: t.id) end as bad_negations,
  list_filter({_in(_YEAR, _TEXT)}, lambda y: not list_contains(e_years, y)) as bad_years, {_FACTUAL} as factual_s,
  list_transform(list_filter(its, lambda t: (list_contains(supporting, t.id) and t.d = 'CONTRADICTS') or (list_contains(contradicting, t.id) and t.d = 'SUPPORTS')), lambda t: t.id) as mismatched from g0),
ground as (select *, list_filter(factual_s, lambda s: len({_in(_NUM, 's')}) > 0 and not list_has_any({_in(_NUM, 's')}, e_numbers) and not list_has_any({_in(_NAME, 's')}, e_names)) as unsupported from g1)"""


SQL = f"""
docs0 as (select doc_id as claim_id, n_chars, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as ls from documents),
docs1 as (select *, coalesce(ls[1], '') as line1, list_extract({st.sql_list(SAID)}, claim_id % {len(SAID)} + 1) as said,
  list_extract({st.sql_list(STATUS)}, claim_id % {len(STATUS)} + 1) as status from docs0),
docs2 as (select *, {REASONING} as reasoning from docs1),
outs as (select claim_id, status, {RAW} as raw from docs2),
{PARSE_SQL.strip()}
items as (select claim_id, unnest(range(len(ls))) as i, unnest(ls) as excerpt from docs0),
ev as (select *, concat('E', i + 1) as evidence_id, list_extract(['SUPPORTS','CONTRADICTS','CONTEXTUAL','UNCLEAR'], (claim_id + i) % 4 + 1) as direction,
  concat('h', (claim_id + i) % 3) as host, ((claim_id * 7 + i * 13) % 100)::double / 100 as relevance, ((claim_id * 3 + i * 5) % 100)::double / 100 as authority from items),
{grounding_sql().strip()}"""


def _sorted(expr: str) -> str:
    return f"array_to_string(list_sort({expr}), '|')"


def _sorted_col(name: str):
    return F.array_join(F.sort_array(name), "|").alias(name)


@query("model_parse", f"with {SQL} select claim_id, valid, case when valid then verdict end as verdict, case when valid then confidence end as confidence from parsed")
def model_parse(spark, sf_dir):
    df = gr.parse_outputs(outputs(spark, sf_dir))
    return df.select("claim_id", "valid", *[F.when(F.col("valid"), F.col(c)).alias(c) for c in ("verdict", "confidence")])


@query(
    "citation_filter",
    f"with {SQL} select claim_id, array_to_string(list_filter(supporting, lambda c: list_contains(ids, c)), '|') as supporting, array_to_string(invalid_ids, '|') as invalid_ids, len(invalid_ids) = 0 as grounded from ground",
)
def citation_filter(spark, sf_dir):
    return grounded(spark, sf_dir).select(
        "claim_id", F.array_join("supporting", "|").alias("supporting"), F.array_join("invalid_ids", "|").alias("invalid_ids"), "grounded"
    )


def _register_finding(name: str, spark_col: str, sql_col: str) -> None:
    @query(name, f"with {SQL} select claim_id, {_sorted(sql_col)} as {spark_col} from ground")
    def run(spark, sf_dir):
        return grounded(spark, sf_dir).select("claim_id", _sorted_col(spark_col))


for _n, _c in [
    ("numeric_grounding", "bad_numbers"), ("entity_grounding", "bad_names"), ("negation_grounding", "bad_negations"),
    ("year_grounding", "bad_years"), ("unsupported_sentences", "unsupported"),
]:
    _register_finding(_n, _c, _c)


@query("direction_mismatch", f"with {SQL} select claim_id, {_sorted('mismatched')} as ids from ground")
def direction_mismatch(spark, sf_dir):
    ids = F.transform("mismatches", lambda m: F.split_part(m, F.lit(" "), F.lit(1)))
    return grounded(spark, sf_dir).select("claim_id", F.array_join(F.sort_array(ids), "|").alias("ids"))


_CEIL = "case status " + " ".join(f"when '{k}' then {v}::double" for k, v in lx.STATUS_CEILING.items()) + " else 0.5::double end"
CAP_SQL = f"""{SQL},
capped as (select *, greatest(0.0::double, least(1.0::double, confidence, case when evidence_count > 0
  then greatest({_CEIL} * ((avg_relevance + avg_authority) / 2.0::double), 0.1::double) else {_CEIL} end)) as cap from ground)"""
RULE_SQL = f"""{CAP_SQL},
t1 as (select *, case when evidence_count = 0 or status in {st.in_list(lx.UNVERIFIED_STATUSES)} then 'UNVERIFIED' else verdict end as v1,
  case when verdict <> 'UNVERIFIED' and (evidence_count = 0 or status in {st.in_list(lx.UNVERIFIED_STATUSES)}) then 0.0::double else cap end as f1 from capped),
t2 as (select *, v1 in ('SUPPORTED', 'FALSE') as firm, case when status = 'CONFLICTING_EVIDENCE' and v1 in ('SUPPORTED', 'FALSE') and f1 > 0.7 then least(f1, 0.6::double) else f1 end as f2 from t1),
t3 as (select *, case when firm and f2 >= 0.9 and evidence_count < 3 then least(f2, 0.9::double - 0.1::double) else f2 end as f3 from t2),
t4 as (select *, case when firm and f3 >= 0.8 and evidence_count < 2 then least(f3, 0.8::double - 0.1::double) else f3 end as f4 from t3),
t5 as (select *, case when firm and f4 >= 0.7 and evidence_count < 2 then least(f4, 0.7::double - 0.1::double) else f4 end as f5 from t4),
t6 as (select *, case when firm and f5 >= 0.6 and evidence_count < 1 then least(f5, 0.6::double - 0.1::double) else f5 end as f6 from t5),
ruled as (select *, case when firm and domains < 2 and f6 > 0.7 then least(f6, 0.65::double) else f6 end as f7 from t6)"""


@query("confidence_cap", f"with {CAP_SQL} select claim_id, {st.half_up('cap', 6)} as confidence from capped")
def confidence_cap(spark, sf_dir):
    return grounded(spark, sf_dir).select("claim_id", round_half_up(gr.capped_confidence(), 6).alias("confidence"))


@query("verdict_rules", f"with {RULE_SQL} select claim_id, v1 as verdict, {st.half_up('f7', 6)} as confidence from ruled")
def verdict_rules(spark, sf_dir):
    df = grounded(spark, sf_dir).withColumn("confidence", gr.capped_confidence())
    return gr.apply_rules(df).select("claim_id", "verdict", round_half_up(F.col("confidence"), 6).alias("confidence"))


def _note(column: str, before: str, after: str) -> str:
    return f"list_transform({column}, lambda x: concat({st.q(before)}, x, {st.q(after)}))"


_NO_MODEL = f"n is null or status in {st.in_list(lx.NO_MODEL_STATUSES)}"
_COUNT_NOTES = ", ".join(
    f"case when firm and f{k + 2} >= {t} and evidence_count < {least} then concat('RULE: Confidence ', printf('%.1f', f{k + 2}), ' requires ≥{least} evidence items, have ', evidence_count) end"
    for k, (t, least) in enumerate(lx.EVIDENCE_COUNT_RULES)
)
_STATUS_FORCED = f"verdict <> 'UNVERIFIED' and evidence_count > 0 and status in {st.in_list(lx.UNVERIFIED_STATUSES)}"
NOTES_SQL = f"""list_filter(list_concat({_note('invalid_ids', "ERROR: Cited evidence ID '", "' not found in context")},
  {_note('bad_numbers', "WARNING: Number '", "' in reasoning not found in evidence")}, {_note('bad_names', "WARNING: Entity '", "' in reasoning not found in evidence")},
  {_note('bad_negations', "WARNING: Evidence ", " contains negation but reasoning may not reflect it")}, {_note('bad_years', "WARNING: Year '", "' mentioned in reasoning but not found in evidence")},
  list_transform(unsupported, lambda x: concat('WARNING: Potentially unsupported factual claim in reasoning: ', substring(x, 1, 100), '...')),
  list_transform(its, lambda t: case when list_contains(supporting, t.id) and t.d = 'CONTRADICTS' then concat('WARNING: Evidence ', t.id, ' classified as CONTRADICTS but cited as SUPPORTS') end),
  list_transform(its, lambda t: case when list_contains(contradicting, t.id) and t.d = 'SUPPORTS' then concat('WARNING: Evidence ', t.id, ' classified as SUPPORTS but cited as CONTRADICTS') end),
  [case when {_STATUS_FORCED} then concat('RULE: Retrieval status ', status, ' forces UNVERIFIED') end,
   case when status = 'CONFLICTING_EVIDENCE' and v1 in ('SUPPORTED', 'FALSE') and f1 > 0.7 then 'RULE: Conflicting evidence with high confidence, reducing confidence' end,
   {_COUNT_NOTES},
   case when v1 = 'MISLEADING' and not regexp_matches(lower(reasoning), {st.q('|'.join(lx.MISLEADING_CUES))}) then 'RULE: MISLEADING verdict should explain missing context/exaggeration' end,
   case when firm and domains < 2 and f6 > 0.7 then 'RULE: Single domain with high confidence, reducing confidence' end]), lambda x: x is not null)"""


@query(
    "validated_verdicts",
    f"""with {RULE_SQL}, every as (select d.claim_id, d.status, p.evidence_count as n, r.v1, r.f7, len(r.invalid_ids) = 0 as grounded, r.claim_id is not null as ok, r.validation,
    case when r.forced then concat('Retrieval status: ', d.status) else r.summary end as summary,
    case when r.forced then concat(r.reasoning, ' [Forced UNVERIFIED: Retrieval status: ', d.status, ']') else r.reasoning end as reasoning
  from docs1 d left join prof p using (claim_id) left join (select *, {_STATUS_FORCED} as forced,
    array_to_string(list_sort(list_transform({NOTES_SQL}, lambda w: concat('[VALIDATION] ', w))), chr(10)) as validation from ruled) r using (claim_id))
select claim_id, case when {_NO_MODEL} then 'UNVERIFIED' when ok then v1 else 'AI_ERROR' end as verdict,
  case when {_NO_MODEL} or not ok then 0.0::double else {st.half_up('f7', 6)} end as confidence,
  case when {_NO_MODEL} or not ok then null else grounded end as grounded,
  case when n is null then 'No evidence available for this claim.' when {_NO_MODEL} then concat('Insufficient evidence: ', status) when ok then summary else 'Invalid model output' end as summary,
  case when {_NO_MODEL} or not ok then '' else reasoning end as reasoning,
  case when {_NO_MODEL} or not ok then '' else validation end as validation from every""",
)
def validated_verdicts(spark, sf_dir):
    out = outputs(spark, sf_dir)
    final = gr.validate_verdicts(out.select("claim_id", "raw"), out.select("claim_id", "status"), evidence_lines(spark, sf_dir))
    notes = F.array_join(F.array_sort(F.split("validation", "\n")), "\n")
    return final.select(
        "claim_id", "verdict", round_half_up(F.col("confidence"), 6).alias("confidence"), "grounded", "summary", "reasoning", notes.alias("validation")
    )


@query(
    "grounding_rate",
    f"""with {SQL} select status, count(*) as outputs, avg(case when len(invalid_ids) = 0 then 1 else 0 end) as grounding_rate,
  sum(len(factual_s))::bigint as factual, sum(len(unsupported))::bigint as unsupported, sum(len(unsupported)) / nullif(sum(len(factual_s)), 0)::double as unsupported_rate from ground group by 1""",
)
def grounding_rate(spark, sf_dir):
    bad = F.size("unsupported")
    return grounded(spark, sf_dir).groupBy("status").agg(
        F.count("*").alias("outputs"), F.avg(F.col("grounded").cast("int")).alias("grounding_rate"),
        F.sum("factual").alias("factual"), F.sum(bad).alias("unsupported"), ratio(F.sum(bad), F.sum("factual")).alias("unsupported_rate"),
    )


@query(
    "citation_accuracy",
    f"""with {SQL} select status, sum(len(cites))::bigint as cited, sum(len(cites) - len(invalid_ids))::bigint as valid,
  (sum(len(cites)) - sum(len(invalid_ids))) / sum(len(cites))::double as accuracy, avg(case when len(invalid_ids) > 0 then 1 else 0 end) as hallucinated_rate from ground group by 1""",
)
def citation_accuracy(spark, sf_dir):
    return grounded(spark, sf_dir).groupBy("status").agg(
        F.sum("cited").alias("cited"), F.sum("cited_valid").alias("valid"), ratio(F.sum("cited_valid"), F.sum("cited")).alias("accuracy"),
        F.avg((F.size("invalid_ids") > 0).cast("int")).alias("hallucinated_rate"),
    )


@query(
    "outcome_classes",
    f"""with {SQL} select case when not good then 'INVALID_JSON' when verdict not in {st.in_list(lx.VERDICTS)} then 'INVALID_VERDICT' when confidence not between 0 and 1 then 'INVALID_CONFIDENCE'
  when length(summary) = 0 then 'EMPTY_TEXT' else 'OK' end as outcome, count(*) as n from parsed group by 1""",
)
def outcome_classes(spark, sf_dir):
    df = gr.parse_outputs(outputs(spark, sf_dir))
    kind = (
        F.when(F.col("summary").isNull(), "INVALID_JSON")
        .when(~F.col("verdict").isin(lx.VERDICTS), "INVALID_VERDICT")
        .when(~F.col("confidence").between(0, 1), "INVALID_CONFIDENCE")
        .when(F.length("summary") == 0, "EMPTY_TEXT")
        .otherwise("OK")
    )
    return df.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))
