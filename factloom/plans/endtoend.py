"""From claim to verdict in one query: stored verdicts, fact-checks, evidence, model, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions.text import round_half_up
from ..operators import retrieval as rt
from . import sqltext as st
from .catalog import query
from .evidence import AS_OF, CONTEXT_CTES, document_pages
from .matching import FULL, keyed_claims
from .serving import AS_OF as STORED_AS_OF
from .serving import CACHE_SQL, now, stored_cache
from .tables import SQL_BENCH, fact_checks
from .verdicts import PARSE_SQL, RULE_SQL, SQL, grounding_sql

# stands in for a model: it votes by the directions of its context, and some outputs are broken
SAYS = """case when claim_id % 7 = 0 then 'I can not tell.' else concat('{"verdict": "', case when con > sup then 'FALSE' when sup > con then 'supported' when sup > 0 then 'MISLEADING' else 'UNVERIFIED' end,
  '", "confidence": 0.95, "summary": "Passages were compared.", "reasoning": "', case when sup = con then 'The passages lack context on this.' else 'According to most passages the study found this.' end,
  '", "supporting_evidence": ', sup_ids, ', "contradicting_evidence": ', con_ids, ', "contextual_evidence": []}') end"""


def voting_model(prompts, context):
    def ids(kind):
        chosen = F.sort_array(F.collect_list(F.when(F.col("direction") == kind, F.struct("context_no", "evidence_id"))))["evidence_id"]
        return F.concat(F.lit("["), F.array_join(F.transform(chosen, lambda i: F.concat(F.lit('"'), i, F.lit('"'))), ", "), F.lit("]"))

    votes = context.groupBy("claim_id").agg(
        F.count_if(F.col("direction") == "SUPPORTS").alias("sup"), F.count_if(F.col("direction") == "CONTRADICTS").alias("con"),
        ids("SUPPORTS").alias("sup_ids"), ids("CONTRADICTS").alias("con_ids"),
    )
    return prompts.join(votes, "claim_id").select("claim_id", F.expr(SAYS).alias("raw"))


_IDS = "concat('[', coalesce(string_agg(case when direction = '{}' then concat('\"', evidence_id, '\"') end, ', ' order by context_no), ''), ']')"
END_TO_END_SQL = f"""{FULL}, {CACHE_SQL}, {CONTEXT_CTES.replace(SQL_BENCH + ',', '', 1)},
live as (select * from cache where age <= 86400),
tier2e as (select h.claim_id, h.claim_hash, v.match_type in ('EXACT', 'HIGH_CONFIDENCE') as firm2, v.verdict as v2, v.confidence as c2, v.explanation as x2,
  from hashed h left join fc_verdicts v using (claim_id)),
opened as (select claim_id from tier2e t where claim_hash not in (select claim_hash from live) and (firm2 is not true or (v2 = 'UNVERIFIED' and c2 = 0))),
strength as (select claim_id, avg(relevance) as avg_relevance, avg(authority) as avg_authority from ranked group by 1),
pk as (select p.*, avg_relevance, avg_authority from packages p join opened using (claim_id) left join strength using (claim_id)),
votes as (select claim_id, any_value(p.status) as status, count_if(direction = 'SUPPORTS') as sup, count_if(direction = 'CONTRADICTS') as con,
  {_IDS.format('SUPPORTS')} as sup_ids, {_IDS.format('CONTRADICTS')} as con_ids from context c join pk p using (claim_id)
  where p.status not in {st.in_list(lx.NO_MODEL_STATUSES)} and p.items > 0 group by claim_id),
outs as (select claim_id, status, {SAYS} as raw from votes),
{PARSE_SQL.strip()}
ev as (select claim_id, context_no - 1 as i, excerpt, c.evidence_id, direction, host, relevance, authority, pk.items, pk.independent_domains, pk.avg_relevance, pk.avg_authority
  from context c join pk using (claim_id)),
{grounding_sql("any_value(items) as evidence_count, any_value(independent_domains) as domains, any_value(avg_relevance) as avg_relevance, any_value(avg_authority) as avg_authority").strip()}
{RULE_SQL[len(SQL):]},
third as (select p.claim_id, p.items, p.items = 0 or p.status in {st.in_list(lx.NO_MODEL_STATUSES)} as skipped, p.status, r.v1, r.f7, r.summary,
    r.verdict <> 'UNVERIFIED' and r.status in {st.in_list(lx.UNVERIFIED_STATUSES)} as forced from pk p left join ruled r using (claim_id)),
final as (select t.claim_id, case when l.claim_hash is not null then 'HIT' when th.claim_id is not null then 'MODEL' else 'MATCH' end as outcome,
  case when l.claim_hash is not null then l.verdict when th.claim_id is null then v2 when skipped or v1 is null then 'UNVERIFIED' else v1 end as verdict,
  case when l.claim_hash is not null then l.confidence when th.claim_id is null then c2 when skipped or v1 is null then 0.0::double else f7 end as confidence,
  case when l.claim_hash is not null then 'stored' when th.claim_id is null then x2 when items = 0 then 'No evidence available for this claim.'
    when skipped then concat('Insufficient evidence: ', status) when v1 is null then 'Invalid model output' when forced then concat('Retrieval status: ', status) else summary end as explanation,
  case when l.claim_hash is not null then 'FACT_CHECK_API' when th.claim_id is null then 'FACT_CHECK_API' else 'AI_RAG' end as source_tier,
  case when l.claim_hash is not null then 0 when th.claim_id is null then 1 else items end as n_sources
  from tier2e t left join live l using (claim_hash) left join third th using (claim_id))"""


@query(
    "end_to_end",
    f"""{END_TO_END_SQL}
select claim_id, outcome, verdict, {st.half_up('confidence', 6)} as confidence, explanation, source_tier, n_sources::integer as n_sources, timestamp '{STORED_AS_OF}' as verified_at from final""",
)
def end_to_end(spark, sf_dir):
    """Every benchmark claim; fact-checks and pages are searched for what is still open only."""
    result = rt.check_claims(
        keyed_claims(spark, sf_dir), stored_cache(spark, sf_dir), fact_checks(spark, sf_dir), document_pages(spark, sf_dir), voting_model, now(), AS_OF
    )
    return result.select(
        "claim_id", "outcome", "verdict", round_half_up(F.col("confidence"), 6).alias("confidence"), "explanation", "source_tier", F.size("sources").alias("n_sources"), "verified_at"
    )
