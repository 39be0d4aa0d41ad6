"""Queries of the evaluation job."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions.text import round_half_up
from ..operators import evaluation as evl
from ..operators import matching as mt
from ..operators import normalize as nm
from ..operators.ranking import retrieval_status
from . import sqltext as st
from .catalog import query
from .matching import DATE_SQL, NUMBER_SQL, _candidates, BASE
from .tables import SQL_ALL, SQL_LABELLED, all_claims, labelled, read

# transcripts: a deterministic misreading of every claim
NOISY = "translate(claim, 'oielas', '01316')"


@query(
    "cer",
    f"""with {SQL_ALL} select pos % 3 as category, sum(levenshtein(claim, {NOISY}))::bigint as edits, sum(length(claim))::bigint as characters,
  sum(levenshtein(claim, {NOISY})) / sum(length(claim))::double as cer from claims group by 1""",
)
def cer(spark, sf_dir):
    df = all_claims(spark, sf_dir).select((F.col("pos") % 3).alias("category"), "claim", F.expr(NOISY).alias("read"))
    return evl.cer(df, "claim", "read", "category")


@query("wer")
def wer(spark, sf_dir):
    df = all_claims(spark, sf_dir).select((F.col("pos") % 3).alias("category"), "claim", F.expr(NOISY).alias("read"))
    return evl.wer(df, "claim", "read", "category")


@query(
    "wer_substitutions",
    f"""with {SQL_ALL}, w as (select pos % 3 as category, string_split(claim, ' ') as a, string_split({NOISY}, ' ') as b from claims)
select category, sum(len(list_filter(range(1, len(a) + 1), lambda i: a[i] <> b[i])))::bigint as changed, sum(len(list_filter(a, lambda x: x <> '')))::bigint as words from w group by 1""",
)
def wer_substitutions(spark, sf_dir):
    """Words changed in place: what the word error rate must equal when no word is lost."""
    df = all_claims(spark, sf_dir).select(
        (F.col("pos") % 3).alias("category"), F.split("claim", " ").alias("a"), F.split(F.expr(NOISY), " ").alias("b")
    )
    changed = F.size(F.filter(F.zip_with("a", "b", lambda x, y: x != y), lambda d: d))
    return df.groupBy("category").agg(
        F.sum(changed).alias("changed"), F.sum(F.size(F.filter("a", lambda x: x != ""))).alias("words")
    )


@query(
    "noise_robustness",
    f"""with {SQL_ALL}, noisy as (select claim as original, pos % 3 as kind, case pos % 3 when 0 then concat('  ', replace(claim, ' ', chr(10)), ' ')
  when 1 then concat(claim, '!!!') else {NOISY} end as noise from claims), {st.normalized_ctes('noisy', 'noise', 'na')},
mid as (select kind, original, normalized as noisy_norm from na), {st.normalized_ctes('mid', 'original', 'nb', 'z')}
select kind, count(*) as claims, count_if(sha256(normalized) = sha256(noisy_norm)) as recovered from nb group by 1""",
)
def noise_robustness(spark, sf_dir):
    kind = F.col("pos") % 3
    spaced = F.concat(F.lit("  "), F.replace("claim", F.lit(" "), F.lit("\n")), F.lit(" "))
    noisy = F.when(kind == 0, spaced).when(kind == 1, F.concat("claim", F.lit("!!!"))).otherwise(F.expr(NOISY))
    df = all_claims(spark, sf_dir).select("claim", kind.alias("kind"), noisy.alias("noisy"))
    clean = nm.normalize_claims(df).select("kind", "noisy", nm.claim_hash(F.col("normalized")).alias("a"))
    both = nm.normalize_claims(clean, "noisy").withColumn("b", nm.claim_hash(F.col("normalized")))
    return both.groupBy("kind").agg(F.count("*").alias("claims"), F.count_if(F.col("a") == F.col("b")).alias("recovered"))


# ------------------------------------------------------------- retrieval
RETRIEVAL = f"""{BASE},
ranked as (select claim_id, fc_id as item, rank, publisher as host, overlap from cand join fact_checks using (fc_id)),
relevant as (select claim_id, fc_id as item, 1 + (fc_id % 3) as grade from cand where overlap >= 0.8 or fc_id % 5 = 0)"""


def retrieval(spark, sf_dir):
    """Search results as ranking; strongly overlapping or every fifth candidate as truth."""
    keyed, checks, found = _candidates(spark, sf_dir)
    rows = keyed.select("match_key", "claim_id").join(found, "match_key").join(
        mt.named_checks(checks, found).select("fc_id", F.col("publisher.name").alias("host")), "fc_id"
    )
    ranked = rows.select("claim_id", F.col("fc_id").alias("item"), "rank", "host", "overlap")
    truth = ranked.filter("overlap >= 0.8 or item % 5 = 0").select("claim_id", "item", (1 + F.col("item") % 3).alias("grade"))
    return ranked, truth


@query(
    "precision_recall_k",
    f"""{RETRIEVAL}, t as (select claim_id, count(*) as truth from relevant group by 1),
h as (select claim_id, count(*) as hits from ranked join relevant using (claim_id, item) where rank <= 3 group by 1)
select claim_id, coalesce(hits, 0) as hits, truth, coalesce(hits, 0) / 3.0::double as precision, coalesce(hits, 0) / truth::double as recall from t left join h using (claim_id)""",
)
def precision_recall_k(spark, sf_dir):
    ranked, truth = retrieval(spark, sf_dir)
    return evl.precision_recall_at_k(ranked, truth.select("claim_id", "item"), 3)


@query(
    "mrr",
    f"""{RETRIEVAL}, f as (select claim_id, min(rank) as first from ranked join relevant using (claim_id, item) group by 1)
select count(*) as claims, {st.half_up('avg(coalesce(1.0::double / first, 0.0::double))', 9)} as mrr from (select distinct claim_id from relevant) left join f using (claim_id)""",
)
def mrr(spark, sf_dir):
    ranked, truth = retrieval(spark, sf_dir)
    return evl.mrr(ranked, truth.select("claim_id", "item")).withColumn("mrr", round_half_up(F.col("mrr"), 9))


@query(
    "ndcg",
    f"""{RETRIEVAL}, i as (select claim_id, sum((pow(2.0::double, grade) - 1) / log2(place + 1)) as ideal from (select *, row_number() over (partition by claim_id order by grade desc, item) as place from relevant) where place <= 5 group by 1),
d as (select claim_id, sum((pow(2.0::double, grade) - 1) / log2(rank + 1)) as dcg from ranked join relevant using (claim_id, item) where rank <= 5 group by 1)
select claim_id, {st.half_up('coalesce(dcg, 0.0::double) / ideal', 6)} as ndcg from i left join d using (claim_id)""",
)
def ndcg(spark, sf_dir):
    ranked, truth = retrieval(spark, sf_dir)
    return evl.ndcg(ranked, truth, 5).withColumn("ndcg", round_half_up(F.col("ndcg"), 6))


@query(
    "ranking_order",
    f"""{RETRIEVAL}, l as (select *, lag(overlap) over (partition by claim_id order by rank) < overlap as wrong from ranked)
select claim_id, count(*) as items, count(distinct host) as hosts, count_if(coalesce(wrong, false)) as inversions from l group by 1""",
)
def ranking_order(spark, sf_dir):
    return evl.ranking_inversions(retrieval(spark, sf_dir)[0], "overlap")


@query(
    "number_consistency",
    f"{BASE} select case when {NUMBER_SQL} = 0 then 'conflict' when {NUMBER_SQL} = 0.5 then 'unknown' else 'agree' end as numbers, case when {DATE_SQL} = 0 then 'conflict' when {DATE_SQL} = 0.5 then 'unknown' else 'agree' end as dates, count(*) as n from pairs group by all",
)
def number_consistency(spark, sf_dir):
    from .matching import _pairs

    pairs = _pairs(spark, sf_dir).select(*mt.agreement("mine", "theirs"))

    def word(c):
        return F.when(F.col(c) == 0, "conflict").when(F.col(c) == 0.5, "unknown").otherwise("agree")

    return pairs.groupBy(word("number").alias("numbers"), word("date").alias("dates")).agg(F.count("*").alias("n"))


@query(
    "evidence_conflicts",
    """with c as (select lang, source, count(*) as items, count_if(doc_id % 4 = 0) as s, count_if(doc_id % 4 = 1) as o from documents group by all)
select lang, source, case when items = 0 then 'NO_USABLE_EVIDENCE' when s >= 2 and o >= 2 then 'CONFLICTING_EVIDENCE' when s > 0 or o > 0 then 'SUCCESS' else 'WEAK_EVIDENCE' end as status from c""",
)
def evidence_conflicts(spark, sf_dir):
    c = read(spark, sf_dir, "documents").groupBy("lang", "source").agg(
        F.count("*").alias("items"), F.count_if(F.col("doc_id") % 4 == 0).alias("s"), F.count_if(F.col("doc_id") % 4 == 1).alias("o")
    )
    return c.select("lang", "source", retrieval_status(F.col("items"), F.col("s"), F.col("o")).alias("status"))


# -------------------------------------------------------------- verdicts
@query("accuracy", f"with {SQL_LABELLED} select count(*) as n, avg(case when truth = pred then 1 else 0 end) as accuracy from labelled")
def accuracy(spark, sf_dir):
    df = labelled(spark, sf_dir)
    return df.agg(F.count("*").alias("n"), F.avg((F.col("truth") == F.col("pred")).cast("int")).alias("accuracy"))


@query(
    "class_f1",
    f"""with {SQL_LABELLED}, c as (select unnest({st.sql_list(lx.VERDICTS)}) as verdict),
k as (select verdict, (select count(*) from labelled where truth = verdict) as support, (select count(*) from labelled where pred = verdict) as predicted,
  (select count(*) from labelled where truth = verdict and pred = verdict) as tp from c)
select verdict, support, predicted, tp / nullif(predicted, 0)::double as precision, tp / nullif(support, 0)::double as recall, 2 * tp / (support + predicted)::double as f1 from k""",
)
def class_f1(spark, sf_dir):
    return evl.class_report(labelled(spark, sf_dir))


@query(
    "macro_f1",
    f"""with {SQL_LABELLED}, k as (select verdict, (select count(*) from labelled where truth = verdict) as s, (select count(*) from labelled where pred = verdict) as p,
  (select count(*) from labelled where truth = verdict and pred = verdict) as tp from (select unnest({st.sql_list(lx.VERDICTS)}) as verdict))
select {st.half_up('avg(2 * tp / (s + p)::double)', 9)} as macro_f1 from k""",
)
def macro_f1(spark, sf_dir):
    return evl.class_report(labelled(spark, sf_dir)).agg(round_half_up(F.avg("f1"), 9).alias("macro_f1"))


@query(
    "confusion",
    f"with {SQL_LABELLED} select truth, {', '.join(f'''count_if(pred = '{v}') as "{v}"''' for v in lx.VERDICTS)} from labelled group by 1",
)
def confusion(spark, sf_dir):
    return evl.confusion(labelled(spark, sf_dir))


@query(
    "by_domain_cube",
    f"""with {SQL_LABELLED} select coalesce(domain, 'ALL') as domain, coalesce(difficulty, 'ALL') as difficulty, count(*) as n,
  avg(case when truth = pred then 1 else 0 end) as accuracy from labelled group by cube (domain, difficulty)""",
)
def by_domain_cube(spark, sf_dir):
    return evl.accuracy_cube(labelled(spark, sf_dir), "domain", "difficulty")


@query(
    "calibration",
    f"""with {SQL_LABELLED} select least(floor(confidence * 10), 9)::bigint as bin, count(*) as n, {st.half_up('avg(confidence)', 9)} as avg_confidence,
  avg(case when truth = pred then 1 else 0 end) as accuracy from labelled group by 1""",
)
def calibration(spark, sf_dir):
    return evl.calibration(labelled(spark, sf_dir)).withColumn("avg_confidence", round_half_up(F.col("avg_confidence"), 9))


@query(
    "brier",
    f"""with {SQL_LABELLED}, b as (select least(floor(confidence * 10), 9) as bin, count(*) as n, sum(confidence) as sc, sum(case when truth = pred then 1.0::double else 0.0::double end) as sr,
  sum(pow(confidence - case when truth = pred then 1.0::double else 0.0::double end, 2)) as sq from labelled group by 1)
select {st.half_up('sum(abs(sc - sr)) / sum(n)', 9)} as ece, {st.half_up('sum(sq) / sum(n)', 9)} as brier from b""",
)
def brier(spark, sf_dir):
    df = evl.ece_brier(labelled(spark, sf_dir))
    return df.select(*[round_half_up(F.col(c), 9).alias(c) for c in df.columns])


@query(
    "kappa",
    f"""with {SQL_LABELLED}, t as (select count(*) as n, count_if(truth = pred) as same from labelled),
e as (select sum(a.n * b.n) as chance from (select truth as c, count(*) as n from labelled group by 1) a join (select pred as c, count(*) as n from labelled group by 1) b using (c))
select n, same / n::double as observed, chance::double / (n * n)::double as expected, {st.half_up('(same / n::double - chance::double / (n * n)::double) / (1 - chance::double / (n * n)::double)', 9)} as kappa from t, e""",
)
def kappa(spark, sf_dir):
    return evl.cohen_kappa(labelled(spark, sf_dir), "truth", "pred").withColumn("kappa", round_half_up(F.col("kappa"), 9))


@query(
    "alpha",
    f"""with {SQL_LABELLED}, r as (select doc_id as unit, truth as value from labelled union all select doc_id, pred from labelled union all select doc_id, pred from labelled where doc_id % 2 = 0),
c as (select unit, value, count(*) as n from r group by all), u as (select unit, sum(n) as m, sum(n * n) as sq from c group by 1 having sum(n) > 1),
d as (select sum((m * m - sq)::double / (m - 1)::double) as d, sum(m) as total from u), v as (select sum(nv * nv) as sqv from (select value, sum(n) as nv from c where unit in (select unit from u) group by 1))
select total::bigint as ratings, {st.half_up('1 - d / ((total * total - sqv)::double / (total - 1)::double)', 9)} as alpha from d, v""",
)
def alpha(spark, sf_dir):
    df = labelled(spark, sf_dir)
    rows = df.select(
        F.col("doc_id").alias("unit"),
        F.explode(
            F.when(F.col("doc_id") % 2 == 0, F.array("truth", "pred", "pred")).otherwise(F.array("truth", "pred"))
        ).alias("value"),
    )
    return evl.krippendorff_alpha(rows).withColumn("alpha", round_half_up(F.col("alpha"), 9))


_CATEGORY_NO = f"doc_id % {len(lx.ERROR_CATEGORIES)} + 1"


@query(
    "error_categories",
    f"with {SQL_LABELLED} select truth, pred, list_extract({st.sql_list(lx.ERROR_CATEGORIES)}, {_CATEGORY_NO}) as category, count(*) as n from labelled where truth <> pred group by all",
)
def error_categories(spark, sf_dir):
    category = F.element_at(F.array(*[F.lit(c) for c in lx.ERROR_CATEGORIES]), F.expr(f"cast({_CATEGORY_NO} as int)"))
    return evl.error_table(labelled(spark, sf_dir).withColumn("category", category))


@query(
    "run_stats",
    f"""with {SQL_LABELLED}, r as (select doc_id % 7 as run, avg(case when truth = pred then 1.0::double else 0.0::double end) as m from labelled group by 1),
s as (select count(*) as runs, avg(m) as mean, median(m) as median, stddev_samp(m) as sd from r)
select runs, {st.half_up('mean', 9)} as mean, {st.half_up('median', 9)} as median, {st.half_up('sd', 9)} as stddev,
  {st.half_up('mean - 1.96::double * sd / sqrt(runs)', 9)} as low, {st.half_up('mean + 1.96::double * sd / sqrt(runs)', 9)} as high from s""",
)
def run_stats(spark, sf_dir):
    df = labelled(spark, sf_dir).withColumn("run", F.col("doc_id") % 7)
    out = evl.run_stats(df, "run", F.avg((F.col("truth") == F.col("pred")).cast("double")))
    return out.select("runs", *[round_half_up(F.col(c), 9).alias(c) for c in out.columns if c != "runs"])


@query(
    "human_ratings",
    f"""with {SQL_LABELLED}, h as (select unnest(['clarity', 'evidence', 'trust']) as aspect, doc_id from labelled)
select aspect, count(*) as ratings, avg((doc_id + length(aspect)) % 5 + 1) as mean from h group by 1""",
)
def human_ratings(spark, sf_dir):
    aspects = F.explode(F.array(F.lit("clarity"), F.lit("evidence"), F.lit("trust"))).alias("aspect")
    rows = labelled(spark, sf_dir).select("doc_id", aspects)
    return rows.groupBy("aspect").agg(
        F.count("*").alias("ratings"), F.avg((F.col("doc_id") + F.length("aspect")) % 5 + 1).alias("mean")
    )


@query(
    "class_balance",
    f"""with {SQL_LABELLED} select case when ('0x' || substring(sha256(doc_id::varchar), 1, 6))::bigint % 5 = 0 then 'eval' else 'dev' end as split, truth, count(*) as n from labelled group by all""",
)
def class_balance(spark, sf_dir):
    return evl.class_balance(labelled(spark, sf_dir), "doc_id")
