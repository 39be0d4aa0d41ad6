"""Metrics over predictions, rankings, transcripts and logs: grouped aggregates only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..session import ensure_checkpoint_dir
from ..functions.text import ratio
from ..functions.udfs import word_edit_distance


def cer(df: DataFrame, reference: str, hypothesis: str, *by: str) -> DataFrame:
    """Character error rate: summed edit distance over summed reference length."""
    return df.groupBy(*by).agg(
        F.sum(F.levenshtein(reference, hypothesis)).alias("edits"),
        F.sum(F.length(reference)).alias("characters"),
    ).withColumn("cer", ratio(F.col("edits"), F.col("characters")))


def wer(df: DataFrame, reference: str, hypothesis: str, *by: str) -> DataFrame:
    words = F.size(F.filter(F.split(reference, r"\s+"), lambda w: w != ""))
    return df.groupBy(*by).agg(
        F.sum(word_edit_distance(F.col(reference), F.col(hypothesis))).alias("edits"),
        F.sum(words).alias("words"),
    ).withColumn("wer", ratio(F.col("edits"), F.col("words")))


def hash_determinism_rate(identities: DataFrame, group: str, hashed: str) -> DataFrame:
    """Share of variant groups that all map to one hash."""
    groups = identities.groupBy(group).agg(F.count_distinct(hashed).alias("hashes"))
    return groups.agg(
        F.count("*").alias("groups"),
        F.count_if(F.col("hashes") == 1).alias("one_hash"),
        ratio(F.count_if(F.col("hashes") == 1), F.count("*")).alias("determinism"),
    )


def _judged(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    return ranked.join(relevant.withColumn("_rel", F.lit(1)), ["claim_id", "item"], "left").withColumn(
        "relevant", F.coalesce("_rel", F.lit(0))
    )


def precision_recall_at_k(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Per claim with truth: hits in the first k, precision and recall."""
    hits = _judged(ranked.filter(F.col("rank") <= k), relevant).groupBy("claim_id").agg(F.sum("relevant").alias("hits"))
    truth = relevant.groupBy("claim_id").agg(F.count("*").alias("truth"))
    return truth.join(hits, "claim_id", "left").fillna({"hits": 0}).select(
        "claim_id", "hits", "truth", (F.col("hits") / F.lit(float(k))).alias("precision"),
        ratio(F.col("hits"), F.col("truth")).alias("recall"),
    )


def mrr(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    first = ranked.join(relevant, ["claim_id", "item"], "left_semi").groupBy("claim_id").agg(F.min("rank").alias("first"))
    return relevant.select("claim_id").distinct().join(first, "claim_id", "left").agg(
        F.count("*").alias("claims"), F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr")
    )


def ndcg(ranked: DataFrame, graded: DataFrame, k: int) -> DataFrame:
    """nDCG@k with gain 2^grade - 1 and log2 discount, per claim with graded items."""

    def gain(place: str) -> Column:
        return (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col(place) + 1)

    ideal_order = Window.partitionBy("claim_id").orderBy(F.desc("grade"), "item")
    ideal = (
        graded.withColumn("place", F.row_number().over(ideal_order)).filter(F.col("place") <= k)
        .groupBy("claim_id").agg(F.sum(gain("place")).alias("ideal"))
    )
    got = ranked.filter(F.col("rank") <= k).join(graded, ["claim_id", "item"]).groupBy("claim_id").agg(
        F.sum(gain("rank")).alias("dcg")
    )
    return ideal.join(got, "claim_id", "left").select(
        "claim_id", (F.coalesce("dcg", F.lit(0.0)) / F.nullif("ideal", F.lit(0.0))).alias("ndcg")
    )


def ranking_inversions(ranked: DataFrame, score: str) -> DataFrame:
    """Neighbours in the wrong order, and hosts per claim."""
    w = Window.partitionBy("claim_id").orderBy("rank")
    wrong = F.coalesce((F.lag(score).over(w) < F.col(score)).cast("int"), F.lit(0))
    return ranked.withColumn("_w", wrong).groupBy("claim_id").agg(
        F.count("*").alias("items"), F.count_distinct("host").alias("hosts"), F.sum("_w").alias("inversions")
    )


def confusion(df: DataFrame) -> DataFrame:
    return df.groupBy("truth").pivot("pred", lx.VERDICTS).agg(F.count(F.lit(1))).fillna(0)


def class_report(df: DataFrame) -> DataFrame:
    """Precision, recall and F1 per class from the (truth, pred) counts."""
    cells = df.groupBy("truth", "pred").agg(F.count("*").alias("n"))
    sides = cells.select(
        F.explode(F.array(F.struct(F.col("truth").alias("c"), F.lit("t").alias("side")), F.struct(F.col("pred").alias("c"), F.lit("p").alias("side")))).alias("e"),
        "n", (F.col("truth") == F.col("pred")).alias("same"),
    ).select("e.c", "e.side", "n", "same")
    report = sides.groupBy(F.col("c").alias("verdict")).agg(
        F.sum(F.when((F.col("side") == "t") & F.col("same"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("side") == "t", F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("side") == "p", F.col("n")).otherwise(0)).alias("predicted"),
    )
    return report.select(
        "verdict", "support", "predicted", ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        (2 * F.col("tp") / (F.col("support") + F.col("predicted")).cast("double")).alias("f1"),
    )


def accuracy_cube(df: DataFrame, *by: str) -> DataFrame:
    """Accuracy for every combination of the columns, with totals as ALL."""
    right = (F.col("truth") == F.col("pred")).cast("int")
    grouped = df.cube(*by).agg(
        F.count("*").alias("n"), F.avg(right).alias("accuracy"), *[F.grouping(c).alias(f"_{c}") for c in by]
    )
    return grouped.select(
        *[F.when(F.col(f"_{c}") == 1, "ALL").otherwise(F.col(c)).alias(c) for c in by], "n", "accuracy"
    )


def calibration(df: DataFrame, bins: int = 10) -> DataFrame:
    right = (F.col("truth") == F.col("pred")).cast("int")
    which = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1))
    return df.groupBy(which.alias("bin")).agg(
        F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"), F.avg(right).alias("accuracy")
    )


def ece_brier(df: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error and Brier score from per-bin sums."""
    right = (F.col("truth") == F.col("pred")).cast("double")
    which = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1))
    binned = df.groupBy(which.alias("bin")).agg(
        F.count("*").alias("n"), F.sum("confidence").alias("sc"), F.sum(right).alias("sr"),
        F.sum(F.pow(F.col("confidence") - right, F.lit(2.0))).alias("sq"),
    )
    return binned.agg(
        (F.sum(F.abs(F.col("sc") - F.col("sr"))) / F.sum("n")).alias("ece"), (F.sum("sq") / F.sum("n")).alias("brier")
    )


def exact_percentiles(df: DataFrame, value: str, by: tuple[str, ...], points: dict[str, float], times: str | None = None) -> DataFrame:
    """``*by, n`` and an interpolated percentile per point, without gathering a group in one task.

    Values are counted, dealt over range partitions by (group, value), and summed up inside
    each partition; partition totals, at most one row per partition and group, give the
    offsets.  A percentile lies between the first values whose count from below passes its
    two neighbouring places.  Null values are left out; the dealt counts are checkpointed
    because partition numbers must not change between the two readings.  ``times`` names a
    column with the number of times that a row's value occurs, once by default.
    """
    often = F.count(F.lit(1)) if times is None else F.sum(times)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(often.alias("_f"))
    ensure_checkpoint_dir(df.sparkSession)
    dealt = counted.repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id()).checkpoint()
    groups = Window.partitionBy(*by)
    sums = dealt.groupBy(*by, "_part").agg(F.sum("_f").alias("_here"))
    sums = sums.select(
        *[F.col(c).alias(f"_{c}") for c in by], F.col("_part").alias("_p"),
        (F.sum("_here").over(groups.orderBy("_part")) - F.col("_here")).alias("_before"), F.sum("_here").over(groups).alias("n"),
    )
    same = F.col("_part") == F.col("_p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    inside = Window.partitionBy(*by, "_part").orderBy("_v")
    placed = dealt.withColumn("_upto", F.sum("_f").over(inside)).join(sums, same).withColumn("_upto", F.col("_upto") + F.col("_before"))
    sides = {"lo": F.floor, "hi": F.ceil}
    found = placed.groupBy(*by).agg(
        F.max("n").alias("n"),
        *[
            F.min(F.when(F.col("_upto") > side((F.col("n") - 1) * F.lit(p)), F.col("_v"))).alias(f"_{name}_{s}")
            for name, p in points.items() for s, side in sides.items()
        ],
    )

    def between(name: str, p: float) -> Column:
        place = (F.col("n") - 1) * F.lit(p)
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        return F.when(low == high, low.cast("double")).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return found.select(*by, "n", *[between(name, p).alias(name) for name, p in points.items()])


def latency_percentiles(log: DataFrame, *by: str, approximate: bool = False) -> DataFrame:
    """P50/P95/P99; exact by default, sketches on request."""
    points = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    if approximate:
        aggs = [F.percentile_approx("latency_ms", F.lit(p), F.lit(10000)).alias(n) for n, p in points.items()]
        return log.groupBy(*by).agg(F.count("*").alias("n"), *aggs)
    return exact_percentiles(log, "latency_ms", by, points)


def latency_histogram(log: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    bucket = F.width_bucket(F.col("latency_ms"), F.lit(low), F.lit(high), F.lit(bins))
    return log.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def cost(log: DataFrame, prices: dict[str, float]) -> DataFrame:
    """Cost per tier with the cache, and what the same requests cost without it."""
    price = F.when(F.lit(False), F.lit(0.0))
    for tier, value in prices.items():
        price = price.when(F.col("tier") == tier, F.lit(value))
    without = F.lit(max(prices.values()))
    per_tier = log.groupBy("tier").agg(F.count("*").alias("requests"))
    return per_tier.select(
        "tier", "requests", (F.col("requests") * price.otherwise(F.lit(0.0))).alias("cost"),
        (F.col("requests") * without).alias("cost_without_cache"),
    )


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    rows = cells.groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("na"))
    cols = cells.groupBy(F.col("b").alias("c")).agg(F.sum("n").alias("nb"))
    chance = rows.join(cols, "c").agg(F.sum(F.col("na") * F.col("nb")).alias("chance"))
    po = F.col("same") / F.col("total").cast("double")
    pe = F.col("chance") / (F.col("total") * F.col("total")).cast("double")
    return total.withColumn("chance", chance.scalar()).select(
        F.col("total").alias("n"), po.alias("observed"), pe.alias("expected"), ((po - pe) / (1 - pe)).alias("kappa")
    )


def krippendorff_alpha(ratings: DataFrame) -> DataFrame:
    """Nominal alpha from (unit, value) rows, one per rating."""
    cells = ratings.groupBy("unit", "value").agg(F.count("*").alias("n"))
    units = cells.groupBy("unit").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("sq")).filter("m > 1")
    disagree = units.agg(
        F.sum((F.col("m") * F.col("m") - F.col("sq")) / (F.col("m") - 1).cast("double")).alias("d"), F.sum("m").alias("total")
    )
    values = cells.join(units.select("unit"), "unit").groupBy("value").agg(F.sum("n").alias("nv"))
    chance = values.agg(F.sum(F.col("nv") * F.col("nv")).alias("sqv"))
    expected = (F.col("total") * F.col("total") - F.col("sqv")) / (F.col("total") - 1).cast("double")
    return disagree.withColumn("sqv", chance.scalar()).select(
        F.col("total").alias("ratings"), (1 - F.col("d") / expected).alias("alpha")
    )


def run_stats(df: DataFrame, run: str, value: Column) -> DataFrame:
    """Mean, median, deviation and 95 % interval of a metric over repeated runs."""
    runs = df.groupBy(run).agg(value.alias("m"))
    mean, dev, n = F.avg("m"), F.stddev_samp("m"), F.count("*")
    return runs.agg(
        n.alias("runs"), mean.alias("mean"), F.median("m").alias("median"), dev.alias("stddev"),
        (mean - 1.96 * dev / F.sqrt(n)).alias("low"), (mean + 1.96 * dev / F.sqrt(n)).alias("high"),
    )


def class_balance(df: DataFrame, id_col: str) -> DataFrame:
    """Class counts per stable split: one in five hash values is the evaluation set."""
    slot = F.conv(F.substring(F.sha2(F.col(id_col).cast("string"), 256), 1, 6), 16, 10).cast("bigint") % 5
    return df.groupBy(F.when(slot == 0, "eval").otherwise("dev").alias("split"), "truth").agg(F.count("*").alias("n"))


def error_table(df: DataFrame) -> DataFrame:
    """Expected x predicted counts of wrong predictions."""
    wrong = df.filter(F.col("truth") != F.col("pred"))
    return wrong.groupBy("truth", "pred", "category").agg(F.count("*").alias("n"))


def reliability(log: DataFrame, *by: str) -> DataFrame:
    failed = F.count_if(F.col("event_type") == "error")
    return log.groupBy(*by).agg(
        F.count("*").alias("requests"), failed.alias("failures"),
        ratio(failed, F.count("*")).alias("failure_rate"), (1 - ratio(failed, F.count("*"))).alias("reliability"),
    )


def error_rate_trend(log: DataFrame, window: str = "1 day") -> DataFrame:
    """Error rate per interval and its change; one small row per interval is windowed."""
    counts = log.groupBy(F.window("ts", window).alias("w")).agg(
        F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors")
    ).select(F.col("w.start").alias("window_start"), "requests", "errors", ratio(F.col("errors"), F.col("requests")).alias("error_rate"))
    w = Window.orderBy("window_start")
    return counts.withColumn("change", F.col("error_rate") - F.lag("error_rate").over(w))


def retained(df: DataFrame, ts: str, as_of: str, days: int) -> DataFrame:
    return df.filter(F.col(ts) >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days"))


def expired(df: DataFrame, kind: str, day: str, ages: dict[str, int], as_of: str, default: int) -> Column:
    """Whether a row's whole day is older than the age, in days, of its class."""
    age = F.lit(default)
    for name, days in ages.items():
        age = F.when(F.col(kind) == name, F.lit(days)).otherwise(age)
    return F.col(day) < F.date_sub(F.to_date(F.lit(as_of)), age)


def apply_retention(spark: SparkSession, table: str, totals: str, ages: dict[str, int], as_of: str, default: int, kind: str = "event_type", day: str = "day") -> int:
    """Drop the days of a table that are older than their class may be kept; their totals stay.

    ``table`` is partitioned by (class, day), so a class goes day by day and nothing is
    rewritten.  Requests, errors and latency of the expiring days are first written to
    ``totals`` with dynamic partition overwrite, the days are deleted after that: a run
    that is repeated, or goes on after a failure, writes the same partitions again.
    Returns the number of days dropped.
    """
    rows = spark.read.parquet(table)
    old = rows.filter(expired(rows, kind, day, ages, as_of, default))
    sums = old.groupBy(kind, day).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"),
        F.sum("latency_ms").alias("latency_sum"), F.max("latency_ms").alias("latency_max"),
    )
    gone = old.select(kind, day).distinct().collect()  # one row for each class and day
    if gone:
        sums.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(kind, day).parquet(totals)
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for r in gone:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{table}/{kind}={r[0]}/{day}={r[1]}"), True)
    return len(gone)
