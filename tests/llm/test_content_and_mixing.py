import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import content_sort, pivotal


def plain_groups(rows):
    groups = defaultdict(list)
    for k, r in enumerate(rows):
        text = r["text"] or ""
        groups["".join(c for c in text if c not in " \t\n\x0b\x0c\r")].append((-len(text), r["doc_id"] is None, r["doc_id"] or 0, k))
    out = {}
    for members in groups.values():
        keep = min(members)
        for m in members:
            out[m[3]] = (rows[keep[3]]["doc_id"], len(members))
    return out


def test_groups_of_messy_rows(messy):
    rows = messy.collect()
    want = Counter((r["doc_id"], *plain_groups(rows)[k]) for k, r in enumerate(rows))
    got = content_sort.content_groups(messy).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(set(plain_groups(rows).values()))  # one of every group


def test_copies_spread_over_partitions(spark):
    """A group far larger than a partition is one group."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.range(5000).selectExpr("id as doc_id", "if(id % 5 < 3, 'the same', if(id % 5 = 3, 'a', concat('z', id))) as text")
        got = content_sort.content_groups(docs).groupBy("keep_id", "group_size").agg(F.sum(F.col("kept").cast("int")).alias("kept")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert {(r.keep_id, r.group_size) for r in got if r.group_size > 1} == {(0, 3000), (3, 1000)}
    assert all(r.kept == 1 for r in got) and len(got) == 1002


def test_empty_tables(none):
    assert content_sort.content_groups(none).collect() == []
    assert pivotal.mix(none).collect() == []


def filled(total, sizes, most=3):
    """Share by weight, stop full sources, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, rest = {}, set(sizes), float(total)
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= most * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: float(most * sizes[s]) for s in full}
        rest -= sum(most * sizes[s] for s in full)
        open_ -= full
    return target


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_copies(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " w" * rng.choice([0, 1, 5, 40]), rng.choice(["a", "b", "c", "d", None, "tiny"][: 5 + (i % 50 == 0)])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = pivotal.mix(docs).collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    want, source_of = filled(sum(sizes.values()), sizes), {r[0]: r[2] for r in rows}
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(want[source_of[r.doc_id]])
        assert r.taken == r.copies * r.size <= 3 * r.size
        assert abs(r.copies - r.target / r.source_size) < 1 or r.size == 0
        taken[source_of[r.doc_id]] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 40  # one document
    again = pivotal.mix(docs.repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_rounding_keeps_expectations():
    runs = []
    for seed in range(4000):
        units = [[0.3, 2.0], [0.5, 4.0], [0.9, 1.0], [0.3, 3.0]]
        rng = random.Random(seed)
        left = pivotal._round_pairs(units, rng)
        if left is not None:
            units[left][0] = float(rng.random() < units[left][0])
        runs.append([u[0] for u in units])
    assert np.allclose(np.mean(runs, 0), [0.3, 0.5, 0.9, 0.3], atol=0.03)


def test_mix_of_messy_rows(messy):
    got = pivotal.mix(messy).collect()
    assert len(got) == messy.count()
    assert all(r.taken == 0 for r in got if r.doc_id in (7, 8, 9))


def test_residuals_meet_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(pivotal, "BLOCK", 16)
    monkeypatch.setattr(pivotal, "FAN_IN", 2)
    docs = spark.range(1200).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 7 as int)) as text", "if(id % 3 = 0, 'a', 'b') as source")
    by = pivotal.mix(docs).join(docs, "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("want")).collect()
    assert all(abs(r.t - r.want) <= 7 for r in by)


def test_one_id_of_many_rows_has_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(pivotal, "BLOCK", 64)
    sizes = []
    keep = pivotal.stored

    def seen(df, name):
        table = keep(df, name)
        if name == "rounded" and not sizes:
            sizes.extend(r["count"] for r in table.groupBy("src", "block").count().collect())
        return table

    monkeypatch.setattr(pivotal, "stored", seen)
    rows = [(1, "same words here", "a")] * 2000 + [(1, "w " * k, "a") for k in range(1, 200)] + [(2, "one two", "b")] * 800
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = pivotal.mix(docs).collect()
    assert len(mixed) == len(rows) and max(sizes) < 64 * 3 and len(sizes) > 30
    for size in {r.source_size for r in mixed}:
        of = [r for r in mixed if r.source_size == size]
        assert abs(sum(r.taken for r in of) - of[0].target) <= 199
    again = pivotal.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, mixed)) == sorted(map(tuple, again))
