import random

from pyspark.sql import functions as F

from factloom.operators import ranking as rk
from factloom.operators import simjoin


def plain_groups(rows, threshold):
    sets = {i: frozenset(w) for i, w in rows}
    label = {i: i for i in sets}
    grew = True
    while grew:
        grew = False
        for a in sets:
            for b in sets:
                x, y = sets[a], sets[b]
                near = x == y or (x and y and len(x & y) / len(x | y) >= threshold)
                if near and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    grew = True
    size = {v: sum(x == v for x in label.values()) for v in label.values()}
    return {i: (label[i], size[label[i]], sum(sets[i] == s for s in sets.values())) for i in sets}


def test_groups_against_brute_force(spark):
    """Chains, stars, copies, rows without words, and texts that are alike but not enough."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(20)]
    rows = [(i, base[:20 - i % 4] + [f"x{i % 7}"]) for i in range(40)]
    rows += [(100 + i, [f"c{j}" for j in range(i, i + 14)]) for i in range(12)]  # each like the next only
    rows += [(200 + i, rng.sample([f"r{j}" for j in range(30)], 8)) for i in range(40)] + [(300, []), (301, [])]
    rng.shuffle(rows)
    for threshold in (0.6, 0.85):
        df = spark.createDataFrame(rows, "id long, words array<string>")
        got = {r.id: (r.representative, r.group_size, r.copies) for r in rk.near_copy_groups(df, "id", F.col("words"), threshold).collect()}
        assert got == plain_groups(rows, threshold)


def test_no_rows(spark):
    df = spark.createDataFrame([], "id long, words array<string>")
    assert rk.near_copy_groups(df, "id", F.col("words")).collect() == []


def test_links_grow_with_the_members_not_their_pairs(spark, monkeypatch):
    """Ten thousand texts that are all near copies of each other."""
    links = []

    def counting(df, name, real=simjoin.stored):
        out = real(df, name)
        if name == "links":
            links.append(out.count())
        return out

    monkeypatch.setattr(simjoin, "stored", counting)
    n = 10_000
    rows = spark.range(n).select("id", F.concat(F.transform(F.sequence(F.lit(1), F.lit(39)), lambda i: F.concat(F.lit("w"), i)), F.array(F.concat(F.lit("own"), "id"))).alias("words"))
    got = rk.near_copy_groups(rows, "id", F.col("words")).groupBy("representative", "group_size").count().collect()
    assert [(r[0], r[1], r[2]) for r in got] == [(0, n, n)]
    assert sum(links) < 3 * n


def test_components_of_a_long_chain(spark):
    edges = spark.range(90).selectExpr("id as a", "id + 1 as b").unionByName(spark.createDataFrame([(1000, 1001), (1001, 1000)], "a long, b long"))
    got = {r.node: r.label for r in simjoin.components(edges).collect()}
    assert got == {**{i: 0 for i in range(91)}, 1000: 1000, 1001: 1000}


def test_independent_sources(spark):
    sources = spark.createDataFrame([(1, 10, "a", 1), (1, 11, "b", 2), (1, 12, "b", 3), (1, 13, "c", 4), (2, 14, "a", 1)], "claim_id long, page_id long, host string, source_pos int")
    groups = spark.createDataFrame([(10, 10), (11, 10), (12, 12), (13, 13)], "page_id long, representative long")
    got = {r.claim_id: (r.hosts, r.independent_sources) for r in rk.independent_sources(sources, groups).collect()}
    assert got == {1: (3, 2), 2: (1, 1)}
