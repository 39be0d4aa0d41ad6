import random

from pyspark.sql import functions as F

from factloom.operators import ranking as rk
from factloom.operators import simjoin
from test_groups import plain_groups


def _long_sets():
    """Sets of two thousand words: pairs that share the rarest ones only, near copies, and copies."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(6000)]
    rare = [f"r{i}" for i in range(20)]
    rows = [(i, rng.sample(words, 2000) + rare) for i in range(24)]
    rows += [(100 + i, rows[i][1][: 2020 - 40 * i]) for i in range(6)]
    return rows + [(200 + i, rows[i][1][::-1]) for i in range(3)]


def _send_words(spark, monkeypatch, rows, picked):
    sent = []

    def counting(df, name, real=simjoin.stored):
        out = real(df, name)
        if name == "close":
            sent.append(out.count())
        return out

    monkeypatch.setattr(simjoin, "stored", counting)
    monkeypatch.setattr(simjoin, "PICKED", picked)
    df = spark.createDataFrame(rows, "id long, words array<string>")
    got = {r.id: (r.representative, r.group_size, r.copies) for r in rk.near_copy_groups(df, "id", F.col("words")).collect()}
    return got, sent


def test_words_of_long_sets_travel_for_near_copies_only(spark, monkeypatch):
    """Sketches of 512 bits are all at random for such sets, so every candidate had its words sent."""
    rows = _long_sets()
    want = plain_groups(rows, 0.85)
    for picked in (0, 1000):
        got, sent = _send_words(spark, monkeypatch, rows, picked)
        assert got == want
        assert len(sent) == 4 and sent[0] > 100  # by short sketches, then by long ones, in both rounds
        assert sent[1] + sent[3] < 30
