import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from factloom.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k=20):
    """Every document scored for every item."""
    bags = [(i, Counter(terms_of(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    total, length = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b, n in bags:
            m = 100 - 25 + (25 * n * total) // length
            score = 0
            for t in terms_of(text):
                if b[t]:
                    score += math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return out


def same(docs, items, k=20):
    got = ranked_search.search(docs, items, k).collect()
    want = plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], k)
    assert Counter(map(tuple, got)) == Counter(want)
    return got


def test_bytes_and_characters_agree():
    text = "Ab1_é日\x7f-Zz@[`{\x80\xa0 İK ß x\U0001f44d9/0:;A"
    assert [t.decode() for t in ranked_search.document_terms(text.encode())] == terms_of(text)


def test_given_tables(spark, sf_dir):
    got = same(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))
    assert len(got) > 300


@pytest.fixture
def items(spark):
    rows = [(1, "Some words that stay"), (2, "wort WORT wort"), (3, None), (4, "..."), (None, "no id"), (1, "x 123"), (5, "absent"), (6, "日本語 mark")]
    return spark.createDataFrame([(*r, 9, "v") for r in rows], "item_id long, text string, query long, vocabulary string")


def test_messy_rows(messy, items):
    same(messy, items)
    same(messy, items, k=2)


def test_empty_tables(none, messy, items):
    assert ranked_search.search(none, items).collect() == []
    assert ranked_search.search(messy, items.filter("false")).collect() == []


def test_ties_over_many_segments(spark):
    """Few different documents, many copies in many tasks: the smallest ids win."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices("abcdef", k=rng.randrange(1, 4)))) for i in rng.sample(range(10_000), 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(13)
    same(docs, spark.createDataFrame([(1, "a b"), (2, "c c d"), (3, "a b c d e f"), (4, "f")], "item_id long, text string"))


@pytest.mark.parametrize("short", [0, 1 / 8, 2])
def test_lists_in_one_segment(monkeypatch, short):
    """All lists short, none, or some; small runs, so that runs and candidates are skipped."""
    monkeypatch.setattr(ranked_search, "RUN", 16)
    monkeypatch.setattr(ranked_search, "SHORT", short)
    rng = random.Random(11)
    vocabulary = [f"t{k}" for k in range(60)]
    docs = [(i, " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(60)], k=rng.randrange(1, 60)))) for i in range(700)]
    row = ranked_search._segment([(i, t.encode()) for i, t in docs])
    total, length = row[0], row[1]
    df = Counter(t for _, text in docs for t in set(text.split()))
    n = np.frombuffer(ranked_search.unpack(row[3]), np.int64)
    read = [np.frombuffer(ranked_search.unpack(row[c]), kind) for c, kind in ((5, np.int64), (6, np.int32), (7, np.int32))]
    lists = ranked_search.Lists(row[2], {t: k for k, t in enumerate(row[4])}, *read, 75 + (25 * n * total) // length)
    for number in range(60):
        query = rng.choices(vocabulary, k=rng.randrange(1, 12))
        weights = {t: c * ranked_search.weight(df[t], total) for t, c in Counter(query).items()}
        got = ranked_search.best_of_segment(lists, weights, 10, 1)
        want = plain_search(docs, [(0, " ".join(query))], 10)
        assert sorted(((-s, row[2][d]) for d, s in got)) == [(-s, d) for _, _, d, s in want], number
        least = want[4][3] if len(want) > 4 else 1
        high = [(d, s) for d, s in ranked_search.best_of_segment(lists, weights, 10, least) if s >= least]
        assert sorted((-s, row[2][d]) for d, s in high) == [(-s, d) for _, _, d, s in want if s >= least]
