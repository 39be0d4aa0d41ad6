import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import context_tree, cross_polytope, language_gru
from factloom.llm.common import fold

# ------------------------------------------------------------------ language


def test_gradients():
    w = {k: v.astype(np.float64) for k, v in language_gru.initial(3, hidden=3, seed=1).items()}
    rng = np.random.default_rng(0)
    x, mask, y = rng.integers(0, 256, (4, 6)), np.ones((4, 6)), np.array([0, 1, 2, 1])
    mask[1, 4:] = 0
    _, grads = language_gru.loss_and_gradients(w, x, mask, y)
    for k, g in grads.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        value = w[k][at]
        w[k][at] = value + 1e-3
        up, _ = language_gru.loss_and_gradients(w, x, mask, y)
        w[k][at] = value - 1e-3
        down, _ = language_gru.loss_and_gradients(w, x, mask, y)
        w[k][at] = value
        assert g[at] == pytest.approx((up - down) / 2e-3, rel=1e-3)


def test_columns_give_what_rows_give():
    net = language_gru.Network(["a", "b", "c"], language_gru.initial(3))
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (0, 1, 63, 64, 65, 500)]
    got = language_gru.Labeller(net).documents(texts)
    for t, p in zip(texts, got, strict=True):
        want = np.zeros(3)
        for at in range(0, len(t), language_gru.STEPS):
            x = np.frombuffer(t[at : at + language_gru.STEPS], np.uint8)[None]
            states = [language_gru._states(net.weights, d, x, np.ones(x.shape, np.float32))[0] for d in "fb"]
            e = np.exp(states[0] @ net.weights["vf"] + states[1] @ net.weights["vb"] + net.weights["c"])
            want += (e / e.sum(-1, keepdims=True)).sum((0, 1))
        assert np.allclose(p, want / max(1, len(t)), atol=1e-4)


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = language_gru.fit(docs, learn=fold("doc_id", 3) != 1)
    got = language_gru.identify(docs, net, carry=("lang",)).filter(fold("doc_id", 3) == 1).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_languages_of_messy_rows(messy, none):
    net = language_gru.Network(["de", "en"], language_gru.initial(2))
    got = {r.doc_id: r for r in language_gru.identify(messy, net).collect()}
    assert all((got[k].lang_pred, got[k].score) == ("und", 0.0) for k in (7, 8, 9, 14))
    assert got[13].lang_pred in ("de", "en")
    assert {r.lang_pred for r in language_gru.identify(messy, None).collect()} == {"und"}
    assert language_gru.fit(none, F.lit(True)) is None and language_gru.identify(none, net).collect() == []
    assert language_gru.fit(messy.withColumn("lang", F.lit(None).cast("string")), F.lit(True)) is None


# ------------------------------------------------------------------ neighbours


def plain_neighbours(rows, k=10):
    ids, points = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for i, key in enumerate(ids):
        if key % 100 == 0:
            apart = np.sqrt(((points - points[i]) ** 2).sum(1))
            apart[ids == key] = np.inf
            order = [j for j in np.lexsort((ids, apart)) if np.isfinite(apart[j])][:k]
            out[int(key)] = [(int(ids[j]), float(apart[j])) for j in order]
    return out


def found(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_recall(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = plain_neighbours([(r.vec_id, r.embedding) for r in table.collect()])
    got = found(cross_polytope.search(table))
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in w}) / len(w) for q, w in want.items()]) >= 0.9
    exact = {(q, v): d for q, w in plain_neighbours([(r.vec_id, r.embedding) for r in table.collect()], 10**6).items() for v, d in w}
    assert all(d == pytest.approx(exact[q, v], abs=1e-12) for q, w in got.items() for v, d in w)


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    good = [(int(i), (rng.normal(size=5) * rng.uniform(0.1, 9)).tolist()) for i in range(0, 60, 7)]
    good += [(1400, [1.0] * 5), (1500, [1.0] * 5), (1501, [1.0] * 5)]
    bad = [(1000, None), (1100, [0.0] * 5), (1200, [1.0, None, 0.0, 0.0, 0.0]), (1300, [math.nan] * 5), (300, [math.inf] * 5), (None, [1.0] * 5), (1600, [1.0])]
    table = spark.createDataFrame([(*r, 1, "x") for r in good + bad], "vec_id long, embedding array<double>, t int, bucket string")
    got, want = found(cross_polytope.search(table)), plain_neighbours(good)
    assert set(got) == set(want)
    for q, w in want.items():
        assert [v for v, _ in got[q]] == [v for v, _ in w] and np.allclose([d for _, d in got[q]], [d for _, d in w])
    assert cross_polytope.search(table.filter("vec_id < 0")).collect() == []
    assert cross_polytope.search(table.filter("vec_id = 1400")).collect() == []


def test_full_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(cross_polytope, "BLOCK", 8)
    rows = [(i, [1.0, float(i % 3)]) for i in range(200)]
    got = found(cross_polytope.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    want = plain_neighbours(rows)
    assert {q: [v for v, _ in w] for q, w in got.items()} == {q: [v for v, _ in w] for q, w in want.items()}


def test_rotations_keep_lengths():
    x = np.random.default_rng(0).normal(size=(7, 16))
    assert np.allclose(np.linalg.norm(cross_polytope.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(cross_polytope.hadamard(cross_polytope.hadamard(x)), x)


# ------------------------------------------------------------------ language model


def plain_scores(rows, depth):
    learn = [t for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2]
    counts = defaultdict(lambda: [0, 0])

    def decisions(text):
        s = bytes([0xFE]) * depth + text.encode().lower() + b"\xff"
        for i in range(depth, len(s)):
            prefix = 1
            for j in range(7, -1, -1):
                yield s[:i], prefix, s[i] >> j & 1
                prefix = 2 * prefix + (s[i] >> j & 1)

    for t in learn:
        for past, prefix, bit in decisions(t):
            for d in range(depth + 1):
                counts[past[len(past) - d :], prefix][bit] += 1
    children = defaultdict(list)
    for c, p in list(counts):
        if c:
            children[c[1:], p].append((c, p))
    memo = {}

    def node(n):
        if n not in memo:
            a, b = counts[n]
            kt = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
            if len(n[0]) == depth:
                memo[n] = (kt, 1.0)
            else:
                product = sum(node(c)[0] for c in children[n])
                memo[n] = (float(np.logaddexp(kt, product)) - math.log(2), 1 / (1 + math.exp(min(700, product - kt))))
        return memo[n]

    words = Counter(w for t in learn for w in t.encode().lower().split())
    n, v = sum(words.values()) + len(learn), len(words) + bool(learn)
    out = {}
    for key, t in rows:
        total = 0.0
        for past, prefix, bit in decisions(t):
            p = None
            for d in range(depth, -1, -1):
                at = (past[len(past) - d :], prefix)
                if at in counts:
                    own = (counts[at][bit] + 0.5) / (sum(counts[at]) + 1)
                    p = own if p is None else node(at)[1] * own + (1 - node(at)[1]) * p
            total += math.log10(0.5 if p is None else p)
        found_ = t.encode().lower().split()
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in found_) + math.log10((len(learn) + 1) / (n + v + 1))
        out[key] = (total, base, len(found_) + 1, sum(w in words for w in found_) + bool(learn), n)
    return out


@pytest.mark.parametrize("depth", [2, 4])
def test_context_trees(spark, depth):
    rng = random.Random(depth)
    rows = [(i, "".join(rng.choice(["ab", "Abc ", "é", "x\n", "tion "]) for _ in range(rng.randrange(40)))) for i in range(30)]
    want = plain_scores(rows, depth)
    got = context_tree.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), fold("doc_id", 7) != 2, depth=depth).collect()
    assert len(got) == 30
    for r in got:
        score, base, *counts = want[r.doc_id]
        assert r.score == pytest.approx(score, rel=1e-5) and r.base_score == pytest.approx(base, rel=1e-9)
        assert [r.n_tokens, r.n_known, r.train_tokens] == counts
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)


def test_probabilities_of_a_byte_sum_to_one():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 100, 500).astype(np.uint8)
    codes, counts = context_tree._summed(context_tree.gram_codes(data, 3), np.ones(497, np.int64))
    for context in ("abc", "aab", "zzz"):  # all bytes of a context are asked for, as unseen ones
        number = int.from_bytes(context.encode()) << 8
        every, n = context_tree._summed(np.r_[codes, np.arange(number, number + 256).astype(np.uint64)], np.r_[counts, np.zeros(256, np.int64)])
        pair, c = context_tree._summed(((every >> np.uint64(24)) << np.uint64(8)) | (every & np.uint64(0xFF)), n)
        two, _ = context_tree.grow(every, n, 2, 3)[-1]
        mixed = Counter()
        for j in range(8):
            for p, m in zip(two.pairs[two.first[j]].tolist(), two.mixed[j].tolist(), strict=True):
                mixed[j, ((p >> 16) << 8 | p & 255) >> 8 - j] += m
        top = context_tree.top_depths({k: v for k, v in zip(pair.tolist(), c.tolist(), strict=True) if v}, mixed)
        at = np.searchsorted(every, np.arange(number, number + 256).astype(np.uint64))
        assert (10 ** context_tree.gram_scores(every, n, top, 3)[at]).sum() == pytest.approx(1)


def test_lookup_finds_every_code():
    codes = np.unique(np.random.default_rng(2).integers(0, 1 << 62, 5000).astype(np.uint64))
    table = context_tree.Lookup(codes)
    assert (table.find(codes[::-1]) == np.arange(len(codes))[::-1]).all()
    assert (table.find(codes + np.uint64(1)) == np.where(np.isin(codes + np.uint64(1), codes), 0, -1)).all()
    assert context_tree.Lookup(codes[:0]).find(codes).max() == -1


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 7.5, 100.5, 1e6])
    assert np.allclose(context_tree.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-11)


def test_scores_of_messy_rows(messy, none):
    got = context_tree.score(messy, fold("doc_id", 7) != 2).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in messy.collect())
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (7, 8, 9)} == {1}
    assert context_tree.score(none, F.lit(True)).collect() == []
    even = context_tree.score(messy, F.lit(False)).filter("doc_id = 15").first()
    assert even.score == pytest.approx(16 * math.log10(0.5)) and even.n_known == 0 and even.train_tokens == 0


def test_every_length_is_searched_on_its_own(spark):
    rng = np.random.default_rng(12)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(400)] + [(401, rng.normal(size=17).tolist())]
    rows += [(1000 + i, rng.normal(size=8).tolist()) for i in range(150)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in cross_polytope.search(table).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == {0, 100, 200, 300, 1000, 1100}
    right = 0
    for query, near in got.items():
        own = dict(rows)[query]
        apart = sorted((float(np.linalg.norm(np.subtract(v, own))), k) for k, v in rows if k != query and len(v) == len(own))
        assert [n[0] for n in sorted(near)] == list(range(1, 11))
        right += len({n[1] for n in near} & {k for _, k in apart[:10]})
    assert right >= 54


def test_sample_of_repeated_ids_and_empty_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language_gru, "train", lambda windows, sizes, labels, languages: seen.append((len(windows), Counter(labels.tolist()), languages)))
    monkeypatch.setattr(language_gru, "DOCUMENTS_PER_LANGUAGE", 50)
    rows = [(1, f"word {k} " * 40, "a") for k in range(3000)]  # one id of many texts
    rows += [(2, "the same text " * 40, "a")] * 3000
    rows += [(10_000 + k, None if k % 2 else "", "b") for k in range(5000)] + [(20_000 + k, f"real {k} " * 40, "b") for k in range(30)]
    language_gru.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    (total, by_label, languages), = seen
    assert languages == ["a", "b"] and by_label[0] == 50 * 12 and by_label[1] == 30 * 12 and total == 80 * 12
