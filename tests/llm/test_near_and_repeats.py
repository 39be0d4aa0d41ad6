import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from factloom.llm import simhash, suffix_dedup


def plain_fingerprint(text, words):
    found = text.encode().lower().split()
    if not found:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(found[i : i + words]), 42) for i in range(max(1, len(found) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, distance):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                parent[find(i)] = find(j)
    least = {}
    for i in range(len(ids)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(ids))]


def test_fingerprints_and_components(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for family in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 60, 400]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    rows += [None, "", " \n"]
    ids = rng.sample(range(10_000), len(rows))
    docs = spark.createDataFrame(list(zip(ids, rows, strict=True)), "doc_id long, text string")
    fps = [plain_fingerprint(t or "", 3) for t in rows]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs, 3, 3).collect()}
    assert [got[i].fp % 2**64 for i in ids] == fps
    assert [got[i].component_id for i in ids] == plain_components(ids, fps, 3)


@pytest.mark.parametrize("small", [1, 4, 32])
def test_links_in_buckets_of_any_size(small):
    rng = np.random.default_rng(small)
    centre = rng.integers(0, 1 << 63, 6).astype(np.uint64)
    fps = centre[rng.integers(0, 6, 400)]
    for _ in range(3):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    keys = np.sort(rng.integers(0, 5, 400))
    both = np.stack([fps, np.zeros_like(fps)], 1)
    found = simhash.bucket_links(keys, both, 3, simhash.pivots(64), small)
    ids = list(range(400))
    want = [i for k in range(5) for i in plain_components([x for x in ids if keys[x] == k], [int(fps[x]) for x in ids if keys[x] == k], 3)]
    parent = list(ids)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found.tolist():
        assert keys[a] == keys[b] and int(fps[a] ^ fps[b]).bit_count() <= 3
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert [find(i) for i in ids] == want


def test_no_pair_misses_all_masks():
    rng = random.Random(2)
    for distance in (1, 3, 6):
        masks = simhash.block_masks(distance)
        for _ in range(500):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), distance):
                y ^= 1 << b
            assert any(x & m == y & m for m in masks)


def test_pivots_never_discard_a_link():
    fps = np.random.default_rng(1).integers(0, 1 << 63, (200, 2)).astype(np.uint64)
    near = fps ^ np.array([0b111, 0], np.uint64)
    table = simhash.distance_table(np.concatenate([fps, near]), simhash.pivots(128))
    i = np.arange(200)
    assert simhash._near(np.concatenate([fps, near]), table, i, i + 200, 3).all()
    assert not simhash._near(np.concatenate([fps, near]), table, i, i + 200, 2).any()


def test_long_chains_are_one_component(spark):
    chain = [(i, i + 1) for i in range(0, 200)] + [(1000, 1001), (5, 5)]
    got = {r.node: r.component for r in simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 201)} == {0} and got[1001] == 1000


def test_near_copies_of_messy_rows(messy, none):
    rows = messy.collect()
    got = simhash.near_duplicates(messy, 3, 3).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in rows)
    by = {r.doc_id: r.component_id for r in got}
    assert by[3] == by[5] == 3 and by[7] == by[8] == by[9] == 7 and by[11] == by[12] == 11
    assert simhash.near_duplicates(none, 3, 3).collect() == []


def test_wider_fingerprints_find_edited_texts(spark):
    rng = random.Random(9)
    base = [[f"t{rng.randrange(5000)}" for _ in range(300)] for _ in range(30)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    rows += [(100 + i, " ".join(b[:150] + ["changed"] + b[151:])) for i, b in enumerate(base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = simhash.near_duplicates(docs, 5, simhash.distance_for(0.8, 128), simhash.sampled_masks(16, 64, 128), 128, distinct=True).collect()
    assert {r.doc_id: r.component_id for r in found} == {k: k % 100 for k, _ in rows}


def one_word_changed(rng, words):
    """Two texts of different words; of five-word shingles, ``words - 4``, all but five are in both."""
    base = [f"w{x}" for x in rng.sample(range(10**6), words)]
    at = rng.randrange(5, words - 5)
    return " ".join(base), " ".join([*base[:at], "changed", *base[at + 1 :]])


def test_near_copies_on_both_sides_of_the_similarity(spark):
    import corpus_pipeline

    rng = random.Random(5)
    rows = []
    for family in range(900):  # similarity 40 / 50, 39 / 49 and 20 / 30
        one, two = one_word_changed(rng, [49, 48, 29][family % 3])
        rows += [(2 * family, one, "x"), (2 * family + 1, two, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    left = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert {2 * f for f in range(900)} <= left
    assert {2 * f + 1 for f in range(900) if f % 3} <= left  # below 0.8 everything stays
    found = [f for f in range(0, 900, 3) if 2 * f + 1 not in left]
    print("recall at 0.8:", len(found) / 300)
    assert len(found) >= 0.97 * 300


def test_groups_of_near_copies_are_those_of_all_pairs(spark):
    rng = random.Random(6)
    base = [f"w{x}" for x in rng.sample(range(10**6), 120)]
    texts = []
    for _ in range(150):  # copies of one text that are near to some of the others
        copy = list(base)
        for at in rng.sample(range(120), rng.choice([0, 1, 2, 3])):
            copy[at] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    texts += texts[:5] + ["", "a b", "a b"]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    least = list(range(len(texts)))
    for _ in texts:  # labels spread over all links until nothing changes
        before = list(least)
        for i, x in enumerate(sets):
            for j, y in enumerate(sets[:i]):
                if len(x & y) >= 0.8 * len(x | y):
                    least[i] = least[j] = min(least[i], least[j])
        if before == least:
            break
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # bands of one value miss no pair
    found = simhash.similar_groups(docs, 5, 0.8, "doc_id", bands=40, rows=1, first=1, deviations=6.0)
    assert {r.doc_id: r.component_id for r in found.collect()} == dict(enumerate(least))


def pairs_drawn(spark, monkeypatch, texts):
    """Groups of the texts, and how many pairs were drawn for them."""
    drawn = []
    keep = simhash.stored

    def counted(df, name):
        table = keep(df, name)
        if name == "drawn":
            drawn.append(table.count())
        return table

    monkeypatch.setattr(simhash, "stored", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.similar_groups(docs, 5, 0.8, "doc_id").collect()}
    return found, sum(drawn)


def edited(rng, base, changes):
    words = list(base)
    for at in rng.sample(range(len(base)), changes):
        words[at] = f"new{rng.randrange(10**9)}"
    return " ".join(words)


def test_pairs_of_a_group_grow_with_its_rows(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{x}" for x in rng.sample(range(10**6), 200)]
    for n in (1000, 2000):
        near, count = pairs_drawn(spark, monkeypatch, [edited(rng, base, 2) for _ in range(n)])  # similarity about 0.82
        print("near copies", n, count)
        assert set(near.values()) == {0} and count < 8 * n
    for n in (1000, 2000):  # one template: similarity about 0.55, nothing to join
        alike, count = pairs_drawn(spark, monkeypatch, [edited(rng, base[:60], 3) for _ in range(n)])
        print("merely similar", n, count)
        assert count < 8 * n


# ------------------------------------------------------------------ repeated strings


def plain_repeats(rows, length):
    seen, out = set(), []
    for data in rows:
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            if s in seen:
                gone[p : p + length] = True
            seen.add(s)
        out.append(gone)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_removed_bytes(spark, seed):
    rng = random.Random(seed)
    passage = "".join(rng.choice("abcé \0") for _ in range(250))
    rows = []
    for i in range(60):
        kind = rng.random()
        text = "".join(rng.choice("ab ") for _ in range(rng.choice([0, 50, 99, 100, 101, 400])))
        if kind < 0.4:
            at = rng.randrange(100)
            text = text[: len(text) // 2] + passage[at : at + rng.choice([90, 100, 130])] + text[len(text) // 2 :]
        if kind > 0.9:
            text = rng.choice(["=" * 500, "ab" * 200, passage * 2])
        rows.append((i * 3, text))
    rows += [(500, None), (501, passage), (502, passage)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    rows.sort()
    for (key, text), gone in zip(rows, plain_repeats([(t or "").encode() for _, t in rows], 100), strict=True):
        data = np.frombuffer((text or "").encode(), np.uint8)
        r = got[key]
        assert (r.n_bytes, r.n_removed, bytes(r.kept)) == (len(data), int(gone.sum()), data[~gone].tobytes()), key
        assert [(s.first, s.behind) for s in r.spans] == np.flatnonzero(np.diff(np.r_[False, gone, False].astype(int))).reshape(-1, 2).tolist() or [
            tuple(x) for x in np.flatnonzero(np.diff(np.r_[False, gone, False].astype(int))).reshape(-1, 2).tolist()
        ] == [(s.first, s.behind) for s in r.spans]
        assert r.n_spans == len(r.spans)


@pytest.mark.parametrize("n, size", [(1, 5), (2, 40), (7, 40), (500, 50), (2000, 101)])
def test_deep_shallow_order(n, size):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 3, (max(1, n // 20), size)).astype(np.uint8)
    rows = base[rng.integers(0, len(base), n)]
    rows = np.where(rng.random(rows.shape) < 0.01, rng.integers(0, 3, rows.shape), rows).astype(np.uint8)
    order, lcp = suffix_dedup.sort_rows(rows)
    ranked = [rows[i].tobytes() for i in order]
    assert ranked == sorted(r.tobytes() for r in rows)
    assert lcp.tolist() == [0] + [next((k for k in range(size) if x[k] != y[k]), size) for x, y in zip(ranked, ranked[1:])]


def test_repeats_of_messy_rows(messy, none):
    got = suffix_dedup.remove_repeats(messy).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in messy.collect())
    by = {r.doc_id: r for r in got}
    assert by[7].n_bytes == 0 and by[12].n_removed == by[12].n_bytes and by[11].n_bytes - by[11].n_removed < 200
    assert suffix_dedup.remove_repeats(none).collect() == []
