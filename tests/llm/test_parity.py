import numpy as np

from factloom.llm import simhash as sh


def _variants(rng, n, kept, own):
    """Sets that share a base but for ``own`` hashes each."""
    base = rng.integers(0, 1 << 63, kept, np.uint64)
    return [np.unique(np.concatenate([base, rng.integers(0, 1 << 63, own, np.uint64)])) for _ in range(n)]


def _drawn(sets, parities):
    fps = np.array([sh.wide_fingerprint(h) for h in sets], np.int64).view(np.uint64)
    odd = np.array([sh.parity(h) for h in sets], np.int64).view(np.uint64)
    i, j = np.triu_indices(len(sets), 1)
    discard = sh._Discard(0.8, sh.distance_for(0.8, sh.BITS * sh.FP_WORDS, 3.0))
    size = np.array([len(h) for h in sets], np.int32)
    return [len(discard(np.arange(len(sets)), size, fps, i, j, *parities(odd))[0]), len(i)]


def test_parities_bound_the_difference_of_sets():
    rng = np.random.default_rng(5)
    for own in (0, 1, 5, 40, 300):
        a, b = _variants(rng, 2, 60, own)
        bits = np.array([sh.parity(a), sh.parity(b)], np.int64).view(np.uint64)
        apart = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
        assert apart <= len(np.setxor1d(a, b)) and (apart > 0) == (own > 0)


def test_parities_discard_a_group_that_is_near_but_not_similar():
    """pipeline, near_dedup: fingerprints let a large group of sets at a similarity of 0.7 through, pair by pair."""
    sets = _variants(np.random.default_rng(6), 60, 56, 12)
    before, pairs = _drawn(sets, lambda odd: ())
    now, _ = _drawn(sets, lambda odd: (odd,))
    assert before > pairs / 4 and now < before / 3


def test_parities_keep_every_similar_pair():
    sets = _variants(np.random.default_rng(7), 40, 64, 8)  # 64 of 80 hashes: exactly 0.8
    before, _ = _drawn(sets, lambda odd: ())
    now, _ = _drawn(sets, lambda odd: (odd,))
    assert now == before > 0
