"""Near-duplicate documents by SimHash and pivot distance tables.

A fingerprint bit is the majority of that bit over the hashes of a text's word shingles.
Links between fingerprints are found in three steps.  Tables of masks draw candidates: for
a distance of d, the bits fall into d + 2 blocks and every two blocks are a table, because
two fingerprints within d bits agree on at least two whole blocks.  Inside a bucket every
fingerprint has its Hamming distances to many reference fingerprints (pivots); a pair whose
largest coordinate difference exceeds d cannot be within d and is discarded.  The others
are verified.  A bucket gives a spanning forest of its links and never all its pairs, so
groups of near copies stay linear.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, whole

BITS = 64
PIVOTS = 32
SEED = 42
_ALL = (1 << BITS) - 1
#: pairs compared at once
_PAIRS = 1 << 21


# ------------------------------------------------------------------ fingerprints


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; A-Z count as lower case."""
    found = text.encode().lower().split()  # bytes: only ASCII letters and white space
    if not found:
        return np.empty(0, np.uint64)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)], np.uint64)
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
    stops = np.cumsum(sizes)
    starts = (stops - sizes).tolist()[: len(found) - words + 1]
    ends = (stops - 1).tolist()[words - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))


_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes; zero without hashes."""
    if not len(hashes):
        return 0
    parts = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    if len(hashes) < 256:
        counts = np.unpackbits(parts, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(parts[:, j], minlength=256) @ _BYTE_BITS for j in range(8)])
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _second(hashes: np.ndarray) -> np.ndarray:
    """Other 64 hash bits of the same shingles."""
    h = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, words: int, bits: int = BITS, distinct: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fp, fp2`` of every whole text: its fingerprint as signed 64-bit integers.

    ``fp2`` has the second 64 of 128 bits, and is 0 for fingerprints of 64 bits.  With
    ``distinct`` repeated shingles count once, as they do in Jaccard similarity.
    """
    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    out = rows.select("id", F.lit(0).cast("long").alias("fp"), F.lit(0).cast("long").alias("fp2")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, second = [], []
            for t in b.column(1):
                hashes = shingle_hashes(t.as_py(), words)
                hashes = np.unique(hashes) if distinct else hashes
                first.append(_signed(fingerprint(hashes)))
                second.append(_signed(fingerprint(_second(hashes))) if bits > BITS else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(first, pa.int64()), pa.array(second, pa.int64())], ["id", "fp", "fp2"])

    return rows.mapInArrow(run, out).withColumnRenamed("id", id_col)


# ------------------------------------------------------------------ links


def block_masks(distance: int) -> list[int]:
    """Masks of two blocks out of ``distance + 2``: no pair of 64-bit fingerprints within the distance misses all."""
    cuts = [BITS * i // (distance + 2) for i in range(distance + 3)]
    blocks = [(1 << b) - (1 << a) for a, b in itertools.pairwise(cuts)]
    return [a | b for a, b in itertools.combinations(blocks, 2)]


def sampled_masks(chosen: int, tables: int, bits: int, seed: int = SEED) -> list[int]:
    """Masks of ``chosen`` random bits each."""
    rng = random.Random(seed)
    return [sum(1 << i for i in rng.sample(range(bits), chosen)) for _ in range(tables)]


def distance_for(similarity: float, bits: int, deviations: float = 2.0) -> int:
    """Differing bits that texts of this Jaccard similarity rarely exceed: mean and some standard deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def pivots(bits: int, count: int = PIVOTS, seed: int = SEED) -> np.ndarray:
    """Random reference fingerprints as rows of 64-bit words, two at least."""
    found = [random.Random(seed * 1000 + i).getrandbits(bits) for i in range(count)]
    return np.array([[x >> at & _ALL for at in range(0, max(bits, 2 * BITS), BITS)] for x in found], np.uint64)


def distance_table(fps: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Hamming distance of every fingerprint to every pivot."""
    return sum(np.bitwise_count(fps[:, None, k] ^ references[None, :, k]) for k in range(fps.shape[1])).astype(np.int16)


def _near(fps: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, distance: int) -> np.ndarray:
    """Which pairs are within the distance: pivots discard, survivors are verified."""
    keep = np.ones(len(i), bool)
    for p in range(0, table.shape[1], 4):  # a few pivots at a time: most pairs leave early
        at = np.flatnonzero(keep)
        if not len(at):
            return keep
        apart = np.abs(table[i[at], p : p + 4] - table[j[at], p : p + 4]).max(1)
        keep[at[apart > distance]] = False
    at = np.flatnonzero(keep)
    keep[at] = np.bitwise_count(fps[i[at]] ^ fps[j[at]]).sum(1) <= distance
    return keep


def _forest(fps: np.ndarray, table: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Spanning forest of the links in one large bucket: each step looks only at what isn't reached yet."""
    rest = np.arange(len(fps))
    edges: list[tuple[int, int]] = []
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = _near(fps, table, np.full(len(rest), x), rest, distance)
            found = rest[near].tolist()
            edges += [(x, y) for y in found]
            front += found
            rest = rest[~near]
    return edges


def bucket_links(keys: np.ndarray, fps: np.ndarray, distance: int, references: np.ndarray, small: int = 32) -> np.ndarray:
    """Links among fingerprints with equal key (rows sorted by key), as index pairs.

    Buckets of up to ``small`` rows are compared pair by pair for all buckets at once; larger
    ones give a spanning forest.
    """
    bounds = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    sizes = np.diff(bounds)
    out = []
    table = distance_table(fps, references)
    begin_of = np.repeat(bounds[:-1], sizes)
    size_of = np.repeat(sizes, sizes)
    pos = np.arange(len(fps)) - begin_of
    for step in range(1, min(small, int(sizes.max(initial=1)))):
        i = np.flatnonzero((size_of <= small) & (pos + step < size_of))
        for at in range(0, len(i), _PAIRS):
            a = i[at : at + _PAIRS]
            ok = _near(fps, table, a, a + step, distance)
            out.append(np.stack([a[ok], a[ok] + step], 1))
    for b, n in zip(bounds[:-1][sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
        edges = _forest(fps[b : b + n], table[b : b + n], distance)
        if edges:
            out.append(np.array(edges, np.int64) + b)
    return np.concatenate(out) if out else np.empty((0, 2), np.int64)


def stars(edges: np.ndarray) -> np.ndarray:
    """The same components as pairs of each node with the smallest one it reaches: one pair a node."""
    nodes, ends = np.unique(edges, return_inverse=True)
    parent = list(range(len(nodes)))
    for a, b in ends.reshape(-1, 2).tolist():
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a < b:
            parent[b] = a
        else:
            parent[a] = b
    least = np.array(parent, np.int64)
    while (least[least] != least).any():
        least = least[least]
    at = np.flatnonzero(least != np.arange(len(nodes)))
    return np.stack([nodes[least[at]], nodes[at]], 1)


def links(nodes: DataFrame, distance: int, masks: list[int], bits: int = BITS) -> DataFrame:
    """``node, fp, fp2`` with distinct fingerprints -> nodes ``a, b`` that links connect.

    ``a`` is the smallest node that the links of one batch of buckets connect with ``b``, so
    that a group of near copies gives much the same pairs in every table.

    Every node goes to one bucket per mask.  Buckets are streamed from sorted partitions; a
    task holds whole buckets, and what it holds is the numbers and pivot distances of
    *distinct* fingerprints that agree on a mask's bits.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, fp, fp2 = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            for t, mask in enumerate(masks):
                key = (fp & np.int64(_signed(mask & _ALL))).view(np.uint64)
                if mask >> BITS:  # one number for the bits of both words; a rare clash only adds candidates
                    key = key * np.uint64(0x9E3779B97F4A7C15) + _second((fp2 & np.int64(_signed(mask >> BITS))).view(np.uint64))
                columns = [pa.array(np.full(len(fp), t, np.int32)), pa.array(key.view(np.int64)), *(pa.array(x) for x in (node, fp, fp2))]
                yield pa.RecordBatch.from_arrays(columns, ["mask", "key", "node", "fp", "fp2"])

    references = pivots(bits)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            mask, key, node, fp, fp2 = (np.concatenate(c) for c in zip(*parts, strict=True))
            bucket = np.cumsum(np.r_[0, (key[1:] != key[:-1]) | (mask[1:] != mask[:-1])])
            found = bucket_links(bucket, np.stack([fp, fp2], 1).view(np.uint64), distance, references)
            if len(found):
                pair = stars(node[found])
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], ["a", "b"])

        for b in batches:
            part = tuple(c.to_numpy(zero_copy_only=False) for c in b.columns)
            if not len(part[0]):
                continue
            # rows of the last bucket wait for the next batch
            last = np.flatnonzero((part[1] != part[1][-1]) | (part[0] != part[0][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if held and (held[-1][1][-1] != part[1][0] or held[-1][0][-1] != part[0][0]):
                yield from flush(held)
                held = []
            if cut:
                yield from flush([*held, tuple(c[:cut] for c in part)])
                held = []
            held.append(tuple(c[cut:] for c in part))
        if held:
            yield from flush(held)

    keyed = nodes.select("node", "fp", "fp2").mapInArrow(spread, "mask int, key long, node long, fp long, fp2 long")
    dealt = keyed.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp", "fp2")
    return dealt.mapInArrow(pairs, "a long, b long").distinct()


# ------------------------------------------------------------------ near copies by exact similarity

#: 64-bit words of a sketch's fingerprint
FP_WORDS = 4
_FPS = [f"fp{k}" for k in range(FP_WORDS)]
#: 64-bit words of a parity sketch
_ODD = [f"odd{k}" for k in range(4)]
#: random odd factors and offsets, one per minimum
_MINIMA = np.random.default_rng(SEED).integers(0, 1 << 63, (2, 4096), np.uint64) * np.uint64(2) + np.uint64(1)


def minima(hashes: np.ndarray, count: int) -> np.ndarray:
    """Smallest values of ``count`` permutations of a set of hashes; sets share each with a chance of their similarity."""
    least = np.full(count, _ALL, np.uint64)
    for at in range(0, len(hashes), 64):  # blocks that stay in a core's cache
        block = hashes[at : at + 64, None] ^ _MINIMA[1, :count]
        block *= _MINIMA[0, :count]
        np.minimum(least, block.min(0), out=least)
    return least


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key per band: a mix of the band's number and its ``rows`` minima."""
    parts = minima(hashes, bands * rows).reshape(bands, rows)
    mixed = _second(parts + _MINIMA[1, :rows]) * _MINIMA[0, :rows]
    return _second(mixed.sum(1, dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def wide_fingerprint(hashes: np.ndarray) -> list[int]:
    """SimHash of ``64 * FP_WORDS`` bits as signed words, each of other hash bits of the same shingles."""
    words = [hashes]
    for _ in range(FP_WORDS - 1):
        words.append(_second(words[-1] ^ np.uint64(0xA0761D6478BD642F)))
    parts = np.stack(words, 1).astype("<u8").view(np.uint8)
    counts = np.zeros(BITS * FP_WORDS, np.int64)
    for at in range(0, len(parts), 255):  # counts of a block fit into a byte
        counts += np.add.reduce(np.unpackbits(parts[at : at + 255], axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8").tolist()


def parity(hashes: np.ndarray) -> list[int]:
    """A bit per cell, set if an odd number of a set's hashes lies there: two sets differ in at least as many hashes as bits."""
    cells = _second(hashes ^ np.uint64(0x9FB21C651E98DF25)) % np.uint64(64 * len(_ODD))
    odd = np.bincount(cells.astype(np.int64), minlength=64 * len(_ODD)) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def _digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def sketches(docs: DataFrame, words: int, bands: int, rows: int, id_col: str, text_col: str = "text") -> DataFrame:
    """``id, digest, size, keys, fp0.., odd0..``: digest and size of a text's set of shingles, band keys, wide fingerprint, parities."""
    texts = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    kinds = {"digest": "binary", "size": "int", "keys": "binary", **dict.fromkeys([*_FPS, *_ODD], "bigint")}
    out = texts.select("id", *[F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()]).schema
    arrow = (pa.binary(), pa.int32(), pa.binary(), *[pa.int64()] * len([*_FPS, *_ODD]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[tuple] = []
            for t in b.column(1):
                hashes = np.unique(shingle_hashes(t.as_py(), words))
                found.append((_digest(hashes), len(hashes), band_keys(hashes, bands, rows).tobytes(), *wide_fingerprint(hashes), *parity(hashes)))
            columns = [pa.array([r[k] for r in found], kind) for k, kind in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["id", *kinds])

    return texts.mapInArrow(run, out)


#: bits of a filter per id, and 32,768-bit pieces of it at most (16 MB, which are broadcast)
FILTER_BITS, FILTER_PIECES = 16, 4096


def among(rows: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """The rows whose id may be among ``ids``: none of those is missed, and few others come along.

    The ids travel as a bitmap of their hashes, of bounded size, so rows stay where they are.
    """
    pieces = min(FILTER_PIECES, max(1, -(-ids.count() * FILTER_BITS // 32_768)))
    bit = F.pmod(F.xxhash64(id_col), F.lit(pieces * 32_768).cast("long"))
    piece, place = F.floor(bit / 32_768).cast("int"), F.pmod(bit, F.lit(32_768)).cast("long")
    # dealt before they are grouped, else every task sends all pieces
    dealt = ids.select(piece.alias("piece"), place.alias("place")).repartition("piece")
    bits = stored(dealt.groupBy("piece").agg(F.bitmap_construct_agg("place").alias("bits")), "bits")
    octet = F.conv(F.hex(F.substring("bits", (F.shiftright("place", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    of = rows.withColumn("piece", piece).withColumn("place", place).join(F.broadcast(bits), "piece")
    return of.filter(octet.bitwiseAND(F.call_function("shiftleft", F.lit(1), F.pmod("place", F.lit(8)).cast("int"))) != 0).select(*rows.columns)


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """``text`` -> ``digest, hashes``: a text's different shingle hashes in order, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), words)) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_digest(h) for h in sets], pa.binary()), pa.array([h.tobytes() for h in sets], pa.binary())], ["digest", "hashes"]
            )

    return texts.select("text").mapInArrow(run, "digest binary, hashes binary")


_BUCKET = ["key", "node", "label", "size", *_FPS]
_BUCKET_DDL = "key long, node long, label long, size int, " + ", ".join(f"{c} long" for c in _FPS)


def _in_buckets(nodes: DataFrame, begin: int, end: int, also: list[str] | None = None) -> DataFrame:
    """A row per node and band from ``begin`` to ``end``; rows of a bucket share ``key``."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            keys = np.frombuffer(b"".join(b.column(0).to_pylist()), np.int64).reshape(len(b), -1)
            for band in range(begin, end):
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, band].copy()), *b.columns[1:]], [*_BUCKET, *also])

    also = also or []
    ddl = ", ".join([_BUCKET_DDL, *[f"{c} long" for c in also]])
    return nodes.select("keys", *_BUCKET[1:], *also).mapInArrow(spread, ddl).repartition("key")


class _Discard:
    """Which pairs of rows may reach the similarity: other labels, sizes that allow it, fingerprints within the distance."""

    def __init__(self, similarity: float, distance: int):
        self.similarity, self.distance, self.references = similarity, distance, pivots(BITS * FP_WORDS)

    def __call__(self, label: np.ndarray, size: np.ndarray, fps: np.ndarray, i: np.ndarray, j: np.ndarray, odd: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        able = (label[i] != label[j]) & (np.minimum(size[i], size[j]) >= self.similarity * np.maximum(size[i], size[j]))
        i, j = i[able], j[able]
        if odd is not None and len(i):  # exact: no pair of this similarity differs in so many hashes
            room = (1 - self.similarity) / (1 + self.similarity) * (size[i].astype(np.int64) + size[j])
            able = np.bitwise_count(odd[i] ^ odd[j]).sum(1, dtype=np.int64) <= room + 1e-3
            i, j = i[able], j[able]
        if not len(i):
            return i, j
        used, at = np.unique(np.concatenate([i, j]), return_inverse=True)  # pivot distances only of rows in such pairs
        near = _near(fps[used], distance_table(fps[used], self.references), at[: len(i)], at[len(i) :], self.distance)
        return i[near], j[near]


def _pairs(node: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], ["a", "b"])


def leader_pairs(nodes: DataFrame, begin: int, end: int, similarity: float, distance: int) -> DataFrame:
    """``keys, node, label, size, fp0..`` -> pairs ``a, b`` of each bucket's leader with one node of every other label in it.

    Rows are streamed from sorted partitions and only the leader is held, so a bucket may
    have any size; it gives fewer pairs than it has labels.
    """
    discard = _Discard(similarity, distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, before = None, None  # the open bucket's first row, and the last row's key and label
        for b in batches:
            if not len(b):
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if lead is None:
                lead, before = [c[:1] for c in columns], (columns[0][0], columns[2][0])
            columns = [np.concatenate(c) for c in zip(lead, columns, strict=True)]
            key, node, label, size = columns[:4]
            starts = np.r_[True, key[1:] != key[:-1]]
            other = np.r_[False, label[1:] != np.r_[before[1], label[1:-1]]]
            leader = np.maximum.accumulate(np.where(starts, np.arange(len(key)), 0))
            j = np.flatnonzero(other & ~starts)
            i, j = discard(label, size, np.stack(columns[4:], 1).view(np.uint64), leader[j], j)
            if len(i):
                yield _pairs(node, i, j)
            lead, before = [c[leader[-1]][None] for c in columns], (key[-1], label[-1])

    # labels of a bucket lie together, in another order in every bucket
    dealt = _in_buckets(nodes, begin, end).sortWithinPartitions("key", F.xxhash64("key", "label"), "label", "node")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def bucket_pairs(nodes: DataFrame, begin: int, end: int, similarity: float, distance: int) -> DataFrame:
    """All pairs ``a, b`` with different labels of all buckets that may reach the similarity.

    A task holds the rows of one bucket, and compares a bounded number of pairs at once;
    parity sketches discard, beside the fingerprints, only what can't be similar.
    """
    discard = _Discard(similarity, distance)

    def found(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, node, label, size, *words = (np.concatenate(c) for c in zip(*parts, strict=True))
        fps, odd = np.stack(words[:FP_WORDS], 1).view(np.uint64), np.stack(words[FP_WORDS:], 1).view(np.uint64)
        ends = np.flatnonzero(np.r_[key[1:] != key[:-1], True]) + 1
        # labels are sorted in a bucket: a row meets those after its label's last
        run = np.flatnonzero(np.r_[(key[1:] != key[:-1]) | (label[1:] != label[:-1]), True]) + 1
        stop, after = np.repeat(ends, np.diff(np.r_[0, ends])), np.repeat(run, np.diff(np.r_[0, run]))
        later = stop - after
        total, at = np.cumsum(later), 0
        while at < len(key):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _PAIRS, "right")))
            n = later[at:to]
            i = np.repeat(np.arange(at, to), n)
            j = np.repeat(after[at:to], n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            i, j = discard(label, size, fps, i, j, odd)
            if len(i):
                yield _pairs(node, i, j)
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for b in batches:
            part = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if not len(part[0]):
                continue
            last = np.flatnonzero(part[0] != part[0][-1])  # rows of the last bucket wait for the next batch
            cut = int(last[-1]) + 1 if len(last) else 0
            if held and held[-1][0][-1] != part[0][0]:
                yield from found(held)
                held = []
            if cut:
                yield from found([*held, [c[:cut] for c in part]])
                held = []
            held.append([c[cut:] for c in part])
        if held:
            yield from found(held)

    dealt = _in_buckets(nodes, begin, end, _ODD).sortWithinPartitions("key", "label", "node")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b`` whose sets ``node, hashes`` have at least this Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def similar_groups(
    docs: DataFrame, words: int, similarity: float, id_col: str, text_col: str = "text",
    bands: int = 32, rows: int = 8, first: int = 8, deviations: float = 3.0,
) -> DataFrame:
    """``id_col, component_id`` of every row: the smallest id reachable over pairs of at least this Jaccard similarity.

    Similarity is that of sets of word shingles, and exact: sketches only draw the pairs that
    are compared.  Sets that agree on a band of minima meet in a bucket; of a bucket's pairs
    the sizes and the fingerprints, first their pivot distances, discard what lies beyond
    ``deviations`` of the distance at that similarity.  Pairs of one component need no
    comparison, so buckets first pair their leader with one member of every label: in the
    ``first`` bands, then, with the components of these as labels, in the others.  Then all
    pairs of a bucket between different components follow.  Texts with equal sets meet once,
    null and empty ones too; very long ones are hashed in blocks.  An empty table gives no
    rows, and other columns are not read.  Ids are of any type that has an order, not null;
    rows repeated with their id keep their rows, and are one if their text is the same.
    """
    distance = distance_for(similarity, BITS * FP_WORDS, deviations)
    known = stored(sketches(docs, words, bands, rows, id_col, text_col), "sketches")
    grouped = known.groupBy("digest").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("size", "keys", *_FPS, *_ODD)])
    nodes = stored(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbers are stored with the nodes
    texts = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))

    def compared(pairs: DataFrame) -> DataFrame:
        """The pairs that are similar, from the texts of their nodes."""
        needed = nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node").select("id", "digest", "node")
        needed = stored(needed, "needed")
        sets = shingle_sets(among(texts, needed.select("id")), words)
        once = sets.groupBy("digest").agg(F.first("hashes").alias("hashes"))  # an id may be repeated, and others come along
        sets = stored(once.join(needed, "digest").select("node", "hashes"), "sets")
        return similar(pairs, sets, similarity)

    links = found = None
    for begin, end, drawn in ((0, first, leader_pairs), (first, bands, leader_pairs), (0, bands, bucket_pairs)):
        named = nodes.withColumn("component", F.col("node")) if found is None else nodes.join(found, "node", "left")
        pairs = stored(drawn(named.withColumn("label", F.coalesce("component", "node")), begin, end, similarity, distance), "drawn")
        if pairs.isEmpty():
            continue
        more = compared(pairs)
        links = stored(more if links is None else links.unionByName(more), "links")
        found = components(links)
    if found is None:
        return known.join(nodes.select("digest", F.col("id").alias("component_id")), "digest").select(F.col("id").alias(id_col), "component_id")
    named = nodes.join(found, "node", "left").select("digest", "id", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    classes = named.join(least, "component").select("digest", "component_id")
    return known.select("id", "digest").join(classes, "digest").select(F.col("id").alias(id_col), "component_id")


# ------------------------------------------------------------------ components


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from every node of the edges ``a, b``: ``node, component``.

    Large-star and small-star rounds until nothing changes.  Neighbours are reduced to
    minima and joined back, so a hub of any degree is never collected; every round ends in
    a table in the shared folder.
    """
    edges = stored(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        # large star: larger neighbours point to the smallest neighbour
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.filter("a <> b").distinct(), "edges")  # a > b from here
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        # small star: smaller neighbours and the node itself point to the smallest
        step = large.join(small, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            small.select("a", F.col("m").alias("b"))
        )
        edges = stored(step.filter("a <> b").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
        before = tuple(now)


def near_duplicates(
    docs: DataFrame, words: int, distance: int, masks: list[int] | None = None, bits: int = BITS, distinct: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``id_col, fp, fp2, component_id`` of every row: the smallest id reachable over links.

    Fingerprints of at most ``distance`` differing bits are linked; ``masks`` defaults to
    tables that miss no such pair of 64-bit fingerprints.  Null and empty texts have
    fingerprint zero and are linked like any other; texts shorter than ``words`` are one
    shingle.  Equal fingerprints meet once, so copies of any number cost nothing more.
    Rows repeated with their id keep their rows; a null id never is the smallest while
    there is another.  An empty table gives no rows; other columns are not read.
    """
    fps = stored(fingerprints(docs, words, bits, distinct, id_col, text_col), "fingerprints")
    # a null id can't name a component: such rows take part where another row has their fingerprint
    nodes = stored(fps.groupBy("fp", "fp2").agg(F.min(id_col).cast("long").alias("node")).filter("node is not null"), "nodes")
    found = components(links(nodes, distance, masks if masks is not None else block_masks(distance), bits))
    classes = nodes.join(found, "node", "left").select("fp", "fp2", F.coalesce("component", "node").alias("component_id"))
    return fps.join(classes, ["fp", "fp2"], "left").select(id_col, "fp", "fp2", "component_id")
