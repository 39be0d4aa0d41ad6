"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions; every decision has a tree of contexts, the bytes before,
most recent first, down to ``DEPTH`` bytes.  A node's counts of zeros and ones give a
Krichevsky-Trofimov estimate; a node mixes it, half and half, with the product of its
children, so the root weighs all depths.  After training, the probability of a decision is
the mixture along its context path, each node weighing its own estimate by its posterior.
A context that training never met takes the estimate of its longest known suffix.

Counts are corpus statistics: shards send the (DEPTH + 1)-grams they hold, with how often
training texts have them, to the bucket of the last two context bytes, which holds every
tree below those bytes.  Only the nodes of depth 0 and 1, at most 257 x 255, pass the
driver.  Shards get back the log probability of each distinct gram they asked for, and the
corpus count of each distinct word.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shards as sh
from .common import checkpointed

DEPTH = 6
#: marks the end of a text; no UTF-8 text has this byte
END = 0xFF
#: stands before the first byte of a text
START = 0xFE
_PIECE = 1 << 20

# ------------------------------------------------------------------ estimates


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of the gamma function for x > 0: shifted Stirling series."""
    x = np.asarray(x, np.float64)
    shift = np.ones_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift = np.where(low, shift * y, shift)
        y = np.where(low, y + 1, y)
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(shift)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of any sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def own_weight(kt: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Posterior weight of a node's own estimate against its children's product."""
    return 1 / (1 + np.exp(np.clip(children - kt, -700, 700)))


# ------------------------------------------------------------------ grams

# A gram is one number: DEPTH context bytes, most recent one highest, then the byte itself lowest.


def gram_codes(data: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Codes of the byte at every position behind the first ``depth``."""
    n = len(data) - depth
    code = np.zeros(n, np.uint64)
    for k in range(1, depth + 1):
        code <<= np.uint64(8)
        code |= data[depth - k : depth - k + n]
    code <<= np.uint64(8)
    code |= data[depth : depth + n]
    return code


def framed(s: sh.Shard, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes with start marks before and an end mark behind every text; and each text's first gram."""
    lower = s.text.lower()
    head, tail = bytes([START]) * depth, bytes([END])
    pieces = []
    for k in range(len(s.ids)):
        pieces += [head, lower[s.bounds[k] : s.bounds[k + 1]], tail]
    sizes = np.diff(s.bounds) + depth + 1
    begins = np.concatenate([[0], np.cumsum(sizes)])
    return np.frombuffer(b"".join(pieces), np.uint8), begins


def shard_grams(s: sh.Shard, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of a shard, sorted, and how often its training texts (flag set) have them."""
    data, begins = framed(s, depth)
    train = np.array(s.flags, bool)
    codes, counts = [], []
    for part, weight in ((train, 1), (~train, 0)):
        runs = np.flatnonzero(np.diff(np.r_[False, part, False].astype(np.int8))).reshape(-1, 2)
        if not len(runs):
            continue
        found = np.concatenate([gram_codes(data[begins[x] : begins[y]], depth) for x, y in runs])
        found = found[(found & np.uint64(0xFF)) != START]  # start marks are no text
        found.sort()
        begin = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
        codes.append(found[begin])
        counts.append(np.diff(np.r_[begin, len(found)]) * weight)
    if not codes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return _summed(np.concatenate(codes), np.concatenate(counts))


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    begin = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.empty(0, np.int64)
    return codes[begin], np.add.reduceat(counts, begin) if len(codes) else counts


# ------------------------------------------------------------------ trees


class Depth:
    """Trees at one depth over the sorted (context, byte) pairs that occur there.

    For each of the eight decisions: ``node`` of every pair, and of every node its counts,
    estimate, own weight and mixture.  Pairs in order are also in order of every prefix of
    their byte, so nodes are runs.
    """

    def __init__(self, pairs: np.ndarray, counts: np.ndarray):
        self.pairs, self.counts = pairs, counts
        self.node, self.first, self.zeros, self.ones, self.kt, self.weight, self.mixed = ([] for _ in range(7))
        for j in range(8):
            key = pairs >> np.uint64(8 - j)
            new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.empty(0, bool)
            first = np.flatnonzero(new)
            bit = ((pairs >> np.uint64(7 - j)) & np.uint64(1)).astype(np.int64)
            zeros, ones = (np.add.reduceat(counts * x, first) if len(first) else counts[:0] for x in (1 - bit, bit))
            kt = np.where(zeros + ones > 0, log_kt(zeros, ones), 0.0)
            for values, value in zip(
                (self.node, self.first, self.zeros, self.ones, self.kt, self.weight, self.mixed),
                (np.cumsum(new) - 1, first, zeros, ones, kt, np.ones(len(first)), kt), strict=True,
            ):
                values.append(value)

    def weigh(self, j: int, product: np.ndarray) -> None:
        """Mix decision j's nodes with the products of their children."""
        self.weight[j] = own_weight(self.kt[j], product)
        self.mixed[j] = np.logaddexp(self.kt[j], product) - np.log(2)
        self.mixed[j][self.zeros[j] + self.ones[j] == 0] = 0.0

    def estimate(self, j: int, at: np.ndarray, bit: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        """Probability of a bit at nodes; ``deeper`` is that of the next depth, nan where unknown."""
        zeros, ones, w = self.zeros[j][at], self.ones[j][at], self.weight[j][at]
        own = (np.where(bit, ones, zeros) + 0.5) / (zeros + ones + 1.0)
        p = np.where(np.isnan(deeper), own, w * own + (1 - w) * deeper)
        return np.where(zeros + ones > 0, p, deeper)


def grow(codes: np.ndarray, counts: np.ndarray, shallowest: int, depth: int) -> list[tuple[Depth, np.ndarray]]:
    """Weighted depths from ``depth`` up to ``shallowest``, each with the pair of every gram in it."""
    out = [(Depth(codes, counts), np.arange(len(codes)))]
    for d in range(depth - 1, shallowest - 1, -1):
        below, of_gram = out[-1]
        pairs = ((below.pairs >> np.uint64(16)) << np.uint64(8)) | (below.pairs & np.uint64(0xFF))
        own, up = np.unique(pairs, return_inverse=True)
        level = Depth(own, np.bincount(up, below.counts, len(own)).astype(np.int64))
        for j in range(8):
            parent = level.node[j][up[below.first[j]]]
            level.weigh(j, np.bincount(parent, below.mixed[j], len(level.kt[j])))
        out.append((level, up[of_gram]))
    return out


@dataclass
class Top:
    """Nodes of depth 0 and 1 of the whole corpus."""

    zero: Depth
    one: Depth


def top_depths(counts: dict[int, int], mixed: dict[tuple[int, int], float]) -> Top:
    """``counts`` by c1 * 256 + byte; ``mixed`` the log products of the depth-2 nodes by (decision, (c1 * 256 + byte) >> (8 - decision))."""
    pairs = np.array(sorted(counts), np.uint64)
    one = Depth(pairs, np.array([counts[k] for k in sorted(counts)], np.int64))
    for j in range(8):
        keys = (pairs[one.first[j]] >> np.uint64(8 - j)).tolist()
        one.weigh(j, np.array([mixed.get((j, k), 0.0) for k in keys]))
    own, up = np.unique(pairs & np.uint64(0xFF), return_inverse=True)
    zero = Depth(own, np.bincount(up, one.counts, len(own)).astype(np.int64))
    for j in range(8):
        zero.weigh(j, np.bincount(zero.node[j][up[one.first[j]]], one.mixed[j], len(zero.kt[j])))
    return Top(zero, one)


def _known(level: Depth, keys: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of keys (pairs without their last 8 - j bits) in a small depth, and which exist."""
    have = level.pairs[level.first[j]] >> np.uint64(8 - j)
    if not len(have):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
    return at, have[at] == keys


def gram_scores(codes: np.ndarray, counts: np.ndarray, top: Top, depth: int) -> np.ndarray:
    """log10 probability of every gram's byte in its context; ``codes`` sorted, all grams of their subtrees."""
    total = np.zeros(len(codes))
    below = grow(codes, counts, 2, depth)
    for j in range(8):
        bit = ((codes >> np.uint64(7 - j)) & np.uint64(1)) == 1
        p = np.full(len(codes), np.nan)
        for level, pair in below:
            p = level.estimate(j, level.node[j][pair], bit, p)
        pair = ((codes >> np.uint64(8 * depth)) << np.uint64(8)) | (codes & np.uint64(0xFF))
        for level, keys in ((top.one, pair >> np.uint64(8 - j)), (top.zero, (codes & np.uint64(0xFF)) >> np.uint64(8 - j))):
            at, there = _known(level, keys, j)
            if len(level.pairs):
                p = np.where(there, level.estimate(j, at, bit, p), p)
        total += np.log10(np.where(np.isnan(p), 0.5, p))
    return total


class Lookup:
    """Open-addressing table of distinct 64-bit codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.bits = max(4, int(2 * len(codes)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(codes), dtype=np.int32), self._home(codes)
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]  # the last one of several stays
            again = self.slots[slot] != left
            left, slot = left[again], (slot[again] + 1) & (len(self.slots) - 1)

    def _home(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Position of every code; -1 if it isn't there."""
        slot = self._home(codes)
        out = self.slots[slot]
        left = np.flatnonzero((out >= 0) & (self.codes[out] != codes)) if len(self.codes) else np.empty(0, np.int64)
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.slots) - 1)
            out[left] = self.slots[slot[left]]
            left = left[(out[left] >= 0) & (self.codes[out[left]] != codes[left])]
        return out


def _score_texts(s: sh.Shard, codes: np.ndarray, values: np.ndarray, depth: int) -> np.ndarray:
    """Sum of the gram scores of every text of a shard."""
    data, begins = framed(s, depth)
    total = np.zeros(len(s.ids))
    table, values = Lookup(codes), np.r_[values, 0.0]  # -1: grams of start marks
    for at in range(0, len(data) - depth, _PIECE):
        got = values[table.find(gram_codes(data[at : at + _PIECE + depth], depth))]
        stop = at + depth + len(got)
        k = int(np.searchsorted(begins, at + depth, "right")) - 1
        cuts = begins[k : int(np.searchsorted(begins, stop, "left"))] - at - depth
        cuts = np.maximum(cuts, 0)
        total[k : k + len(cuts)] += np.add.reduceat(got, cuts)
    return total


# ------------------------------------------------------------------ jobs


def _word_bucket(word: bytes, count: int) -> int:
    return zlib.crc32(word) % count


def _answer(kind: bytes, keys: bytes, values: bytes) -> bytes:
    return kind + len(keys).to_bytes(8, "little") + keys + values


def _read_answer(data: bytes) -> tuple[bytes, bytes, bytes]:
    n = int.from_bytes(data[1:9], "little")
    return data[:1], data[9 : 9 + n], data[9 + n :]


def _by_bucket(codes: np.ndarray, depth: int, count: int) -> Iterator[tuple[int, np.ndarray]]:
    """Positions of grams for each bucket: grams with the same last two context bytes go together."""
    pair = codes >> np.uint64(8 * (depth - 1))
    bucket = (((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(count)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True]) if len(codes) else [0]
    for b, e in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(bucket[order[b]]), order[b:e]


def _numbers(values: np.ndarray) -> bytes:
    """Sorted numbers as packed differences."""
    return _planes(np.diff(values, prepend=values[:1] * 0).astype("<u8"))


def _read_numbers(data: bytes) -> np.ndarray:
    return np.cumsum(_read_planes(data, "<u8"), dtype=np.uint64)


def _planes(values: np.ndarray) -> bytes:
    """All first bytes, then all second ones, and so on: equal bytes lie together."""
    return sh.pack(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes())


def _read_planes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(sh.unpack(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_ASK = pa.schema([("bucket", pa.int32()), ("shard", pa.int64()), ("gram", pa.bool_()), ("keys", pa.binary()), ("counts", pa.binary())])
_ANSWER = pa.schema([("shard", pa.int64()), ("answer", pa.binary())])


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """Scores of every whole text: ``id_col, held_out, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``.

    Texts count in lower case (A-Z).  ``score`` is the log10 probability of a text's bytes
    and its end by the tree trained on the rows where ``learn`` holds; ``base_score`` is
    that of its words and end by counts of words plus one.  Null texts are empty: only
    their end is scored.  Without any training text every decision is even.  Repeated rows
    count and are scored each; an empty table gives no rows; other columns are not read.
    """
    packed = sh.make_shards(docs, id_col, text_col, learn)
    count = sh.buckets(packed)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, _ in sh.each_shard(batches):
            rows = []
            codes, n = shard_grams(s, depth)
            for b, at in _by_bucket(codes, depth, count):
                rows.append((b, s.number, True, _numbers(codes[at]), _planes(n[at].astype("<u4"))))
            words: Counter[bytes] = Counter()
            every: set[bytes] = set()
            for k, train in enumerate(s.flags):
                found = s.text[s.bounds[k] : s.bounds[k + 1]].lower().split()
                (words if train else every).update(found)
            every |= words.keys()
            deal: dict[int, list[bytes]] = {}
            for w in every:
                deal.setdefault(_word_bucket(w, count), []).append(w)
            for b, ws in deal.items():
                rows.append((b, s.number, False, sh.pack(b" ".join(ws)), sh.pack(np.array([words[w] for w in ws], "<u4").tobytes())))
            yield _rows(rows, _ASK)

    asked = packed.mapInArrow(ask, "bucket int, shard long, gram boolean, keys binary, counts binary")
    # partitions stay as they are, so both passes over the questions need no further shuffle
    asked = checkpointed(sh.by_bucket(asked).sortWithinPartitions("bucket"))

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[dict], list[dict]]]:
        """Gram and word questions of one bucket after the other."""
        held: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if held and r["bucket"] != held[0]["bucket"]:
                    yield [x for x in held if x["gram"]], [x for x in held if not x["gram"]]
                    held = []
                held.append(r)
        if held:
            yield [x for x in held if x["gram"]], [x for x in held if not x["gram"]]

    def all_grams(rows: list[dict]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        codes = [_read_numbers(r["keys"]) for r in rows]
        counts = [_read_planes(r["counts"], "<u4").astype(np.int64) for r in rows]
        if not rows:
            return [], np.empty(0, np.uint64), np.empty(0, np.int64)
        return codes, *_summed(np.concatenate(codes), np.concatenate(counts))

    def all_words(rows: list[dict]) -> Counter[bytes]:
        total: Counter[bytes] = Counter()
        for r in rows:
            counts = np.frombuffer(sh.unpack(r["counts"]), "<u4").tolist()
            for w, n in zip(sh.unpack(r["keys"]).split(), counts, strict=True):
                if n:
                    total[w] += n
        return total

    top_schema = pa.schema([("kind", pa.string()), ("decision", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("mixed", pa.float64())])

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grams, words in group(batches):
            rows = []
            _, codes, n = all_grams(grams)
            pair, c = _summed(((codes >> np.uint64(8 * depth)) << np.uint64(8)) | (codes & np.uint64(0xFF)), n)
            rows += [("count", 0, int(k), int(v), 0.0) for k, v in zip(pair, c, strict=True) if v]
            level, _ = grow(codes, n, 2, depth)[-1]
            for j in range(8):
                first = level.pairs[level.first[j]]
                keys = (((first >> np.uint64(16)) << np.uint64(8)) | (first & np.uint64(0xFF))) >> np.uint64(8 - j)
                own, of = np.unique(keys, return_inverse=True)
                rows += [("mixed", j, int(k), 0, float(v)) for k, v in zip(own, np.bincount(of, level.mixed[j], len(own)), strict=True)]
            total = all_words(words)
            rows += [("tokens", 0, 0, sum(total.values()), 0.0), ("types", 0, 0, len(total), 0.0)]
            yield _rows(rows, top_schema)

    summary = (
        asked.mapInArrow(summarise, "kind string, decision int, key long, n long, mixed double")
        .groupBy("kind", "decision", "key").agg(F.sum("n").alias("n"), F.sum("mixed").alias("mixed"))
        .collect()
    )  # at most 65,536 counts, 65,280 mixtures and two totals
    n_end = int(packed.select(F.sum(F.size(F.filter("flags", lambda f: f)))).first()[0] or 0)
    tokens = n_end + sum(r["n"] for r in summary if r["kind"] == "tokens")
    types = (n_end > 0) + sum(r["n"] for r in summary if r["kind"] == "types")
    top = top_depths(
        {r["key"]: r["n"] for r in summary if r["kind"] == "count"}, {(r["decision"], r["key"]): r["mixed"] for r in summary if r["kind"] == "mixed"}
    )

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grams, words in group(batches):
            asked_codes, codes, n = all_grams(grams)
            known = gram_scores(codes, n, top, depth).astype("<f4")
            rows = [
                (r["shard"], _answer(b"g", r["keys"], _planes(known[np.searchsorted(codes, own)])))
                for r, own in zip(grams, asked_codes, strict=True)
            ]
            total = all_words(words)
            for r in words:
                values = np.array([total[w] for w in sh.unpack(r["keys"]).split()], "<u8")
                rows.append((r["shard"], _answer(b"w", r["keys"], sh.pack(values.tobytes()))))
            yield _rows(rows, _ANSWER)

    answers = asked.mapInArrow(reply, "shard long, answer binary")
    result = "id long, held_out boolean, n_bytes long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = pa.schema(
        [("id", pa.int64()), ("held_out", pa.bool_()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
         ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, (found,) in sh.each_shard(batches):
            codes, values, counts = [], [], {}
            for kind, keys, answer in map(_read_answer, found or []):
                if kind == b"g":
                    codes.append(_read_numbers(keys))
                    values.append(_read_planes(answer, "<f4"))
                else:
                    counts.update(zip(sh.unpack(keys).split(), np.frombuffer(sh.unpack(answer), "<u8").tolist(), strict=True))
            codes, values = np.concatenate(codes), np.concatenate(values).astype(np.float64)
            sums = _score_texts(s, codes, values, depth)
            logs = {w: float(np.log10((c + 1) / (tokens + types + 1))) for w, c in counts.items()}
            unknown = {w for w, c in counts.items() if not c}
            end = float(np.log10((n_end + 1) / (tokens + types + 1)))
            rows = []
            for k, key in enumerate(s.ids):
                words = s.text[s.bounds[k] : s.bounds[k + 1]].lower().split()
                base = sum(map(logs.__getitem__, words)) + end
                known = len(words) - sum(map(unknown.__contains__, words)) + (n_end > 0)
                rows.append((key, not s.flags[k], int(s.bounds[k + 1] - s.bounds[k]), len(words) + 1, known, tokens, base, float(sums[k])))
            yield _rows(rows, out)

    scored = sh.with_answers(packed, answers).mapInArrow(finish, result)
    bits = -F.col("score") / F.log10(F.lit(2.0)) / (F.col("n_bytes") + 1)
    return scored.withColumn("bits_per_byte", bits).withColumnRenamed("id", id_col)
