"""Removal of repeated byte strings by sorting suffixes at chosen anchors.

A byte goes if a string of ``length`` bytes that covers it also starts earlier in the
corpus.  Of every such string the k-gram with the smallest hash is its anchor (the first
one of equals).  Equal strings have their anchors at the same place, so it is enough to
sort the contexts of anchors whose k-gram occurs again: what follows an anchor, and what
precedes it read backwards.  Two strings with their anchor x bytes behind their start are
equal if the anchors' left contexts agree on x bytes and the right ones on length - x;
both follow from the sorted orders and their common prefix lengths.

Contexts are ordered by deep-shallow sorting: multikey quicksort on eight-byte digits to
``SHALLOW`` bytes, then blind tries for the groups that still agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import shards as sh

LENGTH = 100
GRAM = 24
SHALLOW = 32
_CHUNK = 1 << 16
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_LOW = np.uint64(0xFFFFFFFF)

# ------------------------------------------------------------------ anchors


def _mixed(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = a * _ODD[0]
    h ^= h >> np.uint64(29)
    h += b * _ODD[1]
    h ^= h >> np.uint64(31)
    h += c * _ODD[2]
    h *= _ODD[0]
    h ^= h >> np.uint64(32)
    return h


def gram_hashes(data: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
    """64-bit hashes of the 24-byte grams at positions."""
    n = len(data) - 7
    words = np.ndarray((n,), "<u8", data, strides=(1,))
    if isinstance(at, slice):
        return _mixed(words[at.start : at.stop], words[at.start + 8 : at.stop + 8], words[at.start + 16 : at.stop + 16])
    return _mixed(words[at], words[at + 8], words[at + 16])


def _window_minimum(values: np.ndarray, wide: int) -> np.ndarray:
    size = 1
    while 2 * size <= wide:
        values = np.minimum(values[: len(values) - size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (wide - size)], values[wide - size :]) if wide > size else values


def anchors(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of string starts with the same anchor: (document, first start, last start, anchor).

    Positions are bytes of the shard; strings never leave their document.
    """
    wide = length - GRAM + 1
    sizes = np.diff(bounds)
    usable = np.flatnonzero(sizes >= length)
    none = np.empty(0, np.int64)
    if not len(usable):
        return none, none, none, none
    total = len(data) - length + 1
    firsts, lasts, found = [], [], []
    valid = np.zeros(total + 1, np.int8)
    valid[bounds[usable]] = 1
    ends = bounds[usable + 1] - length + 1
    valid[ends[ends <= total]] -= 1
    valid = np.cumsum(valid[:total], dtype=np.int8).astype(bool)
    previous, was = -1, False
    for at in range(0, total, _CHUNK):
        stop = min(at + _CHUNK, total)
        h = gram_hashes(data, slice(at, stop + wide - 1))
        h &= ~_LOW
        h |= np.arange(at, at + len(h), dtype=np.uint64)
        best = (_window_minimum(h, wide) & _LOW).astype(np.int64)
        ok = valid[at:stop]
        begins = ok & (np.r_[best[0] != previous, best[1:] != best[:-1]] | ~np.r_[was, ok[:-1]])
        firsts.append(np.flatnonzero(begins) + at)
        found.append(best[begins])
        previous, was = int(best[-1]), bool(ok[-1])
    first, anchor = np.concatenate(firsts), np.concatenate(found)
    doc = np.searchsorted(bounds, first, "right") - 1
    until = bounds[doc + 1] - length  # last start of the document
    last = np.minimum(np.r_[first[1:] - 1, until[-1:]], until)
    return doc, first, last, anchor


def contexts(data: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """One row per anchor: what follows it (length bytes), then what precedes it backwards; zeros beyond the strings."""
    wide = length - GRAM
    out = np.zeros((len(anchor), length + wide), np.uint8)
    after, before = last + length - anchor, anchor - first
    for i in range(0, len(anchor), _CHUNK):
        a, s = anchor[i : i + _CHUNK, None], slice(i, i + _CHUNK)
        k = np.arange(length)
        out[s, :length] = data[np.minimum(a + k, len(data) - 1)] * (k < after[s, None])
        k = np.arange(wide)
        out[s, length:] = data[np.maximum(a - 1 - k, 0)] * (k < before[s, None])
    return out


def _digests(rows: np.ndarray, *more: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8)))).view("<u8")
    odd = (np.random.default_rng(11).integers(0, 1 << 62, words.shape[1] + len(more)).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
    h = np.zeros(len(rows), np.uint64)
    for j in range(words.shape[1]):
        w = words[:, j] * odd[j]
        w ^= w >> np.uint64(32)
        h = (h + w) * odd[j]
    for j, x in enumerate(more):
        h = (h ^ (h >> np.uint64(29)) ^ x.astype(np.uint64)) * odd[words.shape[1] + j]
    return h


def first_equal(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For every row the first row with the same bytes and bounds, itself if there is none."""
    h = _digests(rows, low, high)
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    same = first[inverse]
    equal = (rows == rows[same]).all(1) & (low == low[same]) & (high == high[same])
    return np.where(equal, same, np.arange(len(rows)))


# ------------------------------------------------------------------ deep-shallow sorting


def _blind_trie(rows: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of byte strings of one length, and each one's common prefix with the one before.

    Inner nodes are [depth, children by byte]; a descent looks at branching bytes only, one
    comparison with the leaf it ends in gives the place of the new string.
    """
    size = len(rows[0])
    root: list = [0]  # a leaf is a list of positions in rows
    inner: dict[int, tuple[int, dict]] = {}  # id(node) -> (depth, children)
    numbers = [int.from_bytes(r) for r in rows]
    for i in range(1, len(rows)):
        s, path, node = rows[i], [], root
        while (at := inner.get(id(node))) is not None:
            depth, children = at
            path.append((node, depth, s[depth]))
            node = children.get(s[depth])
            if node is None:
                node = next(iter(children.values()))
        other = node[0]
        apart = numbers[i] ^ numbers[other]
        if not apart:
            node.append(i)
            continue
        common = size - (apart.bit_length() + 7) // 8
        below = None
        for k, (n, depth, _) in enumerate(path):
            if depth >= common:
                below = k
                break
        if below is not None and path[below][1] == common:
            inner[id(path[below][0])][1][s[common]] = [i]
            continue
        split: list = [None]
        under = path[below][0] if below is not None else node
        parent = (below if below is not None else len(path)) - 1
        inner[id(split)] = (common, {rows[other][common]: under, s[common]: [i]})
        if parent < 0:
            root = split
        else:
            inner[id(path[parent][0])][1][path[parent][2]] = split
    order, lcps = [], []
    stack = [(root, 0)]
    while stack:
        node, lcp = stack.pop()
        at = inner.get(id(node))
        if at is None:
            order += node
            lcps += [lcp] + [size] * (len(node) - 1)
        else:
            depth, children = at
            keys = sorted(children, reverse=True)
            stack += [(children[k], depth) for k in keys[:-1]] + [(children[keys[-1]], lcp)]
    return order, lcps


def sort_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of equally long byte rows and the common prefix of each with the row before."""
    n, size = rows.shape
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    shallow = min(SHALLOW, size) // 8 * 8
    digits = np.ascontiguousarray(rows[:, :shallow]).view(">u8").astype(np.uint64) if shallow else np.empty((n, 0), np.uint64)
    order = np.arange(n)
    group = np.zeros(n, np.int64)  # of the rows in order: first place of the group
    lcp = np.zeros(n, np.int64)
    for j in range(digits.shape[1]):
        sizes = np.bincount(group, minlength=n)
        at = np.flatnonzero(sizes[group] > 1)  # only groups that this digit can split
        if not len(at):
            break
        members, g, d = order[at], group[at], digits[order[at], j]
        move = np.lexsort((d, g))
        members, d = members[move], d[move]
        order[at] = members
        new = np.r_[True, (d[1:] != d[:-1]) | (g[1:] != g[:-1])]
        inside = np.r_[False, g[1:] == g[:-1]] & new  # split from the row before by this digit
        bits = np.where(inside, d ^ np.r_[d[:1], d[:-1]], 0)
        lcp[at[inside]] = 8 * j + (_leading_zero_bytes(bits))[inside]
        group[at] = np.maximum.accumulate(np.where(new, at, 0))
    begins = np.flatnonzero(group == np.arange(n))
    ends = np.r_[begins[1:], n]
    deep = ends - begins > 1
    for b, e in zip(begins[deep].tolist(), ends[deep].tolist(), strict=True):
        members = order[b:e]
        if e - b == 2:  # the usual trie: two leaves
            x, y = rows[members[0]], rows[members[1]]
            differ = np.flatnonzero(x != y)
            if not len(differ):
                lcp[b + 1] = size
            else:
                lcp[b + 1] = differ[0]
                if x[differ[0]] > y[differ[0]]:
                    order[b:e] = members[::-1]
            continue
        local, found = _blind_trie([r.tobytes() for r in rows[members]])
        order[b:e] = members[local]
        lcp[b + 1 : e] = found[1:]
    return order, lcp


def _leading_zero_bytes(x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), 8, np.int64)
    for k in range(8):
        out[(x >> np.uint64(8 * k)) > 0] = 7 - k
    return out


def repeated_starts(rows: np.ndarray, low: np.ndarray, high: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which strings also start earlier: (row, x) for rows in corpus order, x the anchor's place in the string.

    ``low`` and ``high`` bound x for each row.
    """
    wide = length - GRAM + 1
    after, before = length - low, high
    classes = []
    for part, sizes in ((rows[:, :length], after), (rows[:, length:], before)):
        # the size as last byte puts a context before those that begin with it
        order, lcp = sort_rows(np.concatenate([part, sizes[:, None].astype(np.uint8)], 1))
        ranked = sizes[order]
        classes.append((order, np.minimum(lcp, np.minimum(ranked, np.r_[0, ranked[:-1]]))))  # padding is no text
    dup = np.zeros((len(rows), wide), bool)
    (r_order, r_lcp), (l_order, l_lcp) = classes
    right, left = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    for x in range(wide):
        at = np.flatnonzero((low <= x) & (x <= high))
        if len(at) < 2:
            continue
        right[r_order] = np.cumsum(r_lcp < length - x)
        left[l_order] = np.cumsum(l_lcp < x)
        key = right[at] * (len(rows) + 1) + left[at]
        move = np.argsort(key, kind="stable")  # the first of a class is the earliest
        k = key[move]
        dup[at[move[1:][k[1:] == k[:-1]]], x] = True
    return dup


# ------------------------------------------------------------------ jobs

_MEMBER = np.dtype([("null", "u1"), ("id", "<i8"), ("shard", "<i8"), ("doc", "<i4"), ("anchor", "<i8"), ("low", "u1"), ("high", "u1")])
_SPAN = np.dtype([("doc", "<i4"), ("first", "<i8"), ("last", "<i8")])


def _bucket_of(h: np.ndarray, count: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(count)).astype(np.int64)


def _short(h: np.ndarray) -> np.ndarray:
    """The hash bits that bucket numbers don't use; a rare clash only adds a candidate."""
    return h & np.uint64((1 << 40) - 1)


def _five(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_five(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _groups(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1], True]) if len(keys) else np.zeros(1, int)
    for b, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(keys[order[b]]), order[b:e]


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, spans, kept`` of every row.

    ``spans`` are the maximal removed byte ranges (first, behind last) and ``kept`` the
    other bytes.  Null texts are empty and keep nothing to remove; texts shorter than
    ``length`` never lose a byte; rows with equal ids count as earlier and later in the
    order in which they are packed, rows without id come last.  An empty table gives no
    rows; other columns are not read.
    """
    packed = sh.make_shards(docs, id_col, text_col)
    count = sh.buckets(packed)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, _ in sh.each_shard(batches):
            _, _, _, anchor = anchors(s.bytes, s.bounds, length)
            h, n = np.unique(gram_hashes(s.bytes, anchor) if len(anchor) else np.empty(0, np.uint64), return_counts=True)
            rows = [(b, s.number, _five(_short(h[at])), np.packbits(n[at] > 1).tobytes()) for b, at in _groups(_bucket_of(h, count))]
            yield _batch(rows, ["bucket", "shard", "grams", "often"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()])

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, list[dict]] = {}
        for b in batches:
            for r in b.to_pylist():
                asked.setdefault(r["bucket"], []).append(r)
        for rows in asked.values():
            grams = [_from_five(r["grams"]) for r in rows]
            often = [g[np.unpackbits(np.frombuffer(r["often"], np.uint8), count=len(g)).astype(bool)] for g, r in zip(grams, rows, strict=True)]
            every, n = np.unique(np.concatenate([*grams, *often]), return_counts=True)
            again = every[n > 1]
            if len(again):
                found = [(r["shard"], r["bucket"], _five(g[_among(g, again)])) for r, g in zip(rows, grams, strict=True)]
                yield _batch([(s, b.to_bytes(4, "little") + g) for s, b, g in found if g], ["shard", "answer"], [pa.int64(), pa.binary()])

    questions = packed.mapInArrow(ask, "bucket int, shard long, grams binary, often binary")
    answers = sh.by_bucket(questions).mapInArrow(repeated, "shard long, answer binary")

    piece = ["bucket", "shard", "data"], [pa.int32(), pa.int64(), pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, (found,) in sh.each_shard(batches):
            again = {int.from_bytes(x[:4], "little"): np.sort(_from_five(x[4:])) for x in found or []}
            doc, first, last, anchor = anchors(s.bytes, s.bounds, length)
            if not again or not len(anchor):
                continue
            h = gram_hashes(s.bytes, anchor)
            keep = np.zeros(len(h), bool)
            for b, at in _groups(_bucket_of(h, count)):
                if b in again:
                    keep[at] = _among(_short(h[at]), again[b])
            doc, first, last, anchor, h = (v[keep] for v in (doc, first, last, anchor, h))
            rows = contexts(s.bytes, first, last, anchor, length)
            low, high = (anchor - last).astype(np.uint8), (anchor - first).astype(np.uint8)
            same = first_equal(rows, low, high)
            copy = same != np.arange(len(rows))  # equal to an earlier one of this shard, whole
            if copy.any():
                spans = np.zeros(int(copy.sum()), _SPAN)
                spans["doc"], spans["first"], spans["last"] = doc[copy], first[copy] - s.bounds[doc[copy]], last[copy] - s.bounds[doc[copy]]
                yield _batch([(s.number % count, s.number, sh.pack(spans.tobytes()))], *piece)  # with its shard: ready spans
            member = np.zeros(len(rows), _MEMBER)
            ids = np.array([0 if i is None else i for i in s.ids], np.int64)
            null = np.array([i is None for i in s.ids], np.uint8)
            member["null"], member["id"], member["shard"], member["doc"] = null[doc], ids[doc], s.number, doc
            member["anchor"], member["low"], member["high"] = anchor - s.bounds[doc], low, high
            left = np.flatnonzero(~copy)
            for b, at in _groups(_bucket_of(h[left], count)):
                at = left[at]
                data = len(at).to_bytes(8, "little") + member[at].tobytes() + rows[at].tobytes()
                yield _batch([(b, None, sh.pack(data))], *piece)

    pieces = sh.with_answers(packed, answers).mapInArrow(cut, "bucket int, shard long, data binary")
    size = length + length - GRAM

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for b in batches:
            for bucket, shard, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if shard is not None:
                    yield _batch([(shard, data)], ["shard", "answer"], [pa.int64(), pa.binary()])
                else:
                    held.setdefault(bucket, []).append(data)
        for blobs in held.values():
            members, rows = [], []
            for data in map(sh.unpack, blobs):
                n = int.from_bytes(data[:8], "little")
                members.append(np.frombuffer(data, _MEMBER, n, 8))
                rows.append(np.frombuffer(data, np.uint8, n * size, 8 + n * _MEMBER.itemsize).reshape(n, size))
            member, row = np.concatenate(members), np.concatenate(rows)
            order = np.lexsort((member["anchor"], member["doc"], member["shard"], member["id"], member["null"]))
            member, row = member[order], row[order]
            low, high = member["low"].astype(np.int64), member["high"].astype(np.int64)
            dup = repeated_starts(row, low, high, length)
            edge = np.diff(np.pad(dup, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            i, x_low = np.nonzero(edge == 1)
            _, x_high = np.nonzero(edge == -1)
            spans = np.zeros(len(i), _SPAN)
            spans["doc"], spans["first"], spans["last"] = member["doc"][i], member["anchor"][i] - (x_high - 1), member["anchor"][i] - x_low
            out = [(shard, sh.pack(spans[at].tobytes())) for shard, at in _groups(member["shard"][i])]
            yield _batch(out, ["shard", "answer"], [pa.int64(), pa.binary()])

    spans = sh.by_bucket(pieces).mapInArrow(compare, "shard long, answer binary")
    result = "id long, n_bytes long, n_removed long, n_spans long, spans array<struct<first:long,behind:long>>, kept binary"
    span_type = pa.list_(pa.struct([("first", pa.int64()), ("behind", pa.int64())]))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, (found,) in sh.each_shard(batches):
            start = np.zeros(len(s.text) + 1, np.int16)  # a byte lies in at most ``length`` spans
            for x in map(sh.unpack, found or []):
                span = np.frombuffer(x, _SPAN)
                base = s.bounds[span["doc"]]
                np.add.at(start, base + span["first"], 1)
                np.add.at(start, base + span["last"] + length, -1)
            gone = np.cumsum(start[:-1], dtype=np.int16) > 0
            data, rows = s.bytes, []
            for k, key in enumerate(s.ids):
                b, e = int(s.bounds[k]), int(s.bounds[k + 1])
                mask = gone[b:e]
                if not mask.any():
                    rows.append((key, e - b, 0, 0, [], s.text[b:e]))
                    continue
                edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8))).reshape(-1, 2)
                rows.append((key, e - b, int(mask.sum()), len(edge), [{"first": int(x), "behind": int(y)} for x, y in edge], data[b:e][~mask].tobytes()))
            yield _batch(rows, ["id", "n_bytes", "n_removed", "n_spans", "spans", "kept"], [pa.int64()] * 4 + [span_type, pa.binary()])

    return sh.with_answers(packed, spans).mapInArrow(remove, result).withColumnRenamed("id", id_col)


