"""Language of texts by a bidirectional gated recurrent network over bytes.

Both directions read windows of ``STEPS`` bytes; every position gets label probabilities
from the two states beside it, and a document's probabilities are the mean over all its
positions.  The network is trained here, in numpy, by backpropagation through time on a
bounded sample of labelled documents; texts are labelled whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS = 64
HIDDEN = 8
#: the training sample: documents per language, and windows of each document
DOCUMENTS_PER_LANGUAGE, WINDOWS_PER_DOCUMENT, LANGUAGES = 400, 12, 256
EPOCH_STEPS, BATCH, RATE, SEED = 300, 128, 0.02, 5
#: windows labelled together
WIDE = 4096
UNDETERMINED = "und"

Weights = dict[str, np.ndarray]


@dataclass
class Network:
    languages: list[str]
    weights: Weights


def _squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place of tanh: far cheaper, and a slope that is known from the value."""
    return x / (1 + np.abs(x))


def _slope(value: np.ndarray) -> np.ndarray:
    return (1 - np.abs(value)) ** 2


def _gate(x: np.ndarray) -> np.ndarray:
    return 0.5 * _squash(x) + 0.5


def _gate_slope(value: np.ndarray) -> np.ndarray:
    return 0.5 * _slope(2 * value - 1)


# ------------------------------------------------------------------ training


def initial(labels: int, hidden: int = HIDDEN, seed: int = SEED) -> Weights:
    rng = np.random.default_rng(seed)
    w: Weights = {}
    for d in "fb":
        w[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * hidden))
        w[f"u{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
        w[f"n{d}"] = np.zeros(hidden)
        w[f"v{d}"] = rng.normal(0, 0.3, (hidden, labels))
    w["c"] = np.zeros(labels)
    return {k: v.astype(np.float32) for k, v in w.items()}


def _states(w: Weights, d: str, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """States (batch, time, hidden) of one direction and what backpropagation needs."""
    n, steps = x.shape
    hidden = len(w[f"n{d}"])
    h = np.zeros((n, hidden), np.float32)
    out, kept = np.empty((n, steps, hidden), np.float32), []
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        g, a = w[f"x{d}"][x[:, t]], h @ w[f"u{d}"]
        z, r = _gate(g[:, :hidden] + a[:, :hidden]), _gate(g[:, hidden : 2 * hidden] + a[:, hidden : 2 * hidden])
        m = a[:, 2 * hidden :] + w[f"n{d}"]
        new = _squash(g[:, 2 * hidden :] + r * m)
        kept.append((t, h, z, r, m, new))
        h = (new + z * (h - new)) * mask[:, t, None]
        out[:, t] = h
    return out, kept


def loss_and_gradients(w: Weights, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, Weights]:
    """Mean cross-entropy over positions and its gradients by backpropagation through time."""
    states = {d: _states(w, d, x, mask) for d in "fb"}
    logits = states["f"][0] @ w["vf"] + states["b"][0] @ w["vb"] + w["c"]
    logits -= logits.max(-1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(-1, keepdims=True)
    total = mask.sum()
    loss = -(np.log(np.take_along_axis(p, y[:, None, None], 2)[..., 0] + 1e-12) * mask).sum() / total
    dlogits = p.copy()
    dlogits[np.arange(len(y)), :, y] -= 1
    dlogits *= (mask / total)[..., None]
    grads: Weights = {"c": dlogits.sum((0, 1))}
    seen = np.zeros((x.size, 256), np.float32)
    seen[np.arange(x.size), x.ravel()] = 1
    for d in "fb":
        out, kept = states[d]
        hidden = out.shape[2]
        grads[f"v{d}"] = out.reshape(-1, hidden).T @ dlogits.reshape(-1, dlogits.shape[2])
        from_labels = dlogits @ w[f"v{d}"].T
        du, dn, dg = np.zeros_like(w[f"u{d}"]), np.zeros_like(w[f"n{d}"]), np.empty((*x.shape, 3 * hidden), np.float32)
        carried = np.zeros_like(out[:, 0])
        for t, h, z, r, m, new in reversed(kept):
            dh = (carried + from_labels[:, t]) * mask[:, t, None]
            dpre_z = dh * (h - new) * _gate_slope(z)
            dpre_n = dh * (1 - z) * _slope(new)
            dpre_r = dpre_n * m * _gate_slope(r)
            da = np.concatenate([dpre_z, dpre_r, dpre_n * r], 1)
            dg[:, t] = np.concatenate([dpre_z, dpre_r, dpre_n], 1)
            du += h.T @ da
            dn += da[:, 2 * hidden :].sum(0)
            carried = dh * z + da @ w[f"u{d}"].T
        grads[f"u{d}"], grads[f"n{d}"] = du, dn
        grads[f"x{d}"] = seen.T @ dg.reshape(-1, 3 * hidden)
    return float(loss), grads


def train(windows: np.ndarray, lengths: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = EPOCH_STEPS, seed: int = SEED) -> Network:
    """Adam on random batches in which every language is equally likely."""
    w = initial(len(languages), seed=seed)
    mean, square = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    rng = np.random.default_rng(seed)
    of = [np.flatnonzero(labels == k) for k in range(len(languages))]
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(languages), BATCH)
        rows = np.array([of[k][rng.integers(len(of[k]))] for k in pick])
        mask = (np.arange(windows.shape[1]) < lengths[rows, None]).astype(np.float32)
        _, grads = loss_and_gradients(w, windows[rows], mask, labels[rows])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = RATE * min(1.0, 3 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            g = g / max(1.0, norm)
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.01 * (g * g - square[k])
            w[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Network(languages, w)


# ------------------------------------------------------------------ labelling


def _squash_in(x: np.ndarray, room: np.ndarray) -> None:
    np.abs(x, out=room)
    room += 1
    x /= room


class Labeller:
    """The network with features in rows and many windows in columns."""

    def __init__(self, net: Network):
        self.labels = len(net.languages)
        w = net.weights
        self.hidden = hidden = len(w["nf"])
        self.x = {d: np.ascontiguousarray(w[f"x{d}"].T) for d in "fb"}
        self.u = {d: np.ascontiguousarray(w[f"u{d}"].T) for d in "fb"}
        self.n = {d: w[f"n{d}"][:, None].copy() for d in "fb"}
        self.v = np.ascontiguousarray(np.concatenate([w["vf"], w["vb"]]).T)
        self.c = w["c"][:, None]

    def positions(self, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Label probabilities (label, time, window) of windows given as (time, window) bytes."""
        steps, n = windows.shape
        hidden = self.hidden
        states = np.empty((steps, 2 * hidden, n), np.float32)
        full = int(lengths.min(initial=steps))
        g, a, size = (np.empty((3 * hidden, n), np.float32) for _ in range(3))
        for half, d in enumerate("fb"):
            h = np.zeros((hidden, n), np.float32)
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                np.take(self.x[d], windows[t], axis=1, out=g, mode="clip")
                np.matmul(self.u[d], h, out=a)
                gates = g[: 2 * hidden]
                gates += a[: 2 * hidden]
                _squash_in(gates, size[: 2 * hidden])
                gates *= 0.5
                gates += 0.5
                new = a[2 * hidden :]
                new += self.n[d]
                new *= gates[hidden:]
                new += g[2 * hidden :]
                _squash_in(new, size[2 * hidden :])
                h -= new
                h *= gates[:hidden]
                h += new
                if t >= full:
                    h *= lengths > t
                states[t, half * hidden : (half + 1) * hidden] = h
        p = np.matmul(self.v, states)  # (time, label, window)
        p += self.c
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        return p.transpose(1, 0, 2)

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean label probabilities of whole texts, one row each; empty texts get zeros."""
        sizes = np.array([len(t) for t in texts], np.int64)
        counts = -(-sizes // STEPS)
        padded = np.zeros((int(counts.sum()), STEPS), np.uint8)
        owner = np.repeat(np.arange(len(texts)), counts)
        begin = np.cumsum(counts) - counts
        for k, t in enumerate(texts):
            flat = padded[begin[k] : begin[k] + counts[k]].reshape(-1)
            flat[: len(t)] = np.frombuffer(t, np.uint8)
        lengths = np.full(len(padded), STEPS, np.int64)
        last = (begin + counts - 1)[sizes > 0]
        lengths[last] = sizes[sizes > 0] - (counts[sizes > 0] - 1) * STEPS
        order = np.argsort(-lengths, kind="stable")  # padded windows together: the others need no mask
        sums = np.zeros((len(texts), self.labels))
        for at in range(0, len(order), WIDE):
            rows = order[at : at + WIDE]
            n = lengths[rows]
            p = self.positions(np.ascontiguousarray(padded[rows].T).astype(np.intp), n)
            if n[-1] < STEPS:
                p = p * (np.arange(STEPS)[:, None] < n)
            for k, values in enumerate(p.sum(1, dtype=np.float64)):
                sums[:, k] += np.bincount(owner[rows], values, len(texts))
        return sums / np.maximum(sizes, 1)[:, None]


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """Train on the rows where ``learn`` holds, the label isn't null and the text has bytes.

    The sample is the first ``DOCUMENTS_PER_LANGUAGE`` different texts by hash of each of the
    ``LANGUAGES`` labels with most of them, with ``WINDOWS_PER_DOCUMENT`` windows evenly over
    each; only these windows reach the driver, however often an id or a text is repeated.  None if there is nothing to learn from.
    """
    learned = learn & F.col(lang_col).isNotNull() & (F.octet_length(text_col) > 0)
    rows = docs.filter(learned).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    digested = rows.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    narrow = digested.groupBy("lang", "digest").agg(F.min("id").alias("id"))
    most = narrow.groupBy("lang").agg(F.count(F.lit(1)).alias("texts")).orderBy(F.desc("texts"), "lang").limit(LANGUAGES)
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "digest")
    ranked = narrow.join(F.broadcast(most.select("lang")), "lang", "left_semi").withColumn("rank", F.row_number().over(by_hash))
    chosen = F.broadcast(ranked.filter(F.col("rank") <= DOCUMENTS_PER_LANGUAGE).select("lang", "digest"))  # bounded by the sample size
    sample = digested.join(chosen, ["lang", "digest"], "left_semi").groupBy("lang", "digest").agg(F.min("id").alias("id"), F.first("text").alias("text"))
    sample = sample.select("id", "lang", "text")
    out = "lang string, id string, at long, bytes binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for key, lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = text.encode()
                last = max(0, len(data) - STEPS)
                for at in sorted({last * k // max(1, WINDOWS_PER_DOCUMENT - 1) for k in range(WINDOWS_PER_DOCUMENT)}):
                    found.append((lang, str(key), at, data[at : at + STEPS]))
            columns = list(zip(*found, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary())],
                ["lang", "id", "at", "bytes"],
            )

    got = sorted(tuple(r) for r in sample.mapInArrow(cut, out).collect())
    if not got:
        return None
    languages = sorted({r[0] for r in got})
    windows = np.zeros((len(got), STEPS), np.uint8)
    for row, r in zip(windows, got, strict=True):
        row[: len(r[3])] = np.frombuffer(bytes(r[3]), np.uint8)
    label = {k: i for i, k in enumerate(languages)}
    return train(windows, np.array([len(r[3]) for r in got]), np.array([label[r[0]] for r in got]), languages)


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``id_col, *carry, lang_pred, score`` of every whole text.

    ``score`` is the pooled probability of the language.  A null text, a text without a
    letter (empty ones included), and every text if no network could be trained, is
    ``und`` with score 0.  Ties go to the first language in code point order; repeated rows
    are labelled alike; an empty table gives no rows.  Only the text decides.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"), *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)], F.when(has_letter(text), text).alias("text")
    )
    out = rows.drop("text").withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(net) if net else None
        for b in batches:
            for at in range(0, len(b), 512):  # bounds the windows in memory
                part = b.slice(at, 512)
                texts = [t.as_py() for t in part.column(part.num_columns - 1)]
                names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
                if labeller:
                    p = labeller.documents([(t or "").encode() for t in texts])
                    best = p.argmax(1)
                    known = [t is not None for t in texts]
                    names = [net.languages[k] if ok else UNDETERMINED for k, ok in zip(best, known, strict=True)]
                    scores = np.where(known, np.clip(p.max(1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [f.name for f in out]
                )

    return rows.mapInArrow(run, out).withColumnsRenamed({"id": id_col, **{f"carry_{i}": c for i, c in enumerate(carry)}})
