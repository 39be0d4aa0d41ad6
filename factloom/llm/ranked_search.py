"""Ranked lexical search: the hybrid of term-at-a-time and document-at-a-time.

Documents are packed once into stored segments: inverted lists of some megabytes of text,
in document order, with term frequencies.  A segment answers a query in two steps.  Its
short lists are added up term by term into one sorted list of accumulators.  That list then
takes part as one bounded iterator, beside the long lists, in a document-at-a-time pass with
maximum scores: lists whose bounds together stay under the lowest score still wanted name no
candidates, they are only looked up, and runs of documents that can't reach it are skipped.

Every task keeps the best documents of each query over all its segments, and one window
ranks what the tasks found.  A common word is a long list inside each segment, never a key.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, whole
from .shards import pack, unpack

SEGMENT_BYTES = 8 << 20
#: a list is short if it holds less than this share of the segment's documents
SHORT = 1 / 32
#: documents of a run that is looked at or skipped as a whole
RUN = 512
#: queries that one pass over the index answers, and bytes of their terms; they travel to every task
ROUND_QUERIES, ROUND_BYTES = 16_384, 32 << 20
TERM = r"[0-9a-z\u0080-\x{10FFFF}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes of terms stay, A-Z in lower case, and all others separate; bytes of longer characters are all of terms
_TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())

_SEGMENT = "docs long, terms long, ids array<long>, sizes binary, vocabulary array<string>, ends binary, postings binary, counts binary"


def document_terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def _segment(held: list[tuple[int | None, bytes]]) -> tuple | None:
    held.sort(key=lambda r: (r[0] is None, r[0] or 0))
    ids, sizes, names, counts, widths = [], [], [], [], []
    for i, text in held:
        found = document_terms(text)
        if not found:
            continue
        tf = Counter(found)
        ids.append(i)
        sizes.append(len(found))
        names.extend(tf)
        counts.extend(tf.values())
        widths.append(len(tf))
    if not ids:
        return None
    number: dict[bytes, int] = {}
    terms = np.fromiter((number.setdefault(t, len(number)) for t in names), np.int64, len(names))
    vocabulary = sorted(number)
    place = np.empty(len(number), np.int64)
    place[[number[t] for t in vocabulary]] = np.arange(len(number))
    order = np.argsort(place[terms], kind="stable")
    docs = np.repeat(np.arange(len(ids), dtype=np.int32), widths)[order]
    ends = np.cumsum(np.bincount(terms, minlength=len(number))[[number[t] for t in vocabulary]])
    return (
        len(ids), sum(sizes), ids, pack(np.array(sizes, np.int64).tobytes()), [t.decode() for t in vocabulary], pack(ends.astype(np.int64).tobytes()),
        pack(docs.tobytes()), pack(np.array(counts, np.int32)[order].tobytes()),
    )


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored segments of whole texts; documents without a term (null and empty ones) are in none."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], _SEGMENT).schema)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.encode(whole(text_col), "UTF-8").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held.append((i, text.as_py()))
                size += len(held[-1][1])
                if size >= SEGMENT_BYTES:
                    yield from made(held)
                    held, size = [], 0
        yield from made(held)

    def made(held: list) -> Iterator[pa.RecordBatch]:
        if row := _segment(held):
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    return stored(rows.mapInArrow(run, _SEGMENT), "index")


@dataclass
class Lists:
    """One segment, its lists scored on demand."""

    ids: list[int | None]
    numbers: dict[str, int]
    ends: np.ndarray
    postings: np.ndarray
    counts: np.ndarray
    m: np.ndarray

    def __post_init__(self):
        self.kept: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray] | None] = {}

    def scored(self, term: str) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Documents of a term, their scores for weight one, and the largest of each run of documents."""
        if term not in self.kept:
            k = self.numbers.get(term)
            if k is None:
                self.kept[term] = None
            else:
                part = slice(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))
                docs, tf = self.postings[part], self.counts[part].astype(np.int64)
                score = (1_000_000_000 * tf) // (1000 * tf + 12 * self.m[docs])
                self.kept[term] = docs, score, run_bounds(docs, score, len(self.ids))
        return self.kept[term]


def run_bounds(docs: np.ndarray, score: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((size + RUN - 1) // RUN, np.int64)
    np.maximum.at(out, docs // RUN, score)
    return out


def accumulated(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Short lists added up, in document order."""
    docs = np.concatenate([d for d, _ in lists])
    score = np.concatenate([s for _, s in lists])
    order = np.argsort(docs, kind="stable")
    docs, score = docs[order], score[order]
    first = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
    return docs[first], np.add.reduceat(score, first)


def added(docs: np.ndarray, of: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Scores that a list gives to documents: each is searched, what lies between is skipped."""
    there, score = of
    at = np.minimum(np.searchsorted(there, docs), len(there) - 1)
    return np.where(there[at] == docs, score[at], 0)


def best_of_segment(lists: Lists, weights: dict[str, int], k: int, least: int) -> list[tuple[int, int]]:
    """(document, score) of the ``k`` best with a score of at least ``max(least, 1)``; ties to the first document."""
    size = len(lists.ids)
    short, long = [], []
    for term, w in weights.items():
        got = lists.scored(term)
        if got is not None and w > 0:
            (short if len(got[0]) < SHORT * size else long).append((got[0], got[1] * w, got[2] * w))
    least = max(least, 1)
    if short:
        docs, sums = accumulated([(d, s) for d, s, _ in short])
        if len(sums) >= k:  # an accumulator is a lower bound of its document's score
            least = max(least, int(np.partition(sums, -k)[-k]))
        long.append((docs, sums, run_bounds(docs, sums, size)))
    if not long:
        return []
    long.sort(key=lambda x: int(x[2].max()))
    bounds = np.cumsum([int(x[2].max()) for x in long])
    in_runs = np.sum([x[2] for x in long], 0)
    edges = [np.searchsorted(x[0], np.arange(len(in_runs) + 1) * RUN) for x in long]
    top_docs, top_scores = np.empty(0, np.int64), np.empty(0, np.int64)
    for run in np.flatnonzero(in_runs >= least):
        if in_runs[run] < least:  # it has grown since
            continue
        first = int(np.searchsorted(bounds, least))  # lists before it can't reach it together
        parts = [(x[0][e[run] : e[run + 1]], x[1][e[run] : e[run + 1]]) for x, e in zip(long[first:], edges[first:], strict=True) if e[run] < e[run + 1]]
        if not parts:
            continue
        docs, sums = accumulated(parts)
        for i in range(first - 1, -1, -1):
            open_ = sums + bounds[i] >= least
            docs, sums = docs[open_], sums[open_]
            if not len(docs):
                break
            sums = sums + added(docs, long[i][:2])
        found = sums >= least
        if found.any():
            top_docs, top_scores = np.concatenate([top_docs, docs[found]]), np.concatenate([top_scores, sums[found]])
            if len(top_docs) > k:
                keep = np.sort(np.lexsort((top_docs, -top_scores))[:k])
                top_docs, top_scores = top_docs[keep], top_scores[keep]
            if len(top_docs) == k:
                least = max(least, int(top_scores.min()))
    return list(zip(top_docs.tolist(), top_scores.tolist(), strict=True))


def weight(df: int, total: int) -> int:
    return math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The ``k`` highest-scoring documents of every item: ``item_col, rank, id_col, score``.

    Ties go to the smaller id (null ids last).  Null and empty texts have no term: such
    documents are never found, such items find nothing, and an empty table on either side
    gives no rows.  Rows that repeat an id are documents, or items, of their own.  Whole
    texts count.  Columns other than those named are not read, whatever their names.

    Items go to the tasks in rounds of bounded size; every round reads the index once.
    """
    spark = docs.sparkSession
    index = build_index(docs, id_col, text_col)
    terms = F.regexp_extract_all(F.translate(whole(text_col), _UPPER, _LOWER), F.lit(TERM), F.lit(0))
    queries = stored(items.select(F.monotonically_increasing_id().alias("query"), F.col(item_col).alias("item"), terms.alias("terms")), "queries")
    asked = queries.select("query", F.explode("terms").alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("times"))
    df = _vocabulary(index).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    asked = stored(asked.join(df, "term"), "asked")
    docs_all, terms_all = index.agg(F.sum("docs"), F.sum("terms")).first()
    n, size = asked.agg(F.countDistinct("query"), F.sum(F.octet_length("term") + 24)).first()
    rounds = max(1, -(-n // ROUND_QUERIES), -(-(size or 0) // ROUND_BYTES))
    out = None
    for r in range(rounds):
        rows = asked.filter(F.pmod(F.xxhash64("query"), F.lit(rounds)) == r).collect()  # bounded by the round
        found = _round(index, rows, k, docs_all or 0, terms_all or 0)
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(queries.select("query", "item"), "query").select(F.col("item").alias(item_col), "rank", F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "score")


def _vocabulary(index: DataFrame) -> DataFrame:
    """``term, n`` documents of each term of each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                ends = np.frombuffer(unpack(b.column(1)[i].as_py()), np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0)[i].values, pa.array(np.diff(ends, prepend=0))], ["term", "n"])

    return index.select("vocabulary", "ends").mapInArrow(run, "term string, n long")


def _round(index: DataFrame, rows: list, k: int, docs_all: int, terms_all: int) -> DataFrame:
    """(query, id, score): the ``k`` best of every query of a round in each task."""
    weights: dict[int, dict[str, int]] = {}
    for r in rows:
        weights.setdefault(r["query"], {})[r["term"]] = r["times"] * weight(r["df"], docs_all)
    sent = index.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, bool, int]]] = {}
        wanted = {t for w in sent.value.values() for t in w}
        for b in batches:
            for i in range(len(b)):
                ids, sizes, vocabulary, ends, postings, counts = (b.column(c)[i].as_py() for c in range(6))
                n = np.frombuffer(unpack(sizes), np.int64)
                m = 75 + (25 * n * docs_all) // terms_all
                numbers = {t: at for at, t in enumerate(vocabulary) if t in wanted}
                lists = Lists(ids, numbers, np.frombuffer(unpack(ends), np.int64), np.frombuffer(unpack(postings), np.int32), np.frombuffer(unpack(counts), np.int32), m)
                for query, terms in sent.value.items():
                    have = best.get(query, [])
                    got = best_of_segment(lists, terms, k, -have[-1][0] if len(have) == k else 1)
                    if got:
                        best[query] = sorted(have + [(-s, ids[d] is None, ids[d] or 0) for d, s in got])[:k]
        flat = [(q, None if null else i, -s) for q, rows in best.items() for s, null, i in rows]
        for at in range(0, len(flat), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*flat[at : at + 20_000], strict=True)], ["query", "id", "score"])

    return index.select("ids", "sizes", "vocabulary", "ends", "postings", "counts").mapInArrow(run, "query long, id long, score long")
