"""The few Arrow UDFs: work Spark has no expression for.  All are vectorised in and out."""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import lexicon as lx


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def _codes(values: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(values), max(width, 1)), dtype=np.uint32)
    for row, value in enumerate(values):
        out[row, : len(value)] = np.frombuffer(value.encode("utf-32-le"), dtype=np.uint32)
    return out


def jaro_winkler_batch(left: pd.Series, right: pd.Series) -> np.ndarray:
    """Jaro-Winkler for a whole batch of pairs, one numpy step per left character.

    Window ``max // 2 - 1``; common prefix of up to four characters always counts.
    """
    rows = len(left)
    n1 = left.str.len().to_numpy(dtype=np.int64)
    n2 = right.str.len().to_numpy(dtype=np.int64)
    if rows == 0:
        return np.zeros(0)
    a, b = _codes(left, n1.max()), _codes(right, n2.max())
    window = np.maximum(n1, n2) // 2 - 1
    columns = np.arange(b.shape[1])
    hit1 = np.zeros(a.shape, dtype=bool)
    hit2 = np.zeros(b.shape, dtype=bool)
    row_ids = np.arange(rows)
    for i in range(a.shape[1]):
        free = (
            (b == a[:, i : i + 1])
            & ~hit2
            & (columns >= (i - window)[:, None])
            & (columns <= (i + window)[:, None])
            & (columns < n2[:, None])
            & (i < n1)[:, None]
        )
        found = free.any(axis=1)
        hit1[:, i] = found
        hit2[row_ids[found], free.argmax(axis=1)[found]] = True
    matches = hit1.sum(axis=1)
    # stable argsort moves matched characters to the front in text order
    order1 = np.argsort(~hit1, axis=1, kind="stable")
    order2 = np.argsort(~hit2, axis=1, kind="stable")
    width = min(a.shape[1], b.shape[1])
    m1 = np.take_along_axis(a, order1, axis=1)[:, :width]
    m2 = np.take_along_axis(b, order2, axis=1)[:, :width]
    swaps = ((m1 != m2) & (np.arange(width) < matches[:, None])).sum(axis=1) / 2.0
    head = min(4, width)
    same = (a[:, :head] == b[:, :head]) & (np.arange(head) < np.minimum(n1, n2)[:, None])
    prefix = np.cumprod(same, axis=1).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = (matches / n1 + matches / n2 + (matches - swaps) / matches) / 3
    score = np.where((matches == 0) | (window < 0), 0.0, jaro + prefix * 0.1 * (1 - jaro))
    return np.where((left == right).to_numpy(), 1.0, score)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(jaro_winkler_batch(left.fillna(""), right.fillna("")))


@F.pandas_udf(T.IntegerType())
def word_edit_distance(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    """Word-level Levenshtein distance."""

    def distance(ref: str, hyp: str) -> int:
        target = np.array(hyp.split(), dtype=object)
        steps = np.arange(len(target) + 1)
        row = steps.copy()
        for i, word in enumerate(ref.split(), start=1):
            cost = np.minimum(row[1:] + 1, row[:-1] + (target != word))
            best = np.concatenate(([i], cost))
            # insertions: running minimum of best[j] - j
            row = np.minimum.accumulate(best - steps) + steps
        return int(row[-1])

    return pd.Series([distance(r or "", h or "") for r, h in zip(reference, hypothesis)])


_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_BOILERPLATE = re.compile(lx.BOILERPLATE_CLASS, re.IGNORECASE)
_CONTENT = re.compile(lx.CONTENT_CLASS, re.IGNORECASE)


class _PageText(HTMLParser):
    """Collect text per wanted region while skipping unwanted subtrees."""

    REGIONS = ("main", "article", "role", "content", "body", "all")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, tuple[str, ...]]] = []
        self.skipping = 0
        self.active: set[str] = {"all"}
        self.seen: set[str] = {"all"}
        self.text: dict[str, list[str]] = {name: [] for name in self.REGIONS}

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        found = dict(attrs)
        classes = (found.get("class") or "").split()
        skip = tag in lx.DROPPED_TAGS or any(_BOILERPLATE.search(c) for c in classes)
        starts = []
        if not skip and not self.skipping:
            wanted = [("main", tag == "main"), ("article", tag == "article"), ("body", tag == "body")]
            if tag == "div":
                wanted.append(("role", found.get("role") == "main"))
                wanted.append(("content", any(_CONTENT.search(c) for c in classes)))
            starts = [name for name, yes in wanted if yes and name not in self.seen]
            self.seen.update(starts)
            self.active.update(starts)
        self.skipping += skip
        self.open.append((tag, skip, tuple(starts)))

    def handle_endtag(self, tag):
        if not any(entry[0] == tag for entry in self.open):
            return
        while self.open:
            name, skip, starts = self.open.pop()
            self.skipping -= skip
            self.active.difference_update(starts)
            if name == tag:
                break

    def handle_data(self, data):
        piece = data.strip()
        if piece and not self.skipping:
            for name in self.active:
                self.text[name].append(piece)


def _tidy(text: str, max_chars: int) -> str:
    text = re.sub(r"\n{3,}", "\n\n", text)
    text = re.sub(r"[ \t]{2,}", " ", text).strip()
    return text if len(text) <= max_chars else text[:max_chars] + "..."


def main_text(html: str, min_chars: int, max_chars: int) -> str | None:
    """Readable text of one page, or null when there is too little of it."""
    page = _PageText()
    page.feed(html)
    page.close()
    regions = {name: "\n".join(parts) for name, parts in page.text.items()}
    for name in ("main", "article", "role", "content"):
        if len(regions[name]) >= min_chars:
            return _tidy(regions[name], max_chars)
    rest = _tidy(regions["body"] if "body" in page.seen else regions["all"], max_chars)
    if len(rest) >= min_chars:
        return rest
    return html if len(html) >= min_chars else None


#: pages of a batch that are Python strings at a time
PAGES_AT_ONCE = 32


def page_text_udf(min_chars: int, max_chars: int):
    @F.arrow_udf(T.StringType())
    def extract(html: pa.Array) -> pa.Array:
        # a few pages at a time: neither the pages nor the texts of a batch become Python strings together
        def texts(few: pa.Array) -> list[str | None]:
            return [None if (h := page.as_py()) is None else main_text(h, min_chars, max_chars) for page in few]

        parts = [pa.array(texts(html.slice(i, PAGES_AT_ONCE)), type=pa.string()) for i in range(0, len(html), PAGES_AT_ONCE)]
        return pa.concat_arrays(parts) if parts else pa.array([], type=pa.string())

    return extract
