"""SentencePiece encoding and decoding of merge-type (BPE) models.

A text's segmentation is found without a merge queue.  Aho-Corasick gives every piece that
starts at a position; the longest is tried first and accepted when it can stand beside the
piece before it, that is when merging both from their characters gives these two pieces
again.  A prefix has one valid segmentation, so a position from which nothing led to the
end is marked in a bit field and never entered again.
"""

from __future__ import annotations

import codecs
import itertools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole

SPACE_MARK = "▁"
#: entries of the two memo tables of a worker, which start again when full
WORDS_KEPT, PAIRS_KEPT = 400_000, 400_000
#: rows of a batch that are worked on together
_ROWS = 1000
#: numbers of characters that are no piece begin here; above all of them
_CHARACTER, _BASE = 1 << 24, 1 << 26


class _Words(dict):
    """Segment after ``lead`` -> its ids as little-endian 32-bit integers."""

    def __init__(self, model: Model, lead: str):
        super().__init__()
        self.model, self.lead = model, lead

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORDS_KEPT:
            self.clear()
        got = self[word] = self.model.segment_ids(self.lead + word)
        return got


class Model:
    """Pieces and scores of a model file; all encoding and decoding is done here."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize("ﬁ  ① a") not in ("ﬁ  ① a", "▁ﬁ▁▁① a"):
            raise ValueError("models with a text normaliser aren't supported")
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = {self.pieces[i]: sp.get_score(i) for i in plain}
        byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_ids = [byte_ids[b] for b in range(256)] if len(byte_ids) == 256 else None
        self.unknown, self.end = sp.unk_id(), sp.eos_id()
        self.is_byte = {i: b for b, i in byte_ids.items()}
        self.as_bytes = [
            bytes([self.is_byte[i]]) if i in self.is_byte else b"" if sp.is_control(i)
            else " ⁇ ".encode() if sp.is_unknown(i) else p.replace(SPACE_MARK, " ").encode()
            for i, p in enumerate(self.pieces)
        ]
        self.control = {i for i, data in enumerate(self.as_bytes) if not data}
        reachable = [p for p in self.ids if self.merge(p) == [p]]
        self.automaton = ahocorasick.Automaton()
        for p in reachable:
            self.automaton.add_word(p, (len(p), self.ids[p]))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.id_bytes = [np.array([i], "<i4").tobytes() for i in range(n)]
        joined = set("".join(p for p in reachable if len(p) > 1))
        # no piece has a space mark behind another character: segments begin at space marks
        self.by_word = all(SPACE_MARK not in p.lstrip(SPACE_MARK) for p in reachable) and "\n" not in joined
        self.after_space, self.at_start = _Words(self, SPACE_MARK), _Words(self, "")
        self.segments = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}\n]+|{SPACE_MARK}+|\n")
        self.line_end = self.at_start["\n"] if self.by_word else b""

    def merge(self, text: str) -> list[str]:
        """Merge characters, best score and then leftmost pair first."""
        parts, scores = list(text), self.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fit(self, a: int, b: int) -> bool:
        """Re-merge two pieces and remember whether both come out again."""
        if len(self.fits) >= PAIRS_KEPT:
            self.fits.clear()
        left, right = self._text(a), self._text(b)
        got = self.fits[a * _BASE + b] = self.merge(left + right) == [left, right]
        return got

    def _text(self, token: int) -> str:
        return self.pieces[token] if token < _CHARACTER else chr(token - _CHARACTER)

    def segment(self, text: str) -> list[int]:
        """Pieces of one segment by backtracking; characters that are no piece have high numbers."""
        n = len(text)
        options: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for last, (length, piece) in self.automaton.iter(text):
            options[last + 1 - length].append((last + 1, piece))
        tokens: list[int] = []
        path: list[tuple[int, int]] = []
        fits, failed, at, choice, before = self.fits, 0, 0, -2, None
        while at < n:
            here = options[at]
            if choice == -2:  # entered for the first time
                if not here or here[0][0] != at + 1:
                    here.insert(0, (at + 1, _CHARACTER + ord(text[at])))
                choice = len(here) - 1
            while choice >= 0:
                end, token = here[choice]
                if not failed >> end & 1:
                    if before is None:
                        break
                    fit = fits.get(before * _BASE + token)
                    if fit or fit is None and self._fit(before, token):
                        break
                choice -= 1
            if choice >= 0:
                path.append((at, choice))
                tokens.append(token)
                before, at, choice = token, end, -2
            else:
                failed |= 1 << at
                at, choice = path.pop()
                choice -= 1
                tokens.pop()
                before = tokens[-1] if tokens else None
        return tokens

    def segment_ids(self, text: str) -> bytes:
        return b"".join([self.id_bytes[t] if t < _CHARACTER else self._spelled(t) for t in self.segment(text)]) if text else b""

    def _spelled(self, token: int) -> bytes:
        """Ids of a character that is no piece: its bytes, or the unknown id."""
        ids = [self.byte_ids[b] for b in self._text(token).encode()] if self.byte_ids is not None else [self.unknown]
        return np.array(ids, "<i4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers, without an end id."""
        if not text:
            return b""
        if not self.by_word:
            return self.segment_ids(SPACE_MARK + text.replace(" ", SPACE_MARK))
        if "  " in text or SPACE_MARK in text or text[0] in " \n":
            marked = SPACE_MARK + text.replace(" ", SPACE_MARK)
            return b"".join(map(self.at_start.__getitem__, self.segments.findall(marked)))
        lines = []
        for k, line in enumerate(text.split("\n")):
            first, *rest = line.split(" ")
            start = self.at_start if k else self.after_space
            lines.append((start[first] if first else b"") + b"".join(map(self.after_space.__getitem__, rest)))
        return self.line_end.join(lines)

    def decode(self, ids: list[int]) -> str:
        """Text of ids: space marks become spaces, the one before the text goes, runs of bytes are joined."""
        first = next((i for i in ids if self.as_bytes[i]), None)
        inner = self.control.intersection(ids[:-1])
        runs = [ids]
        if inner:  # a control id ends a run of bytes
            cuts = [-1, *(k for k, i in enumerate(ids) if i in inner), len(ids)]
            runs = [ids[a + 1 : b] for a, b in itertools.pairwise(cuts)]
        text = "".join(b"".join(map(self.as_bytes.__getitem__, r)).decode("utf-8", "each_byte") for r in runs)
        leads = first is not None and first not in self.is_byte and self.pieces[first].startswith(SPACE_MARK)
        return text[1:] if leads else text


codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))
_MODELS: dict[str, Model] = {}


def load(path: str) -> Model:
    """The model of a file, read once per worker."""
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def _ids_array(found: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(found) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in found], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<i4")))


def encode(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", end: bool = True, round_trip: bool = False
) -> DataFrame:
    """``id_col, ids`` of every whole text, with an end id if asked for.

    ``round_trip`` adds ``decoded``, the text that :meth:`Model.decode` gives for the ids,
    in the same pass.  Null and empty texts have no ids but the end id; texts of any length
    are encoded whole; repeated rows and null ids stay as they are; an empty table gives no
    rows.  No other column is read.
    """
    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    out = rows.select("id", F.lit(None).cast("array<int>").alias("ids"), *[F.lit("").alias("decoded")] * round_trip).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        tail = np.array([model.end], "<i4").tobytes() if end else b""
        for b in batches:
            for at in range(0, len(b), _ROWS):
                part = b.slice(at, _ROWS)
                found = [model.encode(t.as_py()) + tail for t in part.column(1)]
                columns = [part.column(0), _ids_array(found)]
                if round_trip:
                    columns.append(pa.array([model.decode(np.frombuffer(x, "<i4").tolist()) for x in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in out])

    return rows.mapInArrow(run, out).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, ids_col, decoded``: the text of each row's ids; null ids count as none."""
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    out = rows.withColumn("decoded", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for b in batches:
            texts = [model.decode(x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else []) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["id", "ids", "decoded"])

    return rows.mapInArrow(run, out).withColumnsRenamed({"id": id_col, "ids": ids_col})
