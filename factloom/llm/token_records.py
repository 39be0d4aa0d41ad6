"""Token ids as length-delimited binary records with a separate offset index.

A record file is a sequence of frames: payload length (unsigned 64 bits), masked CRC-32 of
these eight bytes, payload, masked CRC-32 of the payload; all numbers little-endian.  The
mask turns the checksum right by 15 bits and adds a constant, so that a checksum stored
inside checksummed data stays harmless.  A payload holds token ids in two bytes each, in
four where the vocabulary has more than 65,536 entries.  The index beside the file holds
id, frame offset, token count and first token number of every record, so that readers can
fetch records in any order.
"""

from __future__ import annotations

import contextlib
import json
import random
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filesystem, shared_path, stored, whole, width

MASK = 0xA282EAD8
INDEX_TYPE = np.dtype([("id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("tokens", "<u4"), ("first", "<u8")])
READ_BYTES = 8 << 20
#: texts encoded together, in characters
ENCODE_CHARS = 1 << 20
WORDS_KEPT = 600_000

# Letters and digits of Latin-1, and the split pattern of byte-level BPE over them.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
_SPLIT = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
#: bytes of Latin-1 that are split alike in every regular expression library
_PLAIN = bytes([9, 10, 13, *range(32, 127), *range(161, 256)])
#: where white space meets white space, words depend on what follows
_RUNS = ("  ", "\n\n", " \n", "\n ", "\t", "\r")


def _plain(text: str) -> bool:
    try:
        return not text.encode("latin-1").translate(None, _PLAIN)
    except UnicodeEncodeError:
        return False


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class ByteBpe(dict):
    """Ids by the tokenizers library; a memo table from parts of texts to their ids.

    Texts of Latin-1 characters are split into the words between which the vocabulary never
    merges, and the library's model encodes each distinct word once; other texts, and all
    texts of tokenizers of another kind, go through the whole library as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.to_str())
        before = kind.get("pre_tokenizer") or {}
        self.by_word = (
            before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
            and not kind.get("normalizer") and not kind.get("truncation") and not kind.get("padding")
        )
        self.special = [t["content"] for t in kind.get("added_tokens", [])]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.model, self.letters = self.tokenizer.model, _byte_letters()

    def __missing__(self, key: str) -> bytes:
        part = key[1:] if key[:1] == "\0" else key if key[:1] == "\n" else " " + key
        ids = [t.id for w in _SPLIT.findall(part) for t in self.model.tokenize(w.encode().decode("latin-1").translate(self.letters))]
        if len(self) >= WORDS_KEPT:
            self.clear()
        got = self[key] = np.array(ids, self.dtype).tobytes()
        return got

    def _parts(self, text: str) -> list[str]:
        """Keys of the parts of a text: its first part is marked, one behind a line end begins with it, others had a space before them."""
        if any(run in text for run in _RUNS):
            return ["\0" + w for w in _SPLIT.findall(text)]
        first, *rest = text.replace("\n", " \n").split(" ")
        return ["\0" + first, *rest]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        rest = []
        for i, text in enumerate(texts):
            if self.by_word and _plain(text) and not any(s in text for s in self.special):
                out[i] = b"".join(map(self.__getitem__, self._parts(text)))
            else:
                rest.append(i)
        found = self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)
        for i, x in zip(rest, found, strict=True):
            out[i] = np.array(x.ids, self.dtype).tobytes()
        return out


@cache
def load(path: str) -> ByteBpe:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
    return ByteBpe(path)


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = len(payload).to_bytes(8, "little")
    return b"".join((length, masked(length).to_bytes(4, "little"), payload, masked(payload).to_bytes(4, "little")))


def unframe(data: bytes, at: int = 0) -> bytes:
    """Payload of the frame at ``at``; damaged frames raise."""
    length = data[at : at + 8]
    if masked(length) != int.from_bytes(data[at + 8 : at + 12], "little"):
        raise ValueError("damaged record length")
    n = int.from_bytes(length, "little")
    payload = data[at + 12 : at + 12 + n]
    if len(payload) != n or masked(payload) != int.from_bytes(data[at + 12 + n : at + 16 + n], "little"):
        raise ValueError("damaged record")
    return payload


def write_records(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Encode and write all texts in ascending id order; returns the manifest of the files.

    Manifest: ``part, path, records, tokens, item_bytes``, files in the order of ``part``.
    Null texts are empty and hold the end id alone; null ids come last; repeated ids follow
    each other.  An empty table writes no file.  Only files of tasks that succeeded are in
    the manifest.  Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole(text_col).alias("text"))
    order = F.asc_nulls_last("id")
    dealt = rows.repartitionByRange(order).sortWithinPartitions(order, F.xxhash64("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(tokenizer_path)
        end = np.array([end_id], coder.dtype).tobytes()
        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.records"
        fs, name = filesystem(path)
        index, offset, first = [], 0, 0
        out = None

        def put(ids: list[int | None], texts: list[str]) -> None:
            nonlocal out, offset, first
            if out is None:
                fs.create_dir(name.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(name)
            for key, payload in zip(ids, coder.encode(texts), strict=True):
                data = frame(payload + end)
                out.write(data)
                n = len(payload) // coder.dtype.itemsize + 1
                index.append((0 if key is None else key, key is None, offset, n, first))
                offset, first = offset + len(data), first + n

        for b in batches:
            ids, texts, size = [], [], 0
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.append(key)
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= ENCODE_CHARS:
                    put(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                put(ids, texts)
        made = []
        if out is not None:
            out.close()
            with fs.open_output_stream(name + ".index") as f:
                f.write(np.array(index, INDEX_TYPE).tobytes())
            made = [{"part": part, "path": path, "records": len(index), "tokens": first, "item_bytes": coder.dtype.itemsize}]
        yield pa.RecordBatch.from_pylist(
            made, pa.schema([("part", pa.int32()), ("path", pa.string()), ("records", pa.int64()), ("tokens", pa.int64()), ("item_bytes", pa.int32())])
        )

    return stored(dealt.mapInArrow(write, "part int, path string, records long, tokens long, item_bytes int"), "manifest")


def file_records(path: str, item_bytes: int = 2, shuffle_seed: int | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(id, first token in the file, ids) of every record, by the index.

    In file order neighbouring frames are read together; with a seed, every frame is
    fetched on its own in random order.
    """
    fs, name = filesystem(path)
    with fs.open_input_stream(name + ".index") as f:
        index = np.frombuffer(f.read(), INDEX_TYPE)
    kind = np.dtype("<u2" if item_bytes == 2 else "<u4")
    sizes = 16 + index["tokens"].astype(np.int64) * item_bytes
    if shuffle_seed is None:
        groups, begin, size = [], 0, 0
        for i, n in enumerate(sizes.tolist()):
            size += n
            if size >= READ_BYTES:
                groups.append(range(begin, i + 1))
                begin, size = i + 1, 0
        groups.append(range(begin, len(index)))
    else:
        groups = [range(i, i + 1) for i in random.Random(shuffle_seed).sample(range(len(index)), len(index))]
    with contextlib.closing(fs.open_input_file(name)) as source:
        for rows in groups:
            if not rows:
                continue
            start = int(index["offset"][rows[0]])
            source.seek(start)
            data = source.read(int(index["offset"][rows[-1]] + sizes[rows[-1]]) - start)
            for i in rows:
                row = index[i]
                ids = np.frombuffer(unframe(data, int(row["offset"]) - start), kind)
                if len(ids) != row["tokens"]:
                    raise ValueError("index and record differ")
                yield None if row["null"] else int(row["id"]), int(row["first"]), ids


def read_records(manifest: DataFrame) -> DataFrame:
    """Read the files back: ``id, start, n_tokens, ids`` with ids as little-endian 32-bit integers.

    ``start`` counts all tokens before the record, over all files in order; the window that
    adds them up sees one narrow row per file.
    """
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("path", "item_bytes", F.coalesce(before, F.lit(0)).alias("before"))
    kind = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, item_bytes, earlier in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows, size = [], 0
                for key, first, ids in file_records(path, item_bytes):
                    rows.append((key, earlier + first, len(ids), ids.astype("<u4").tobytes()))
                    size += 4 * len(ids)
                    if size >= READ_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

    spread = files.repartition(width(manifest.sparkSession), "path")
    return spread.mapInArrow(read, "id long, start long, n_tokens long, ids binary")


def token_round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Write ``docs`` as record files in the shared folder and read every record back."""
    folder = shared_path(docs.sparkSession, "records")
    return read_records(write_records(docs, folder, tokenizer_path, id_col, text_col, end_id)).withColumnRenamed("id", id_col)
