import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factloom.llm import sentencepiece_bpe, token_records
from factloom.llm.common import shared_path

MODEL, BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def ids(text):
    return np.frombuffer(sentencepiece_bpe.load(MODEL).encode(text), "<i4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aeinorst \n▁  "))))
def test_pieces_are_those_of_the_library(text):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert ids(text) == sp.encode(text)
    assert sentencepiece_bpe.load(MODEL).decode(ids(text)) == sp.decode(sp.encode(text))


def test_backtracking(library):
    """Long runs without a space, where the longest piece is often wrong."""
    rng = random.Random(1)
    for _ in range(30):
        text = "".join(rng.choice(["th", "er", "in", "a", "tion", "qu", "0", "::", "é"]) for _ in range(300))
        assert ids(text) == library.encode(text)


@pytest.mark.parametrize("seed", range(5))
def test_any_ids_decode(library, seed):
    rng = random.Random(seed)
    for _ in range(200):
        some = [rng.choice([rng.randint(3, 258), rng.randrange(32000), 29871, 1, 2]) for _ in range(rng.randint(0, 9))]
        assert sentencepiece_bpe.load(MODEL).decode(some) == library.decode(some)


def test_encode_messy_rows(messy, none, library):
    back = sentencepiece_bpe.decode(sentencepiece_bpe.encode(messy, MODEL), MODEL).collect()
    want = sorted((str(r.doc_id), i, library.decode(i)) for r in messy.collect() for i in [library.encode(r.text or "", add_eos=True)])
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in back) == want
    both = sentencepiece_bpe.encode(messy, MODEL, round_trip=True).collect()
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in both) == want
    assert sentencepiece_bpe.decode(sentencepiece_bpe.encode(none, MODEL), MODEL).collect() == []


def test_memo_tables_start_again(monkeypatch, library):
    monkeypatch.setattr(sentencepiece_bpe, "WORDS_KEPT", 3)
    monkeypatch.setattr(sentencepiece_bpe, "PAIRS_KEPT", 3)
    model = sentencepiece_bpe.Model(MODEL)
    text = "several different words in one sentence, twice: several different words"
    assert np.frombuffer(model.encode(text), "<i4").tolist() == library.encode(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aeinorst'sdéÀ¼ªº  \n\t<|endoftext|>"))))
def test_words_of_the_byte_tokenizer(text):
    coder = token_records.load(BPE)
    want = Tokenizer.from_file(BPE).encode(text, add_special_tokens=False).ids if text else []
    assert np.frombuffer(coder.encode([text])[0], coder.dtype).tolist() == want


def test_record_files(messy, none):
    rows = sorted(messy.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    got = sorted(token_records.token_round_trip(messy, BPE).collect(), key=lambda r: r.start)
    library, start = Tokenizer.from_file(BPE), 0
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    texts = {}
    for r in rows:
        texts.setdefault(r.doc_id, []).append(library.encode(r.text or "", add_special_tokens=False).ids + [0])
    for r in got:
        own = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert (r.start, r.n_tokens) == (start, len(own)) and own in texts[r.doc_id]
        start += len(own)
    assert token_records.token_round_trip(none, BPE).collect() == []


def test_shuffled_reads(spark, messy):
    for row in token_records.write_records(messy, shared_path(spark, "records"), BPE).collect():
        key = lambda r: r[1]
        in_order = list(token_records.file_records(row.path))
        mixed = list(token_records.file_records(row.path, shuffle_seed=3))
        assert [(a, b, c.tolist()) for a, b, c in sorted(mixed, key=key)] == [(a, b, c.tolist()) for a, b, c in in_order]


def test_frames_find_damage():
    data = token_records.frame(b"payload")
    assert token_records.unframe(b"xx" + data, 2) == b"payload"
    for at in range(len(data)):
        with pytest.raises(ValueError, match="damaged"):
            token_records.unframe(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    crc = zlib.crc32(b"payload")
    assert token_records.masked(b"payload") == ((crc >> 15 | crc << 17) + 0xA282EAD8) % 2**32
