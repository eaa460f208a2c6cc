import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import packing
from quern.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def words():
    found = packing.WordTokens(tokenizer_path())
    assert found.fast is not None
    return found


def same(tokenizer, words, text):
    return np.frombuffer(words([text])[0], words.dtype).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@given(st.text(alphabet=st.sampled_from("abcDE 's'\n\t\x0b 1.2,é ü猫ßA̐²½_-'\x00\ufffd🙂ǅⅣ\u2028\u3000"), max_size=60))
@settings(max_examples=300, deadline=None)
def test_ids_are_the_tokenizer_s(tokenizer, words, text):
    assert same(tokenizer, words, text)


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_ids_of_any_letters(tokenizer, words, text):
    assert same(tokenizer, words, text)


@pytest.mark.parametrize(
    "text",
    ["", "a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> <|endoftext|>x", "<|endoftext", " " * 300_000, "\n" * 300_000 + "x", "x" + " " * 511 + "y", "a" * 200_000, "^" * 100_000, "é" * 100_000, "猫" * 50_000],
)
def test_special_strings_and_long_runs(tokenizer, words, text):
    assert same(tokenizer, words, text)


def test_special_string_is_one_id(words):
    assert np.frombuffer(words(["a<|endoftext|>b"])[0], words.dtype).tolist() == [64, 50256, 65]


def test_other_vocabularies_go_to_their_tokenizer():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    words = packing.WordTokens(path)
    assert words.fast is None and same(Tokenizer.from_file(path), words, "Ein Haus, two houses <|endoftext|>!")


@pytest.mark.parametrize("length", [16, 1024])
def test_pieces(wide, rows, tokenizer, length):
    got = packing.pack(wide, tokenizer_path(), length, keep_ids=True).collect()
    used = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    at = 0
    for s, o, n in used:  # gapless, and every sequence but the last is full
        assert s * length + o == at and o + n <= length
        at += n
    pieces = {}
    for r in got:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        assert r["continues"] == (r["start"] > 0) and r["continued"] == (r["start"] + r["length"] < r["doc_tokens"])
        pieces.setdefault(r["sequence_id"] * length + r["offset"], r)
    texts, ids, doc = [], [], None
    for at in sorted(pieces):
        r = pieces[at]
        if r["start"] == 0:
            doc, ids = r["doc_id"], []
        assert r["doc_id"] == doc and r["start"] == len(ids)
        ids += r["ids"]
        if len(ids) == r["doc_tokens"]:
            assert ids[-1] == packing.END
            texts.append((doc, ids[:-1]))
    want = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in rows]
    assert sorted(texts, key=str) == sorted(want, key=str)


def test_empty(no_docs):
    assert packing.pack(no_docs, tokenizer_path()).count() == 0
