import base64
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import tokens as t

FOLDER = t.DEFAULT_FOLDER
pytestmark = pytest.mark.skipif(not os.path.exists(f"{FOLDER}/byte_bpe_50k.tiktoken"), reason="no vocabulary files")
ALPHABET = ["'", "'s", "'re", "'ll", "'ve", "'d", " ", "  ", "\n", "\t", "\r\n", "a", "s", "t", "re", "l", "e", "r", "v", "m", "D", "1", "23", "é", "日", "💥", "!", "''", " ", "　", "̀", "٣", "½", "\x00", "\x1c", "\x85", "\xa0", "<|endoftext|>", "﻿", "ſ"]


@pytest.fixture(scope="module")
def vocab():
    return t.Vocabulary(f"{FOLDER}/byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def other():
    import tiktoken

    import public_tokenizers as P

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def lists(vocab, texts):
    ids, at = vocab.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=14).map("".join), max_size=8))
def test_equals_the_library(vocab, other, texts):
    assert lists(vocab, texts) == [other.encode_ordinary(x) for x in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(vocab, other, text):
    got = lists(vocab, [text])[0]
    assert vocab.decode(got) == text.encode()
    assert got == other.encode_ordinary(text)


def test_long_slices(vocab, other):
    for text in ("a" * 20_000, "ab" * 5000 + "c", "zq" * 100, "日本" * 2000, "x" * 65 + " y", " " * 3000 + "x", "'" * 999, "\n" * 500):
        assert lists(vocab, [text])[0] == other.encode_ordinary(text)


def test_json_form_of_the_vocabulary(vocab):
    from tokenizers import Tokenizer

    import public_tokenizers as P

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    for text in ("Don't  stop\n\n me's <|endoftext|> x", "日本 ½ ٣'ll\t\tq"):
        assert lists(vocab, [text])[0] == tok.encode(text, add_special_tokens=False).ids


def test_scan_equals_stepping():
    rng = np.random.default_rng(1)
    cls = rng.integers(0, 12, 5000).astype(np.uint8)
    state, want = t.BEGIN, []
    for c in cls.tolist():
        state = t._step(state, c)
        want.append(state)
    assert t.states(cls).tolist() == want


def test_cache_bound(other):
    small = t.Vocabulary(f"{FOLDER}/byte_bpe_50k.tiktoken", most=3)
    texts = ["one two three four five six", "two three", "seven"]
    for _ in range(2):
        assert lists(small, texts) == [other.encode_ordinary(x) for x in texts]


def test_pieces_do_not_matter(spark, other, monkeypatch):
    text = "".join(ALPHABET[i * i % 37] + (" b" if i % 5 == 0 else "") for i in range(700))
    for size in (1, 20, 300):
        assert "".join(t.pieces(text, size)) == text
        assert [i for p in t.pieces(text, size) for i in other.encode_ordinary(p)] == other.encode_ordinary(text)
    assert len(list(t.pieces(text, 20))) > 20 and list(t.pieces("a" * 50, 20)) == ["a" * 50]


def test_very_long_text(spark, other):
    text = "word don't  stop\n" * 300_000
    rows = spark.createDataFrame([(1, "a"), (2, text), (3, None)], "doc_id BIGINT, text STRING")
    got = {r.doc_id: r.ids for r in t.encode_corpus(rows.coalesce(1)).collect()}
    assert got == {1: [64], 2: other.encode_ordinary(text), 3: []}


def test_table(spark, vocab):
    rows = [(1, None, 5, "x"), (2, "", 6, "x"), (3, " \n", 7, "x"), (4, "Hello 日本's", 8, "x"), (4, "Hello 日本's", 8, "x"), (None, "a", 9, "x"), (5, "w " * 300_000, 1, "x")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, ids INT, ends STRING")
    out = t.encode_corpus(df, offsets=True).collect()
    assert len(out) == len(rows)
    by_id = {r.doc_id: r for r in out}
    assert by_id[1].ids == by_id[2].ids == by_id[1].ends == []
    for r in rows:
        data = (r[1] or "").encode()
        got = by_id[r[0]]
        assert b"".join(data[a:b] for a, b in zip([0, *got.ends], got.ends)) == data == vocab.decode(got.ids)
        assert all(data[a:b] == vocab.pieces[i] for a, b, i in zip([0, *got.ends], got.ends, got.ids))
    assert t.encode_corpus(df.limit(0)).collect() == []
