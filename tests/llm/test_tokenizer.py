"""Ids against the public libraries, and round trips."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexigrove.llm import tokenizer as tk
from tests.conftest import rows

tokenizers = pytest.importorskip("tokenizers")
pytestmark = pytest.mark.skipif(not os.path.exists(tk.DEFAULT_VOCABULARY), reason="no vocabulary")

TEXTS = [
    "Hello world, it's I'LL don't 've'",
    "niño último café café ‍👨‍👩‍👧 한국어 テスト हिन्दी",
    "<|endoftext|> is text",
    "  lead and trail  \n\n\t tabs\r\n",
    "\x1c \x1d \x85 　 x",
    "0" * 999 + "½²Ⅷ１２",
    "-" * 5000,
    " " * 3000 + "x",
    "ab" * 3000,
    "ÀÁ" * 900,
]


@pytest.fixture(scope="module")
def machine():
    return tk.Transducer(tk.read_vocabulary())


@pytest.fixture(scope="module")
def library():
    own = tokenizers.Tokenizer.from_file(tk.DEFAULT_VOCABULARY.replace(".tiktoken", ".json"))
    own.encode_special_tokens = True
    return lambda text: own.encode(text, add_special_tokens=False).ids


def ids(machine, text):
    return [i for piece in machine.encode(text) for i in piece]


@pytest.mark.parametrize("text", TEXTS)
def test_fixed_texts(machine, library, text):
    assert ids(machine, text) == library(text)
    assert tk.Utf8Stream(machine.tokens).decode(ids(machine, text)) == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(machine, library, text):
    assert ids(machine, text) == library(text)
    assert tk.Utf8Stream(machine.tokens).decode(ids(machine, text)) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50255), max_size=12))
def test_any_ids_decode_like_their_bytes(machine, tokens):
    raw = b"".join(machine.tokens[t] for t in tokens)
    assert tk.Utf8Stream(machine.tokens).decode(tokens) == raw.decode(errors="replace")


def test_states_are_forgotten(machine, library, monkeypatch):
    monkeypatch.setattr(tk, "_MOST_STATES", 50)
    monkeypatch.setattr(tk, "_MOST_WORDS", 10)
    for text in TEXTS:
        assert ids(machine, text) == library(text)


def test_tables(spark, library):
    data = [(1, None, 9), (2, "", 9), (3, TEXTS[0], 9), (3, TEXTS[0], 9), (4, "y " * 60000, 9)]
    df = spark.createDataFrame(data, "doc_id long, text string, ids int").repartition(3)
    found = tk.encode_texts(df, "doc_id", "text")
    assert rows(found) == sorted([(1, []), (2, []), (3, library(TEXTS[0])), (3, library(TEXTS[0])), (4, library("y " * 60000))], key=repr)
    assert rows(tk.decode_ids(found, "doc_id", "ids")) == sorted(((i, t or "") for i, t, _ in data), key=repr)
    counted = tk.count_tokens(df, "text", "n")
    assert rows(counted, "doc_id", "n") == sorted(((i, len(library(t or ""))) for i, t, _ in data), key=repr)
    assert tk.encode_texts(df.limit(0), "doc_id", "text").count() == 0
    null = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert rows(tk.decode_ids(null, "doc_id", "ids")) == [(1, None)]
