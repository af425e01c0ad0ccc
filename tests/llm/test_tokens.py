from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from llm.helpers import AWKWARD, collected, documents
from tokenizers import Tokenizer

from quillspark.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = [*"'' strvlemdx12 .!<|>é́ΣσςİßⅧ²一م‍ \u0085\x1c\x00\n😀Ᲊ", "<|endoftext|>", "'re", "'ll", "<|startoftext|>"]


@pytest.fixture(scope="module")
def compiled():
    return tokens.Transducer(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_and_counts_are_the_library_s(compiled, library):
    random.seed(5)
    texts = ["".join(random.choices(ALPHABET, k=random.randint(0, 60))) for _ in range(4000)]
    texts += ["don't 'told we'll they've I'm 're", "a" * 3000, "'" * 700 + "s", "x'r" * 300, "日本" * 900]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(i, "<u4").tolist() for i in compiled.token_ids(texts)] == expected
    assert compiled.token_counts(texts).tolist() == [len(e) for e in expected]


def test_chunk_length_does_not_matter(compiled, monkeypatch):
    text = "it's we'd'll x'ree 12'v ''s " * 40
    whole = compiled.words([text])[0]
    for chunk in (1, 2, 7):
        monkeypatch.setattr(tokens, "CHUNK", chunk)
        assert compiled.words([text])[0] == whole


def test_dropped_emissions_change_nothing(monkeypatch, library):
    monkeypatch.setattr(tokens, "KEPT_WORDS", 2)
    small = tokens.Transducer(PATH)
    text = "many different words and many more words"
    assert small.token_counts([text, text]).tolist() == [len(library.encode(text, add_special_tokens=False).ids)] * 2


def test_awkward_rows(spark, library):
    found = collected(tokens.count_tokens(documents(spark, AWKWARD), PATH, limit=10))
    expected = []
    for i, text in AWKWARD:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        expected.append((i, len((text or "").encode()), n, n > 10))
    assert sorted(map(str, expected)) == sorted(str((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"])) for r in found)
    assert tokens.count_tokens(documents(spark, []), PATH).count() == 0
