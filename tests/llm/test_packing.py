from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from llm.helpers import AWKWARD, collected, documents
from tokenizers import Tokenizer

from quillspark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_packs_hold_the_histogram(histogram):
    held = defaultdict(int)
    for copies, content in packing.shortest_pack_first(histogram, 64):
        assert sum(length * each for length, each in content) <= 64
        for length, each in content:
            held[length] += copies * each
    assert held == histogram


def test_shortest_pack_takes_the_next_length():
    packs = packing.shortest_pack_first({6: 1, 5: 1, 3: 1}, 10)
    assert sorted(packs) == [(1, ((5, 1), (3, 1))), (1, ((6, 1),))]


def check(df, texts: list[tuple[int | None, str | None]], size: int) -> None:
    library = Tokenizer.from_file(PATH)
    rows = collected(df)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[(r["doc_id"], r["doc_tokens"])].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= size
    expected = []
    for i, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for length in packing.cut(len(ids), size):
            part = np.array(ids[at:at + length], "<u4").tobytes()
            expected.append((i, at, length, zlib.crc32(part), len(ids)))
            at += length
    assert sorted(map(str, expected)) == sorted(str(tuple(r[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens"))) for r in rows)


def test_awkward_rows(spark):
    check(packing.pack(documents(spark, AWKWARD), PATH, 128), AWKWARD, 128)
    assert packing.pack(documents(spark, []), PATH).count() == 0


def test_hot_length(spark):
    texts = [(i, "the same text here") for i in range(400)] + [(i, "word " * (i % 37)) for i in range(400, 600)]
    first = packing.pack(documents(spark, texts), PATH, 64)
    check(first, texts, 64)
    again = packing.pack(documents(spark, texts).repartition(5), PATH, 64)
    assert sorted(first.collect()) == sorted(again.collect())
