from __future__ import annotations

import random
import re

import numpy as np
from llm.helpers import AWKWARD, collected, documents

from quillspark.llm import minhash


def shingles(text: str | None, size: int = 4) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[k:k + size]) for k in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute(texts: list[tuple[int | None, str | None]], size: int = 4) -> list[tuple]:
    sets = [(i, shingles(t, size)) for i, t in texts]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, s) in enumerate(sets):
        for j, t in sets[:n]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted((str(i), len(s), str(find(i)), i is None or find(i) == i) for i, s in sets)


def result(df) -> list[tuple]:
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in collected(df))


def corpus(seed: int, families: int, copies: int) -> list[tuple[int, str]]:
    """Families whose members differ from each other by a few words, some at the threshold."""
    rng = random.Random(seed)
    texts = []
    for family in range(families):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(8, 70))]
        for _ in range(rng.randint(1, copies)):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"v{rng.randrange(4000)}"
            texts.append(" ".join(words))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_components_of_all_links(spark):
    texts = corpus(1, 60, 6)
    assert result(minhash.deduplicate(documents(spark, texts))) == brute(texts)


def test_large_group_searched_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "SHINGLES", 300)
    texts = corpus(2, 3, 60)
    assert result(minhash.deduplicate(documents(spark, texts))) == brute(texts)


def test_members_their_star_does_not_reach(spark):
    # A chain: each text is close to the next only, and the smallest id stands at its end.
    words = [f"w{k}" for k in range(60)]
    texts = [(i, " ".join(words[:40 + i] + [f"x{i}"])) for i in range(12)]
    assert result(minhash.deduplicate(documents(spark, texts))) == brute(texts)


def test_awkward_rows(spark):
    assert result(minhash.deduplicate(documents(spark, AWKWARD))) == brute(AWKWARD)
    assert minhash.deduplicate(documents(spark, [])).count() == 0


def test_estimate_is_unbiased():
    rng = np.random.default_rng(3)
    factors = rng.integers(0, 2**63, minhash.HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
    terms = rng.integers(0, 2**63, minhash.HASHES, np.uint64)
    errors = []
    for _ in range(60):
        shared, own = rng.integers(0, 2**63, 200, np.uint64), rng.integers(0, 2**63, 100, np.uint64)
        left, right = np.concatenate([shared, own[:50]]), np.concatenate([shared, own[50:]])
        a, b = (np.frombuffer(minhash.low_bits(minhash.signature(x, factors, terms)), np.uint8) for x in (left, right))
        errors.append(minhash.estimated(minhash.equal_nibbles(a, b)) - 200 / 300)
    assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < minhash.MARGIN


def test_word_rules():
    left, right, empty, short = minhash.word_sets(["A b C d e", "a B\tc\nD  E", " \x0b ", "one two"], 4)
    assert left.tolist() == right.tolist() and len(left) == 2
    assert len(empty) == 0 and len(short) == 1
