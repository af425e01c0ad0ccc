"""Ranked search of many items: the sharing DAG, and results against a plain version."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings, strategies as st
from llm.helpers import AWKWARD, collected, documents
from pyspark.sql import functions as F

from quillspark.llm import lexsearch


def terms(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs: list[tuple[int | None, str | None]], items: list[tuple[int | None, str | None]], k: int = 10) -> list[tuple]:
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, length = sum(1 for _, c in held if c), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 25 + (75 * c.total() * n_docs) // length if length else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0 and i is not None:
                scored.append((-s, i))
        out += [(str(item), rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def result(df) -> list[tuple]:
    return sorted((str(r["item_id"]), r["rank"], r["doc_id"], r["score"]) for r in collected(df))


def asked(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").select("*", *[F.lit("x").alias(c) for c in ("doc_id", "n", "terms", "rank", "score")])


def test_equals_the_plain_version_in_groups(spark, monkeypatch):
    monkeypatch.setattr(lexsearch, "CELLS", 4000)
    monkeypatch.setattr(lexsearch, "SYMBOLS", 300)
    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(60)] + ["Ünï", "日本", "The", "THE", "a1_b2"]
    text = lambda most: " ".join(rng.choice(vocabulary[: rng.choice((5, 20, 65))]) for _ in range(rng.randrange(most)))
    docs = [(i // 2, text(60)) for i in range(300)]
    items = [(i, text(40)) for i in range(40)]
    assert result(lexsearch.search(documents(spark, docs), asked(spark, items))) == plain(docs, items)


def test_awkward_rows(spark):
    items = [(1, "one"), (2, None), (3, ""), (None, "two words ab"), (4, "é 日本語 😀"), (5, "one one Ünï AB"), (6, "nowhere")]
    assert result(lexsearch.search(documents(spark, AWKWARD), asked(spark, items))) == plain(AWKWARD, items)
    again = [*items, (1, "two"), (1, "one")]  # the first text in order stays
    assert result(lexsearch.search(documents(spark, AWKWARD), asked(spark, again))) == plain(AWKWARD, items)
    for docs, some in ((AWKWARD, []), ([], items), ([(1, None)], items)):
        assert lexsearch.search(documents(spark, docs) if docs else spark.createDataFrame([], "doc_id long, text string"), asked(spark, some)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c", b"d", b"e", b"f"]), min_size=1, max_size=12), min_size=1, max_size=8))
def test_every_item_is_the_sum_of_its_terms(items):
    dag = lexsearch.Sharing(items)
    values = np.random.default_rng(0).integers(0, 100, (len(dag.terms), 5))
    index = {t: i for i, t in enumerate(dag.terms)}
    assert dag.scores(values).tolist() == [values[[index[t] for t in terms]].sum(0).tolist() for terms in items]


def test_shared_sets_are_added_up_once():
    common = [b"t%d" % k for k in range(30)]
    dag = lexsearch.Sharing([[*common, b"own%d" % k] for k in range(20)])
    additions = len(dag.parts) + sum(len(nodes) - 1 for nodes in dag.roots)
    assert additions <= 30 + 2 * 20  # not 20 * 30
