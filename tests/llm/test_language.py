"""Word-first language identification: against a plain version, on awkward rows, and held-out accuracy on the given tables."""

from __future__ import annotations

import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm.helpers import AWKWARD, CLASHING, DOCS, collected
from pyspark.sql import functions as F

from quillspark.llm import language
from quillspark.llm.common import table

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


def words(text: str) -> list[str]:
    return re.findall(r"[^\W\d_]+", text.lower())


def plain(rows: list[tuple[int | None, str | None, str | None]]) -> list[tuple[str, float]]:
    """The method without tables, batches or memory bounds."""
    seen: dict[int, dict[str, Counter]] = {n: defaultdict(Counter) for n in range(6)}
    for i, text, lang in rows:
        if i is None or text is None or lang is None or zlib.crc32(str(i).encode()) % 3 == 1:
            continue
        for w in words(text):
            seen[0][lang][w] += 1
            for n in range(1, 6):
                for k in range(len(w) + 3 - n):
                    seen[n][lang][f" {w} "[k:k + n]] += 1
    languages = sorted(seen[0])
    total = {(n, lang): sum(c.values()) for n, by in seen.items() for lang, c in by.items()}

    def form(n: int, f: str) -> list[float]:
        return [math.log10(seen[n][lang][f] / total[n, lang]) if seen[n][lang][f] else language.ABSENT for lang in languages]

    def row(w: str) -> list[float] | None:
        if any(seen[0][lang][w] for lang in languages):
            return form(0, w)
        for n in range(5, 0, -1):
            known = [f for f in (f" {w} "[k:k + n] for k in range(len(w) + 3 - n)) if any(seen[n][lang][f] for lang in languages)]
            if known:
                return np.mean([form(n, f) for f in known], axis=0)
        return None

    out = []
    for _, text, _ in rows:
        scored = [r for r in map(row, words(text or "")) if r is not None]
        if not languages or not any(c.isalpha() for c in text or ""):
            out.append(("und", 0.0))
        elif not scored:
            out.append((max(languages, key=lambda x: total[0, x]), 1 / len(languages)))
        else:
            mean = np.mean(scored, axis=0)
            share = 10.0 ** ((mean - mean.max()) * min(len(scored), language.SURE))
            out.append((languages[int(mean.argmax())], float(1 / share.sum())))
    return out


def frame(spark, rows):
    df = spark.createDataFrame([(i, t, lang, None, None) for i, t, lang in rows], DOCS)
    return df.select("*", *[F.lit("extra").alias(c) for c in [*CLASHING, "held_out", "lang_pred", "word", "n", "form"]])


def compare(spark, rows):
    key = lambda r: (str(r[0]), *r[1:])
    want = [(i, i is not None and zlib.crc32(str(i).encode()) % 3 == 1, *p) for (i, _, _), p in zip(rows, plain(rows))]
    got = [(r["doc_id"], r["held_out"], r["lang_pred"], r["score"]) for r in collected(language.identify(frame(spark, rows)))]
    got, want = sorted(map(key, got)), sorted(map(key, want))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=1e-3)


def test_equals_the_plain_version(spark, monkeypatch):
    monkeypatch.setattr(language, "HELD", 20)
    monkeypatch.setattr(language, "KEPT", 30)
    rng = np.random.default_rng(1)
    alphabets = {"aa": "abcdef", "bb": "defghi", "cc": "ghijäö"}
    texts = [(lang, " ".join("".join(rng.choice(list(a), rng.integers(1, 6))) for _ in range(rng.integers(1, 40)))) for lang, a in alphabets.items() for _ in range(30)]
    compare(spark, [(i, text, lang) for i, (lang, text) in enumerate(texts)])


def test_awkward_rows(spark):
    rows = [(i, t, ("xx", "yy", None)[k % 3]) for k, (i, t) in enumerate(AWKWARD)] + [(20, "日本語", None), (21, "12 34 ²", "xx"), (22, "ONE_two", "xx"), (23, "один", None)]
    compare(spark, rows)
    compare(spark, [(1, "nothing to learn", None), (2, None, "xx"), (3, "", "yy")])
    assert language.identify(frame(spark, [])).count() == 0


def test_common_forms_only_when_tables_are_small(spark, monkeypatch):
    monkeypatch.setattr(language, "WORDS", 2)
    monkeypatch.setattr(language, "GRAMS", 3)
    rows = [(i, "le la les un mot rare" if i % 2 else "the of and a seldom word", "fr" if i % 2 else "en") for i in range(40)]
    found = {r["doc_id"]: r["lang_pred"] for r in collected(language.identify(frame(spark, rows)))}
    assert len(found) == 40 and set(found.values()) <= {"en", "fr"}
    model = language.train(frame(spark, rows).select("text", "lang"))
    assert len(model.tables[0][0]) == 2 and all(len(index) <= 3 for n, (index, _) in model.tables.items() if n)


def test_held_out_accuracy(spark):
    docs = table(spark, SF_DIR, "documents")
    found = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 20 and right >= 0.97
