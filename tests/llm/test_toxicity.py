from __future__ import annotations

import random
import zlib

import numpy as np
from llm.helpers import AWKWARD, collected, documents

from quillspark.llm import toxicity


def corpus(n: int) -> tuple[list[str], list[int]]:
    """Clean prose in two languages; toxic texts hold a rude word or a rude stem with any ending."""
    rng = random.Random(3)
    texts, labels = [], []
    for _ in range(n):
        lang = rng.choice(["the of and with", "der die und mit"]).split()
        words = [rng.choice([*lang, f"w{'abcdefgh'[rng.randrange(8)]}{'klmnopqr'[rng.randrange(8)]}en"]) for _ in range(rng.randint(5, 120))]
        toxic = rng.random() < 0.3
        for _ in range(rng.randint(1, 3) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["vilest", "grobian" + "abcdefgh"[rng.randrange(8)] * rng.randrange(3)]))
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return texts, labels


def test_held_out_accuracy(spark):
    texts, y = corpus(900)
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(y)] + [(None, 1), (3, None), (99_999, 1)], "doc_id long, toxic int")
    rows = collected(toxicity.score(documents(spark, list(enumerate(texts))), labels))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == y[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= toxicity.CUT) for r in rows)


def test_held_out_labels_are_never_read(spark):
    texts, y = corpus(300)
    docs = documents(spark, list(enumerate(texts)))
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in enumerate(y)]
    pairs = [toxicity.score(docs, spark.createDataFrame(x, "doc_id long, toxic int")).select("doc_id", "score") for x in (list(enumerate(y)), flipped)]
    assert sorted(pairs[0].collect()) == sorted(pairs[1].collect())


def test_long_texts_score_as_one(monkeypatch):
    texts, y = corpus(300)
    model = toxicity.train(texts, y)
    long = toxicity.words_of(" ".join(texts[:40]))
    whole = toxicity.Scorer(model).measure([long, [], long[:3]])
    monkeypatch.setattr(toxicity, "STEP", 64)
    monkeypatch.setattr(toxicity, "KEPT", 200)
    parts = toxicity.Scorer(model).measure([long, [], long[:3]])
    assert np.allclose(whole[0], parts[0], atol=1e-4) and whole[1] == parts[1]


def test_awkward_rows(spark):
    rows = collected(toxicity.score(documents(spark, AWKWARD), spark.createDataFrame([(4, 0), (5, 1)], "doc_id long, toxic int")))
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, _ in AWKWARD)
    assert not next(r for r in rows if r["doc_id"] is None)["held_out"]
    none = collected(toxicity.score(documents(spark, AWKWARD), spark.createDataFrame([], "doc_id long, toxic int")))
    assert {r["predicted"] for r in none} == {0}
    assert toxicity.score(documents(spark, []), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def plain_logit(model: toxicity.Model, text: str) -> float:
    """The forward pass word by word: embedding sums, every filter at every place, the largest, a weighted sum."""
    vectors = [model.embedding[list(toxicity.buckets(w))].sum(0) for w in toxicity.words_of(text)]
    total, column = float(model.bias), 0
    for width in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            best = 0.0
            for i in range(len(vectors)):
                value = sum(float(vectors[i + k] @ model.filters[width][k][:, f]) for k in range(width) if i + k < len(vectors))
                best = max(best, value + float(model.offsets[column]))
            total += best * float(model.weights[column])
            column += 1
    return total


def test_scores_equal_the_plain_forward_pass():
    texts, y = corpus(150)
    model = toxicity.train(texts, y)
    tried = [*texts[:12], "", "vilest", "the of", " ".join(texts[:6]), "x " * 150 + "vilest end"]
    logits, _ = toxicity.Scorer(model).measure([toxicity.words_of(t) for t in tried])
    np.testing.assert_allclose(logits, [plain_logit(model, t) for t in tried], atol=2e-3)
