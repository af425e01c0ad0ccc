"""Toxicity with a small convolutional classifier, trained in numpy.

A word is the sum of the embeddings its hashes select: the whole word and its prefixes of
three to six letters. Filters over one, two and three words are max-pooled over the whole text
and feed a logistic unit. Labels are learned from a bounded sample of labelled rows; thresholds
are calibrated per language, which is guessed from the text's function words (the ``lang``
column is never read). Scores are shifted so that every language's threshold sits at 0.7.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.common import batches, per_process, runs

WORD = re.compile(r"[^\W\d_]+")
WIDTHS, FILTERS, SIZE, BUCKETS = (1, 2, 3), 8, 16, 1 << 15
PREFIXES = (3, 4, 5, 6)
CUT = 0.7
#: The training sample: rows per class at most, and characters of a row at most.
POSITIVE, NEGATIVE, LONGEST = 1500, 2500, 12_000
#: A hash bucket is trained if so many sampled texts hold it.
SEEN = 3
#: Passes over the sample and steps, each at least.
EPOCHS, STEPS, BATCH, RATE, SEED = 6, 600, 32, 0.1, 7
#: Words per scoring step, and words whose filters' parts a worker keeps.
STEP, KEPT = 1 << 15, 100_000

#: Function words by which a text's language is guessed.
FUNCTION_WORDS = {
    "en": "the of and to in is that with for this are was",
    "de": "der die das und ist nicht mit ein eine den von zu",
    "fr": "le les et des un une dans pour pas qui sur est",
    "es": "el los las y que con para una del por no se",
}

LANGUAGES = {lang: frozenset(ws.split()) for lang, ws in FUNCTION_WORDS.items()}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def marks(word: str) -> list[float]:
    """Which languages a word is a function word of."""
    return [float(word in ws) for ws in LANGUAGES.values()]


def buckets(word: str) -> list[int]:
    """The hash buckets of a word; absent prefixes point at the last, always empty one."""
    keys = [f"={word}", *(word[:n] if len(word) >= n else "" for n in PREFIXES)]
    return [zlib.crc32(k.encode()) % (BUCKETS - 1) if k else BUCKETS - 1 for k in keys]


@dataclass
class Model:
    embedding: np.ndarray
    filters: dict[int, np.ndarray]  # width -> (width, SIZE, FILTERS)
    offsets: np.ndarray  # of all filters
    weights: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    @property
    def parts(self) -> np.ndarray:
        """All filters side by side: what one word contributes at each place of each filter."""
        return np.concatenate([f for w in WIDTHS for f in self.filters[w]], axis=1)

    def convolved(self, parts: np.ndarray) -> np.ndarray:
        """Filter values at every word, from the words' parts; beyond the end nothing is added."""
        out, column = [], 0
        for width in WIDTHS:
            value = parts[:, column:column + FILTERS].copy()
            for k in range(1, width):
                value[:-k or None] += parts[k:, column + k * FILTERS:column + (k + 1) * FILTERS]
            out.append(value)
            column += width * FILTERS
        return np.concatenate(out, axis=1)

    def score(self, logits: np.ndarray, langs: list[str]) -> np.ndarray:
        shift = np.array([self.thresholds.get(lang, self.thresholds[""]) for lang in langs])
        return 1 / (1 + np.exp(-np.clip(logits - shift + np.log(CUT / (1 - CUT)), -30, 30)))


class Scorer:
    """Scores whole texts; long ones in overlapping steps whose maxima are combined."""

    def __init__(self, model: Model):
        self.model, self.all_parts = model, model.parts.astype(np.float32)
        self.known: dict[str, int] = {}
        self.columns = self.all_parts.shape[1]
        #: Per known word its parts of all filters, then its language marks.
        self.table = np.zeros((KEPT, self.columns + len(LANGUAGES)), np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        fresh = [w for w in dict.fromkeys(words) if w not in self.known]
        if len(self.known) + len(fresh) > KEPT:
            self.known.clear()
            fresh = list(dict.fromkeys(words))
        if fresh:
            begin = len(self.known)
            rows = np.array([buckets(w) for w in fresh])
            self.table[begin:begin + len(fresh), :self.columns] = self.model.embedding[rows].sum(1) @ self.all_parts
            self.table[begin:begin + len(fresh), self.columns:] = [marks(w) for w in fresh]
            self.known.update(zip(fresh, range(begin, begin + len(fresh))))
        return self.table[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]

    def measure(self, texts: list[list[str]]) -> tuple[np.ndarray, list[str]]:
        """Logit and guessed language of every text."""
        pooled = np.zeros((len(texts), len(self.model.weights)), np.float32)
        marked = np.zeros((len(texts), len(LANGUAGES)))
        overlap = max(WIDTHS) - 1
        gap = [""] * overlap  # an empty word adds nothing, so no filter sees two texts
        pieces = [(i, a, min(len(ws), a + STEP // 2)) for i, ws in enumerate(texts) for a in range(0, len(ws), STEP // 2)]
        for begin, end in runs([b - a + 2 * overlap for _, a, b in pieces], STEP):
            group = [(i, texts[i][a:b + overlap]) for i, a, b in pieces[begin:end]]
            rows = self.rows([w for _, ws in group for w in [*ws, *gap]])
            starts = np.cumsum([0, *[len(ws) + overlap for _, ws in group]])
            values = self.model.convolved(rows[:, :self.columns])
            values[(starts[1:, None] - 1 - np.arange(overlap)).ravel()] = -np.inf
            owner = [i for i, _ in group]
            np.maximum.at(pooled, owner, np.maximum.reduceat(values, starts[:-1], axis=0) + self.model.offsets)
            np.add.at(marked, owner, np.add.reduceat(rows[:, self.columns:], starts[:-1], axis=0))
        names = [*LANGUAGES]
        langs = [names[k] if row[k] else "" for row, k in zip(marked, marked.argmax(1))]
        return pooled @ self.model.weights + self.model.bias, langs


def train(texts: list[str], labels: list[int]) -> Model:
    """A model of a sample; a sample of a single class gives that class's constant."""
    random = np.random.default_rng(SEED)
    y = np.array(labels, np.float32)
    model = Model(
        random.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32),
        {w: random.normal(0, 0.3, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS},
        np.zeros(len(WIDTHS) * FILTERS, np.float32), random.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), -1.0, {"": 0.0},
    )
    if len(set(labels)) < 2:
        model.embedding[:] = 0
        model.weights[:] = 0
        model.bias = 10.0 if labels and labels[0] else -10.0
        return model
    split = [words_of(t) for t in texts]
    vocabulary = {w: k for k, w in enumerate(dict.fromkeys(["", *(w for ws in split for w in ws)]))}
    rows = np.array([[BUCKETS - 1] * (1 + len(PREFIXES)) if not w else buckets(w) for w in vocabulary])
    ids = [np.array([vocabulary[w] for w in ws] or [0]) for ws in split]
    held = np.zeros(BUCKETS, np.int32)
    for doc in ids:
        held[np.unique(rows[doc])] += 1
    used = held >= SEEN
    used[BUCKETS - 1] = False
    model.embedding[~used] = 0
    embedding_square = np.full_like(model.embedding, 1e-3)
    squares = [np.full_like(a, 1e-3) for a in (*model.filters.values(), model.offsets, model.weights)]
    bias_square = 1e-3

    calibration = random.random(len(texts)) < 0.2
    order = np.flatnonzero(~calibration)
    weight = np.where(y == 1, ((y == 0).sum() / (y == 1).sum()) ** 0.5, 1).astype(np.float32)
    epochs = max(EPOCHS, -(-STEPS * BATCH // max(1, len(order))))
    for epoch in range(epochs):
        random.shuffle(order)
        rate = RATE / (1 + EPOCHS * epoch / epochs)
        for at in range(0, len(order), BATCH):
            chosen = order[at:at + BATCH]
            overlap = max(WIDTHS) - 1
            flat = np.concatenate([np.concatenate([ids[i], np.zeros(overlap, np.int64)]) for i in chosen])
            starts = np.cumsum([0, *[len(ids[i]) + overlap for i in chosen]])
            unique, back = np.unique(flat, return_inverse=True)
            vectors = model.embedding[rows[unique]].sum(1)
            values = model.convolved((vectors @ model.parts)[back]) + model.offsets
            values[(starts[1:, None] - 1 - np.arange(overlap)).ravel()] = -np.inf
            best = np.stack([values[a:b].argmax(0) + a for a, b in zip(starts[:-1], starts[1:])])
            peak = np.take_along_axis(values, best, 0) if len(values) else values
            pooled = np.maximum(peak, 0)
            error = 1 / (1 + np.exp(-np.clip(pooled @ model.weights + model.bias, -30, 30))) - y[chosen]
            error = (error * weight[chosen] / len(chosen)).astype(np.float32)
            to_pooled = error[:, None] * model.weights * (peak > 0)
            gradients = {w: np.zeros_like(f) for w, f in model.filters.items()}
            to_vector = np.zeros_like(vectors)
            for n, width in enumerate(WIDTHS):
                columns = slice(n * FILTERS, (n + 1) * FILTERS)
                for k in range(width):
                    place = back[np.minimum(best[:, columns] + k, len(back) - 1)]
                    gradients[width][k] += np.einsum("df,dfs->sf", to_pooled[:, columns], vectors[place])
                    np.add.at(to_vector, place, to_pooled[:, columns, None] * model.filters[width][k].T)
            moved = np.flatnonzero(to_vector.any(1))
            touched, where = np.unique(rows[unique[moved]], return_inverse=True)
            to_embedding = np.zeros((len(touched), SIZE), np.float32)
            np.add.at(to_embedding, where.reshape(-1, 1 + len(PREFIXES)), to_vector[moved][:, None, :])
            to_embedding[~used[touched]] = 0
            embedding_square[touched] += to_embedding**2
            model.embedding[touched] -= rate * to_embedding / np.sqrt(embedding_square[touched])
            steps = [*gradients.values(), to_pooled.sum(0), error @ pooled]
            for value, gradient, square in zip((*model.filters.values(), model.offsets, model.weights), steps, squares):
                square += gradient**2
                value -= rate * gradient / np.sqrt(square)
            bias_square += float(error.sum()) ** 2
            model.bias -= rate * float(error.sum()) / bias_square**0.5
    held_out = np.flatnonzero(calibration)
    logits, langs = Scorer(model).measure([split[i] for i in held_out])
    model.thresholds = calibrated(logits, y[held_out], langs)
    return model


def calibrated(logits: np.ndarray, y: np.ndarray, langs: list[str]) -> dict[str, float]:
    """Per language the threshold with the fewest errors, midway in its gap; few rows use the common one."""

    def best(z: np.ndarray, t: np.ndarray) -> float:
        order = np.argsort(z)
        z, t = z[order], t[order]
        errors = np.concatenate([[0], np.cumsum(t == 1)]) + np.concatenate([np.cumsum((t == 0)[::-1])[::-1], [0]])
        least = np.flatnonzero(errors == errors.min())
        padded = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
        widest = least[np.argmax(padded[least + 1] - padded[least])]
        return float((padded[widest] + padded[widest + 1]) / 2)

    found = {"": best(logits, y) if len(set(y.tolist())) == 2 else 0.0}
    langs_array = np.array(langs)
    for lang in FUNCTION_WORDS:
        own = langs_array == lang
        if (y[own] == 1).sum() >= 10 and (y[own] == 0).sum() >= 10:
            found[lang] = best(logits[own], y[own])
    return found


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """Texts and labels of a bounded, hashed sample of the rows that may be learned from."""
    allowed = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        "doc_id IS NOT NULL AND toxic IN (0, 1) AND crc32(CAST(doc_id AS STRING)) % 3 <> 1"
    )
    able = docs.where(F.length("text") <= LONGEST).select("doc_id", "text")
    rows: list = []
    for toxic, most in ((1, POSITIVE), (0, NEGATIVE)):
        # Twice as many ids as texts are looked up, as some are not in docs or too long.
        ids = allowed.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * most).select("doc_id").distinct()
        rows += [(r.text, toxic) for r in able.join(ids, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(most).collect()]
    return [t for t, _ in rows], [y for _, y in rows]


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[Model, str]:
    """The model of a table, and a version to tell it from others."""
    model = train(*training_sample(docs, labels))
    return model, f"{zlib.crc32(model.embedding.tobytes())}:{model.bias}"


def scores_of(texts: list[str], model: Model, version: str) -> np.ndarray:
    scorer = per_process("toxicity", version, lambda: Scorer(model))
    logits, langs = scorer.measure([words_of(t) for t in texts])
    return model.score(logits.astype(np.float64), langs)


def score(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Only the text is read for a score. Null and empty texts get the score of no words; null
    ids are not held out; repeated rows come back one by one; labels that are null, other than
    0 and 1, or of unknown documents teach nothing. Without labels of both classes all scores
    are constant. An empty table gives an empty result.
    """
    narrow = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    model, version = fitted(narrow, labels)

    def predict(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(source):
            scores = pa.array(scores_of(texts, model, version), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), scores], names=["doc_id", "score"])

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return narrow.mapInArrow(predict, "doc_id long, score double").select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )


def rejecting(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` (with doc_id and text) without the rows predicted toxic; one pass, no shuffle of texts."""
    model, version = fitted(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), labels)

    def keep(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(source):
            yield batch.filter(pa.array(scores_of(texts, model, version) < CUT))

    return docs.mapInArrow(keep, docs.schema)
