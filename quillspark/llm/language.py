"""Language identification by words first, backing off to character n-grams.

Jauhiainen et al., "HeLI, a Word-Based Backoff Method for Language Identification": a word
that the training texts hold scores the logarithm of its relative frequency in each language
(a fixed low value where a language lacks it). An unseen word is scored by its character
n-grams, the longest that any language holds, as their mean. A text's score is the mean over
its words.

Word and n-gram counts cover all training texts; they are summed per task before they are
shuffled. The model keeps the commonest ones, so that its size is bounded whatever the corpus.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.llm.common import batches, per_process
from quillspark.session import materialize

LETTERS = re.compile(r"[^\W\d_]+")
#: Orders of the n-grams of a word and its two ends.
ORDERS = (5, 4, 3, 2, 1)
END = " "
#: Known words, and n-grams of each order, at most; fewer when there are so many languages that a table would pass CELLS.
WORDS, GRAMS, CELLS = 100_000, 50_000, 4_000_000
#: The score (log10) of a word or n-gram in a language that lacks it.
ABSENT = -7.0
#: Distinct words a task counts before it hands them on.
HELD = 400_000
#: Words a Python worker keeps scored.
KEPT = 400_000
#: Words of evidence after which further ones no longer raise a text's certainty.
SURE = 20


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def grams_of(word: str, order: int) -> list[str]:
    ended = f"{END}{word}{END}"
    return [ended[i:i + order] for i in range(len(ended) - order + 1)]


def held_out(id_column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 3 == 1, F.lit(False))


def counts(docs: DataFrame) -> DataFrame:
    """``lang, word, n`` over all texts of ``docs`` (text, lang)."""

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter[str]] = defaultdict(Counter)

        def handed() -> pa.RecordBatch:
            rows = [(lang, w, n) for lang, words in held.items() for w, n in words.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

        for batch, texts in batches(source):
            for lang, text in zip(batch.column("lang").to_pylist(), texts):
                held[lang].update(words_of(text))
            if sum(map(len, held.values())) > HELD:
                yield handed()
        if any(held.values()):
            yield handed()

    return docs.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Model:
    """``tables`` (0: words, else n-grams of that order) give each known form its row of scores per language."""

    def __init__(self, languages: list[str], tables: dict[int, tuple[dict[str, int], np.ndarray]], common: int, version: str):
        self.languages, self.tables, self.common, self.version = languages, tables, common, version

    def rows(self, words: list[str]) -> np.ndarray:
        """Each word's score per language and a last column of 1, or all 0 where no language holds any part of it."""
        found = np.zeros((len(words), len(self.languages) + 1), np.float32)
        index, values = self.tables[0]
        ids = np.fromiter((index.get(w, -1) for w in words), np.int64, len(words))
        known = ids >= 0
        found[known, :-1], found[known, -1] = values[ids[known]], 1
        rest = np.flatnonzero(~known).tolist()
        for order in ORDERS:
            index, values = self.tables[order]
            get, hits, flat, ends, left = index.get, [], [], [0], []
            for at in rest:
                parts = [i for g in grams_of(words[at], order) if (i := get(g)) is not None]
                if parts:
                    hits.append(at)
                    flat += parts
                    ends.append(len(flat))
                else:
                    left.append(at)
            if hits:
                sums = np.add.reduceat(values[flat], ends[:-1], axis=0)
                found[hits, :-1], found[hits, -1] = sums / np.diff(ends)[:, None], 1
            rest = left
        return found


class Scorer:
    """A model with the rows of the words it met, at most ``KEPT``."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.rows = np.zeros((1024, len(model.languages) + 1), np.float32)

    def learn(self, words: list[str]) -> None:
        fresh = [w for w in dict.fromkeys(words) if w not in self.known]
        if len(self.known) + len(fresh) > KEPT and self.known:
            self.known.clear()
            fresh = list(dict.fromkeys(words))
        if len(self.known) + len(fresh) > len(self.rows):
            more = np.zeros((2 * (len(self.known) + len(fresh)), self.rows.shape[1]), np.float32)
            more[:len(self.rows)] = self.rows
            self.rows = more
        begin = len(self.known)
        self.rows[begin:begin + len(fresh)] = self.model.rows(fresh)
        self.known.update(zip(fresh, range(begin, begin + len(fresh))))

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        split = [words_of(t) for t in texts]
        flat = [w for ws in split for w in ws]
        self.learn(flat)
        ids = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        sums = np.zeros((len(texts), self.rows.shape[1]))
        starts = np.cumsum([0, *map(len, split)])
        full = np.flatnonzero(np.diff(starts))
        for begin in range(0, len(full), 512):
            some = full[begin:begin + 512]
            a, b = starts[some[0]], starts[some[-1] + 1]
            sums[some] = np.add.reduceat(self.rows[ids[a:b]].astype(np.float64), starts[some] - a, axis=0)
        langs, scores = [], []
        for i, row in enumerate(sums):
            if not self.model.languages or not any(c.isalpha() for c in texts[i]):
                langs.append("und")
                scores.append(0.0)
                continue
            n = row[-1]
            if n == 0:  # no language holds any part of it: the commonest
                langs.append(self.model.languages[self.model.common])
                scores.append(1 / len(self.model.languages))
                continue
            mean = row[:-1] / n
            best = int(mean.argmax())
            langs.append(self.model.languages[best])
            scores.append(float(1 / np.power(10.0, np.maximum(-300, (mean - mean[best]) * min(n, SURE))).sum()))
        return langs, scores


def train(docs: DataFrame) -> Model:
    """The model of all rows of ``docs`` (text, lang) with neither null."""
    words = materialize(counts(docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")))
    totals = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    number = {lang: i for i, lang in enumerate(languages)}
    # All orders in one pass over the distinct words.
    ended = F.concat(F.lit(END), "word", F.lit(END))

    def parts_of(order: int) -> Column:
        places = F.sequence(F.lit(1), F.length(ended) - order + 1)
        some = F.transform(places, lambda i: F.substring(ended, i, F.lit(order)))
        return F.when(F.length(ended) >= order, some).otherwise(F.array().cast("array<string>"))

    # An n-gram's length is its order.
    grams = words.select("lang", F.explode(F.concat(*map(parts_of, ORDERS))).alias("form"), "n").groupBy("lang", "form").agg(F.sum("n").alias("n"))
    forms = materialize(grams.withColumn("order", F.length("form"))).unionByName(words.select("lang", F.col("word").alias("form"), "n", F.lit(0).alias("order")))
    sizes = {(r["order"], r["lang"]): r["n"] for r in forms.groupBy("order", "lang").agg(F.sum("n").alias("n")).collect()}
    tables = {}
    for order in (0, *ORDERS):
        most = max(1, min(GRAMS if order else WORDS, CELLS // max(1, len(languages))))
        own = forms.where(F.col("order") == order)
        common = own.groupBy("form").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "form").limit(most).select("form")
        kept = own.join(common, "form").select("lang", "form", "n").toArrow()
        form = kept.column("form").combine_chunks().dictionary_encode()
        index = {f: i for i, f in enumerate(form.dictionary.to_pylist())}
        values = np.full((len(index), len(languages)), ABSENT, np.float32)
        langs = kept.column("lang").to_pylist()
        total = np.array([sizes[order, lang] for lang in langs], np.float64)
        values[form.indices.to_numpy(), np.array([number[lang] for lang in langs], np.int64)] = np.log10(kept.column("n").to_numpy() / total)
        tables[order] = index, values
    common = min(range(len(languages)), key=lambda i: (-totals[languages[i]], languages[i]), default=0)
    version = f"{sorted(totals.items())}:{[len(i) for i, _ in tables.values()]}:{[float(v.sum()) for _, v in tables.values()]}"
    return Model(languages, tables, common, version)


def identify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row of ``docs``.

    Learns from rows that have id, text and language and are not held out; predicts from the
    text alone. ``und`` with score 0: null and empty texts, texts without letters, and every
    text where nothing was learned. Texts whose letters occur in no language get the commonest
    language. Equal scores go to the first language by name. The score is the share of the best
    language in the likelihoods of ``SURE`` words. Null ids are not held out and teach nothing;
    repeated rows come back one by one and teach as often. An empty table gives an empty result.
    """
    narrow = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"), docs[lang_column].cast("string").alias("lang"))
    model = train(narrow.where(F.col("doc_id").isNotNull() & ~held_out()))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = per_process("language", sent.value.version, lambda: Scorer(sent.value))
        for batch, texts in batches(source):
            langs, scores = scorer.predict(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return narrow.select("doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double").select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score"
    )
