"""Ranked lexical search of many queries at once, sharing common subexpressions.

The items' terms are mined for shared sets: an item is a list of symbols (a term and which
repeat of it), ordered by how many items hold them; neighbours that two or more items share
become one node, round after round, until nothing is shared. The nodes form a DAG whose leaves
are terms and from which every item is a sum. Documents are cut into terms once; what their
query terms weigh is put into accumulators per node, each computed once for a group of
documents and read by every item below it.

No postings move: a task keeps the best documents per item of its own rows, and only those
are ranked across tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quillspark.llm.common import Leaders, batches, texts_of
from quillspark.session import materialize

#: Query symbols a search handles at once; more items are searched group by group.
SYMBOLS = 100_000
#: Cells of the accumulators of one group of documents.
CELLS = 1 << 22
#: Bytes of terms stay, A-Z in lower case; all others separate. Letters beyond ASCII have bytes from 0x80 in UTF-8.
TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(TERM_BYTES).split()


class Sharing:
    """The sharing DAG of a group of items.

    Nodes are numbered so that a node's parts come first: ``leaves`` holds the term of each
    leaf, ``parts`` the two nodes each further node adds up, ``roots`` the nodes of each item.
    """

    def __init__(self, items: list[list[bytes]]):
        held: Counter[tuple[bytes, int]] = Counter()
        lists = []
        for terms in items:
            lists.append([(t, k) for t, n in Counter(terms).items() for k in range(n)])
            held.update(lists[-1])
        order = sorted(held, key=lambda s: (-held[s], s))
        number = {s: i for i, s in enumerate(order)}
        self.terms = list(dict.fromkeys(t for t, _ in order))
        index = {t: i for i, t in enumerate(self.terms)}
        self.leaves = np.array([index[t] for t, _ in order], np.int64)
        self.parts: list[tuple[int, int]] = []
        self.roots = [sorted(number[s] for s in symbols) for symbols in lists]
        while True:
            pairs = Counter(p for nodes in self.roots for p in zip(nodes, nodes[1:]))
            most = max(pairs.values(), default=0)
            if most < 2:
                break
            merged: dict[tuple[int, int], int] = {}
            taken: set[int] = set()  # a node joins one pair a round, so that every new node is used
            for pair, n in sorted(pairs.items(), key=lambda x: (-x[1], x[0])):
                if n < max(2, most / 2):
                    break
                if taken.isdisjoint(pair):
                    taken.update(pair)
                    merged[pair] = len(order) + len(self.parts)
                    self.parts.append(pair)
            self.roots = [self.replaced(nodes, merged) for nodes in self.roots]

    @staticmethod
    def replaced(nodes: list[int], merged: dict[tuple[int, int], int]) -> list[int]:
        out, i = [], 0
        while i < len(nodes):
            new = merged.get((nodes[i], nodes[i + 1])) if i + 1 < len(nodes) else None
            out.append(nodes[i] if new is None else new)
            i += 1 if new is None else 2
        return out

    @property
    def nodes(self) -> int:
        return len(self.leaves) + len(self.parts)

    def scores(self, values: np.ndarray) -> np.ndarray:
        """Items x documents from what every term gives every document."""
        sums = np.empty((self.nodes, values.shape[1]), np.int64)
        sums[:len(self.leaves)] = values[self.leaves]
        for node, (a, b) in enumerate(self.parts, len(self.leaves)):
            np.add(sums[a], sums[b], out=sums[node])
        return np.stack([sums[nodes].sum(0) for nodes in self.roots])


def counted(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """``doc_id, n, terms, times``: a document's length and how often it holds which query terms."""
    schema = "doc_id long, n long, terms array<int>, times array<int>"

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(terms)}
        for batch, texts in batches(source):
            sizes, ends, ids, times = [], [0], [], []
            for text in texts:
                found = Counter(terms_of(text))
                sizes.append(found.total())
                known = number.keys() & found.keys() if len(found) > len(number) else [t for t in found if t in number]
                ids += [number[t] for t in known]
                times += [found[t] for t in known]
                ends.append(len(ids))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (ids, times)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "times"])

    return docs.mapInArrow(count, schema)


def ranked(held: DataFrame, items: list[int | None], sharing: Sharing, k: int) -> DataFrame:
    """``item_id, doc_id, score``: the k best of every task for every item."""
    totals = held.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    documents, length = int(totals[0]), int(totals[1])
    frequency = {r[0]: r[1] for r in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency.get(i, 0) + 1))) for i in range(len(sharing.terms))], np.int64)

    def best(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = max(1, min(1024, CELLS // max(1, sharing.nodes)))
        leaders = Leaders(len(items), k)
        for batch in source:
            batch = batch.filter(pa.array(batch.column("doc_id").is_valid()))
            for begin in range(0, len(batch), width):
                part = batch.slice(begin, width)
                ids, n = (part.column(c).to_numpy() for c in ("doc_id", "n"))
                counts = np.diff(part.column("terms").offsets.to_numpy())
                terms, times = (part.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "times"))
                norm = np.repeat(25 + 75 * n * documents // max(1, length), counts)
                values = np.zeros((len(sharing.terms), len(part)), np.int64)
                values[terms, np.repeat(np.arange(len(part)), counts)] = weights[terms] * (1_000_000_000 * times // (1000 * times + 8 * norm))
                scores = sharing.scores(values)
                item, doc = np.nonzero((scores > 0) & (scores >= leaders.floor[:, None]))
                leaders.offer(item, scores[item, doc], ids[doc])
        yield pa.RecordBatch.from_arrays(
            [pa.array([items[i] for i in leaders.owner], pa.int64()), pa.array(leaders.id), pa.array(leaders.score)], names=["item_id", "doc_id", "score"]
        )

    return held.mapInArrow(best, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id") -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of every item with a score above 0.

    Null and empty texts have no terms and are found by nothing; an item without terms finds
    nothing. Rows that share a doc_id are documents each; rows without one count in the
    statistics but cannot be returned. Rows that share an item_id (null is one) are one item,
    the first text in order. Equal scores are ranked by doc_id. Empty tables give an empty
    result. Texts are read whole; other columns are neither read nor returned. Products of a
    document's length and the number of documents must stay below 2**63 / 75.

    Items are searched in groups of about ``SYMBOLS`` terms. What a group holds on the driver
    and in every task is bounded by that number, or by its one item that is longer.
    """
    spark = docs.sparkSession
    narrow = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    asked = items.select(items[item_column].cast("long").alias("item_id"), items["text"]).groupBy("item_id").agg(F.min("text").alias("text"))

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            terms = [terms_of(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(terms, pa.list_(pa.binary()))], names=["item_id", "terms"])

    asked = materialize(asked.mapInArrow(cut, "item_id long, terms array<binary>").where("size(terms) > 0"))
    groups = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // SYMBOLS)
    found = []
    for group in range(groups):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == group).orderBy("item_id").collect()
        if rows:
            sharing = Sharing([[bytes(t) for t in r["terms"]] for r in rows])
            held = materialize(counted(narrow, sharing.terms))
            found.append(ranked(held, [r["item_id"] for r in rows], sharing, k))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return (
        reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
        .select("item_id", "rank", "doc_id", "score")
    )


#: The contract in SQL.
ORACLE = r"""
    WITH terms AS (
        SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
    ), docs AS (SELECT row, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM terms WHERE len(terms) > 0),
    totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM docs),
    held AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(terms) AS term FROM docs) GROUP BY ALL),
    weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, totals GROUP BY term, docs),
    asked AS (
        SELECT item_id, term, count(*) AS times FROM (
            SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
        ) GROUP BY ALL
    ), scored AS (
        SELECT item_id, row, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length)))) AS BIGINT) AS score
        FROM asked JOIN held USING (term) JOIN weights USING (term), totals GROUP BY item_id, row, doc_id
    )
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""
