"""Near-duplicate documents with b-bit MinHash, confirmed on full shingle sets.

1. One pass per text: distinct word shingles, their count and 128-bit set fingerprint, a
   signature of minima under random linear hashes, its band keys, and a sketch that keeps the
   low bits of every minimum.
2. Equal sets collapse to one representative, so exact copies cost nothing further.
3. Every band bucket offers its members only to its smallest one (a star, never all pairs).
   Sketches estimate the similarity, corrected for chance equality of bits; pairs that may
   reach the threshold are confirmed on the texts' full sets.
4. Buckets whose members are still in different components are searched completely, across
   components only. Their sketches give the clusters in which links may be left (as spanning
   forests, not as pairs); each cluster is then searched on the full sets through an index of
   its shingles, block by block. So no shared bucket leaves a link unseen.
5. The components of all confirmed links give the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.common import batches, components
from quillspark.session import materialize

WORDS = 4
BANDS, ROWS, BITS = 24, 4, 4
HASHES = BANDS * ROWS
#: Five standard errors of the estimate at a similarity of 0.8 with 96 hashes.
MARGIN = 0.2
#: Rows of a bucket's block, and shingles of a cluster's block.
BLOCK, SHINGLES = 2048, 1_000_000
THRESHOLD = 0.8
SEED = 20240817


def word_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles (A-Z lower-cased)."""
    split = [t.encode().lower().split() for t in texts]
    sizes = np.array([len(w) for w in split])
    flat = np.array([w for ws in split for w in ws] or [b""], dtype=object)
    hashes = pd.util.hash_array(flat, categorize=False)
    ends = np.cumsum(sizes)
    found = []
    for n, end in zip(sizes.tolist(), ends.tolist()):
        of = hashes[end - n:end]
        width = min(words, n)
        if not n:
            found.append(np.zeros(0, np.uint64))
            continue
        joined = np.full(n - width + 1, np.uint64(width), np.uint64)
        for k in range(width):
            joined = scramble(joined * np.uint64(0x9E3779B97F4A7C15) + of[k:n - width + 1 + k])
        found.append(np.unique(joined))
    return found


def scramble(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of MurmurHash3."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def signature(hashes: np.ndarray, factors: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """The least value of every linear hash over a set."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for begin in range(0, len(hashes), 512):
        part = hashes[begin:begin + 512, None] * factors
        part += terms
        np.minimum(least, part.min(0), out=least)
    return least


def low_bits(minima: np.ndarray) -> bytes:
    """The low bits of every (scrambled) minimum, packed."""
    nibbles = (scramble(minima) & np.uint64(2**BITS - 1)).astype(np.uint8)
    return (nibbles[0::2] | nibbles[1::2] << 4).tobytes()


def estimated(equal: np.ndarray) -> np.ndarray:
    """Similarity from the number of equal low-bit values, corrected for chance collisions."""
    chance = 2.0**-BITS
    return (equal / HASHES - chance) / (1 - chance)


def equal_nibbles(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    differing = left ^ right
    return ((differing & 15) == 0).sum(-1, dtype=np.int32) + ((differing >> 4) == 0).sum(-1, dtype=np.int32)


def features(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, n_shingles, high, low, bands, sketch`` of every row; no bands without words."""
    random = np.random.default_rng(SEED)
    factors = random.integers(0, 2**63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
    terms = random.integers(0, 2**63, HASHES, np.uint64)

    def digest(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for batch, texts in batches(source):
            n, high, low, bands, sketches = [], [], [], [], []
            for hashes in word_sets(texts, words):
                n.append(len(hashes))
                high.append(int(scramble(hashes).sum(dtype=np.uint64).astype(np.int64)))
                low.append(int(np.bitwise_xor.reduce(scramble(hashes + np.uint64(SEED))).astype(np.int64)) if len(hashes) else 0)
                if not len(hashes):
                    bands.append(None)
                    sketches.append(None)
                    continue
                minima = signature(hashes, factors, terms)
                keys = salt.copy()
                for k in range(ROWS):
                    keys = scramble(keys + minima.reshape(BANDS, ROWS)[:, k])
                bands.append(keys.astype(np.int64))
                sketches.append(low_bits(minima))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                names=["doc_id", "n_shingles", "high", "low", "bands", "sketch"],
            )

    return docs.mapInArrow(digest, "doc_id long, n_shingles long, high long, low long, bands array<long>, sketch binary")


def plausible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose set sizes and sketches allow the threshold."""

    def keep(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            left, right = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HASHES // 2) for c in ("sketch_a", "sketch_b")
            )
            good = estimated(equal_nibbles(left, right)) >= percent / 100 - MARGIN
            yield batch.select(["a", "b"]).filter(pa.array(good))

    side = {x: sketches.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab"}
    return (
        pairs.join(side["a"], "a").join(side["b"], "b")
        .where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        .select("a", "b", "sketch_a", "sketch_b").mapInArrow(keep, "a long, b long")
    )


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets reach the threshold."""

    def compare(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, left in batches(source, 1 << 19, "text_a"):
            right = [t or "" for t in batch.column("text_b").to_pylist()]
            known: dict[str, np.ndarray] = {}
            fresh = list(dict.fromkeys([*left, *right]))
            known.update(zip(fresh, word_sets(fresh, words)))
            good = []
            for x, y in zip(left, right):
                p, q = known[x], known[y]
                common = len(np.intersect1d(p, q, assume_unique=True))
                good.append(bool(common) and 100 * common >= percent * (len(p) + len(q) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = {x: docs.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab"}
    return pairs.join(side["a"], "a").join(side["b"], "b").select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long")


class Forest:
    """Union-find over positions; ``join`` tells whether two trees became one."""

    def __init__(self, roots: np.ndarray):
        self.up = roots.tolist()

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def active(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows outside the largest group, which alone must be compared, and each row's first of its group."""
    _, first, back, sizes = np.unique(group, return_index=True, return_inverse=True, return_counts=True)
    return np.flatnonzero(back != sizes.argmax()), first[back]


def in_block_pairs(rows: DataFrame, cluster: str, blocks: str) -> DataFrame:
    """Every row once per pair of its cluster's blocks that its own block belongs to: ``first, second``."""
    own = F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    return (
        rows.withColumn("own", own).withColumn("other", other)
        .withColumn("first", F.least("own", "other")).withColumn("second", F.greatest("own", "other")).drop("own", "other", blocks)
    )


def likely(members: DataFrame, percent: int) -> DataFrame:
    """Forests (a, b) of the pairs of one bucket but different components that sketches and sizes allow.

    ``members`` has ``key, node, component_id, sketch, n_shingles, total`` (the bucket's size). A
    block pair holds about ``2 * BLOCK`` rows at most.
    """

    def search(bucket: pd.DataFrame) -> pd.DataFrame:
        bucket = bucket.sort_values("node")
        node, group, n = (bucket[c].to_numpy() for c in ("node", "component_id", "n_shingles"))
        sketch = np.frombuffer(b"".join(bucket["sketch"]), np.uint8).reshape(-1, HASHES // 2)
        asking, _ = active(group)
        forest, found = Forest(np.arange(len(node))), []
        for i in asking.tolist():
            others = np.flatnonzero((group != group[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
            near = estimated(equal_nibbles(sketch[others], sketch[i])) >= percent / 100 - MARGIN
            found += [(node[i], node[j]) for j in others[near].tolist() if forest.join(i, j)]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    spread = in_block_pairs(members.withColumn("blocks", F.ceil(F.col("total") / BLOCK).cast("int")).drop("total"), "key", "blocks")
    return spread.groupBy("key", "first", "second").applyInPandas(search, "a long, b long").distinct()


def searched(members: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Forests (a, b) of the confirmed links of one cluster but different components.

    ``members`` has ``cluster, node, component_id, n_shingles``. A block pair holds about
    ``2 * SHINGLES`` shingles at most; an index of its shingles gives exact intersections.
    """

    def shingled(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, held in batches(source):
            sets = [x.tobytes() for x in word_sets(held, words)]
            names = ["cluster", "node", "component_id", "blocks"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sets, pa.binary())], names=[*names, "hashes"])

    def search(cluster: pd.DataFrame) -> pd.DataFrame:
        cluster = cluster.sort_values("node")
        node, group = cluster["node"].to_numpy(), cluster["component_id"].to_numpy()
        n = np.array([len(h) // 8 for h in cluster["hashes"]])
        owner = np.repeat(np.arange(len(n)), n)
        _, shingle, held = np.unique(np.frombuffer(b"".join(cluster["hashes"]), np.uint64), return_inverse=True, return_counts=True)
        by_shingle = owner[np.argsort(shingle, kind="stable")]
        begin, row_begin = np.cumsum(held) - held, np.cumsum(n) - n
        asking, same = active(group)
        forest, found = Forest(same), []
        for i in asking.tolist():
            own = shingle[row_begin[i]:row_begin[i] + n[i]]
            own = own[held[own] > 1]
            counts = held[own]
            at = np.repeat(begin[own] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            common = np.bincount(by_shingle[at], minlength=len(n))
            linked = (group != group[i]) & (common > 0) & (100 * common >= percent * (n + n[i] - common))
            found += [(node[i], node[j]) for j in np.flatnonzero(linked).tolist() if forest.join(i, j)]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    total = members.groupBy("cluster").agg(F.ceil(F.sum("n_shingles") / SHINGLES).cast("int").alias("blocks"))
    sets = (
        members.join(materialize(total), "cluster").join(texts, F.col("node") == F.col("doc_id"))
        .select("cluster", "node", "component_id", "blocks", "text")
        .mapInArrow(shingled, "cluster long, node long, component_id long, blocks int, hashes binary")
    )
    return in_block_pairs(sets, "cluster", "blocks").groupBy("cluster", "first", "second").applyInPandas(search, "a long, b long")


def deduplicate(docs: DataFrame, words: int = WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``.

    Null, empty and blank texts have no shingles and are linked with nothing. Rows that share
    a doc_id are one node of the graph and each come back. A row without doc_id is linked with
    nothing; its component is null and it is kept. An empty table gives an empty result. Other
    columns are neither read nor returned.
    """
    percent = round(100 * THRESHOLD)
    texts = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    known = materialize(features(texts, words))
    sets = known.where("doc_id IS NOT NULL AND n_shingles > 0")
    groups = materialize(sets.groupBy("high", "low", "n_shingles").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")))
    copies = (
        sets.select("doc_id", "high", "low", "n_shingles").join(groups.where("copies > 1"), ["high", "low", "n_shingles"])
        .where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    )
    nodes = materialize(
        sets.select(F.col("doc_id").alias("node"), "high", "low", "n_shingles", "bands", "sketch")
        .join(groups.select("high", "low", "node"), ["high", "low", "node"], "left_semi")
    )
    banded = nodes.select("node", F.explode("bands").alias("key"))
    buckets = materialize(banded.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("total")).where("total > 1"))
    star = banded.join(buckets, "key").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    links = materialize(confirmed(materialize(plausible(star, nodes, percent)), texts, words, percent))

    # What the stars left apart: buckets that hold several components.
    placed = materialize(
        nodes.join(components(links), "node", "left")
        .select("node", "bands", "sketch", "n_shingles", F.coalesce("component_id", "node").alias("component_id"))
    )
    member = placed.select(F.explode("bands").alias("key"), "node", "component_id").join(buckets.select("key", "total"), "key")
    open_buckets = materialize(
        member.groupBy("key").agg(F.min("component_id").alias("lo"), F.max("component_id").alias("hi"), F.first("total").alias("total"))
        .where("lo <> hi").select("key", "total")
    )
    inside = placed.select(F.explode("bands").alias("key"), "node", "component_id", "sketch", "n_shingles").join(open_buckets, "key")
    clusters = components(likely(inside, percent)).withColumnRenamed("component_id", "cluster")
    more = searched(placed.select("node", "component_id", "n_shingles").join(clusters, "node"), texts, words, percent)
    everything = links.unionByName(more).unionByName(copies)
    grouped = materialize(components(everything))
    return (
        known.select("doc_id", "n_shingles")
        .join(grouped.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
