"""Near-duplicate vectors by NN-descent: neighbour lists refined through neighbours of neighbours.

1. Equal vectors of a label collapse to one node.
2. Lists start from a few random-projection orders: nodes near each other in an order are
   compared in blocks of fixed size, so no label or code is too large.
3. Rounds of local joins: at every node its neighbours and reverse neighbours are compared
   with each other (long reverse lists in blocks), and lists keep their best.
4. Close pairs are checked in double precision and give components. Nodes whose whole list is
   close are saturated: they are compared again in fresh orders with lists twice as long,
   until their components stop merging.
5. Recall is audited: partners of sampled nodes are counted exactly and averaged node by node,
   apart for nodes with few and many. While it is short, further rounds follow, then fresh
   orders and longer lists; if it stays short, or links are too rare to measure it, components
   are compared block by block until nothing is left out. Links of a first sample are kept.
6. Links are counted inside components. Nodes close enough to the component's centre are all
   linked with each other by the triangle inequality; only the others are compared.

Lists carry vectors as signed bytes; ``SLACK`` covers the rounding.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quillspark.llm.common import components
from quillspark.session import materialize

THRESHOLD = 0.93
LIST, ORDERS, BLOCK, REVERSE, ROUNDS = 8, 3, 32, 48, 3
SLACK = 0.03
#: Nodes searched exactly by the audit at first, and the recall it asks for.
AUDITED, RECALL = 512, 0.95
#: Nodes with few partners the audit's sample should hold, and about the most nodes it grows to for them.
ENOUGH, MOST_AUDITED = 100, 8192
#: Rounds and enlargements after which a short recall is made up for by comparing all blocks.
MOST_ROUNDS = 8
#: Members of a component compared in one task, at most, on either side.
MEMBERS = 2048
EDGE = "u long, v long, s float"
EDGE_COLUMNS = ["u", "v", "s"]


def quantized(vectors: np.ndarray) -> np.ndarray:
    return np.rint(vectors * 127).astype(np.int8)


def matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Binary values as rows of an array; shorter ones end in zeros (only rows of one length are compared)."""
    values = column.to_pylist()
    if len({len(v) for v in values}) > 1:
        longest = max(map(len, values))
        values = [v.ljust(longest, b"\0") for v in values]
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def narrowed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two arrays cut to the columns both have; rows that may be compared have nothing beyond."""
    width = min(a.shape[1], b.shape[1])
    return a[:, :width], b[:, :width]


def unit_vectors(rows: DataFrame) -> DataFrame:
    """``vec_id, label, unit`` (doubles, as bytes) of the rows that can have links.

    The label is prefixed by the vector's length, as only equal lengths are compared. Vectors are
    scaled by their largest component first, so that squares neither overflow nor vanish.
    """

    def normalize(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            vectors = [np.array([np.nan] if v is None or None in v else v, np.float64) for v in batch.column("embedding").to_pylist()]
            largest = [float(np.abs(v).max()) for v in vectors]
            good = [0 < n < np.inf for n in largest]
            scaled = [v / n if ok else None for v, n, ok in zip(vectors, largest, good)]
            unit = [None if v is None else (v / np.linalg.norm(v)).tobytes() for v in scaled]
            labels = [f"{len(v)}:{name}" for v, name in zip(vectors, batch.column("label").to_pylist())]
            full = pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(labels, pa.string()), pa.array(unit, pa.binary())], names=["vec_id", "label", "unit"])
            yield full.filter(pa.array(good))

    usable = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0")
    return usable.select("vec_id", "label", "embedding").mapInArrow(normalize, "vec_id long, label string, unit binary")


def edges_of(u: np.ndarray, v: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float32())], names=EDGE_COLUMNS)


def best_of(node: np.ndarray, sims: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``keep`` best columns of every row of a square similarity block (its diagonal is -inf)."""
    keep = min(keep, len(node) - 1)
    if keep < 1:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    top = np.argpartition(-sims, keep - 1, axis=1)[:, :keep]
    return np.repeat(node, keep), node[top].ravel(), np.take_along_axis(sims, top, 1).ravel()


def projected(nodes: DataFrame, orders: Iterable[int], keep: int, block: int) -> DataFrame:
    """Neighbours within blocks of the random-projection orders numbered ``orders``."""

    def coded(number: int):
        def code(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in source:
                vectors = matrix(batch.column("q"), np.int8).astype(np.float32) if batch.num_rows else np.zeros((0, 1), np.float32)
                planes = np.random.default_rng(number).normal(size=(vectors.shape[1], 24)).astype(np.float32)
                codes = ((vectors @ planes) > 0) @ (1 << np.arange(24))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.int64())], names=[*batch.schema.names, "code"])

        return code

    def compare(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if not batch.num_rows:
                continue
            node, label = batch.column("node").to_numpy(), np.array(batch.column("label").to_pylist(), object)
            vectors = matrix(batch.column("q"), np.int8).astype(np.float32) / 127
            found = [[], [], []]
            for a in range(0, len(node), block // 2):  # overlapping by half
                part = slice(a, a + block)
                sims = vectors[part] @ vectors[part].T
                sims[label[part][:, None] != label[part][None, :]] = -2
                np.fill_diagonal(sims, -np.inf)
                for column, values in zip(found, best_of(node[part], sims, keep)):
                    column.append(values)
            u, v, s = (np.concatenate(c) for c in found)
            near = s > -1.5
            yield edges_of(u[near], v[near], s[near])

    out = None
    for number in orders:
        ordered = (
            nodes.select("node", "label", "q").mapInArrow(coded(number), "node long, label string, q binary, code long")
            .repartitionByRange("label", "code", "node").sortWithinPartitions("label", "code", "node")
        )
        part = ordered.mapInArrow(compare, EDGE)
        out = part if out is None else out.unionByName(part)
    return out


def trimmed(edges: DataFrame, keep: int) -> DataFrame:
    """The best ``keep`` of every node's list."""
    once = edges.groupBy("u", "v").agg(F.max("s").alias("s"))
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v"))
    return once.withColumn("place", place).where(F.col("place") <= keep).drop("place")


def local_join(edges: DataFrame, nodes: DataFrame, keep: int, round_: int) -> DataFrame:
    """Pairs of neighbours of one node that would enter a list."""
    reverse = edges.select(F.col("v").alias("z"), F.col("u").alias("node"))
    blocks = reverse.groupBy("z").agg(F.ceil(F.count("*") / REVERSE).cast("int").alias("blocks"))
    dealt = reverse.join(blocks, "z").select("z", "node", F.pmod(F.xxhash64("node", F.lit(round_)), F.col("blocks")).cast("int").alias("block"))
    forward = edges.select(F.col("u").alias("z"), F.col("v").alias("node")).join(blocks, "z", "left")
    copied = forward.select("z", "node", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)).alias("block"))
    worst = edges.groupBy("u").agg(F.when(F.count("*") >= keep, F.min("s")).alias("worst"))
    vectors = nodes.select("node", "q").join(worst, nodes["node"] == worst["u"], "left").select("node", "q", F.coalesce("worst", F.lit(-2.0).cast("float")).alias("worst"))
    members = (
        dealt.unionByName(copied).distinct().join(vectors, "node").repartition("z", "block").sortWithinPartitions("z", "block")
    )

    def joined(z: np.ndarray, node: np.ndarray, q: np.ndarray, worst: np.ndarray) -> pa.RecordBatch:
        found = [[], [], []]
        starts = np.flatnonzero(np.concatenate([[True], (z[1:] != z[:-1]).any(1)]))
        for a, b in zip(starts, [*starts[1:], len(z)]):
            if b - a < 2:
                continue
            part = slice(a, b)
            vectors = q[part].astype(np.float32) / 127
            sims = vectors @ vectors.T
            np.fill_diagonal(sims, -np.inf)
            i, j = np.nonzero(sims > worst[part][:, None])
            for column, values in zip(found, (node[part][i], node[part][j], sims[i, j])):
                column.append(values)
        if not found[0]:
            return edges_of(*(np.zeros(0),) * 3)
        return edges_of(*(np.concatenate(c) for c in found))

    def compare(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []  # the last group of a batch may go on in the next
        for batch in source:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*kept, batch]).combine_chunks().to_batches()[0]
            z = np.stack([table.column("z").to_numpy(), table.column("block").to_numpy()], 1)
            end = int(np.flatnonzero((z != z[-1]).any(1)).max(initial=-1)) + 1
            if end:
                head = table.slice(0, end)
                yield joined(z[:end], head.column("node").to_numpy(), matrix(head.column("q"), np.int8), head.column("worst").to_numpy())
            kept = [table.slice(end)]
        for tail in kept:
            z = np.stack([tail.column("z").to_numpy(), tail.column("block").to_numpy()], 1)
            yield joined(z, tail.column("node").to_numpy(), matrix(tail.column("q"), np.int8), tail.column("worst").to_numpy())

    return members.select("z", "block", "node", "q", "worst").mapInArrow(compare, EDGE)


def exact(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose cosine in double precision reaches the threshold."""

    def check(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            good = np.zeros(0, bool)
            if batch.num_rows:
                good = (matrix(batch.column("unit_a"), np.float64) * matrix(batch.column("unit_b"), np.float64)).sum(1) >= threshold
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = {x: nodes.select(F.col("node").alias(x), F.col("unit").alias(f"unit_{x}")) for x in "ab"}
    return pairs.join(side["a"], "a").join(side["b"], "b").select("a", "b", "unit_a", "unit_b").mapInArrow(check, "a long, b long")


def close(edges: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    pairs = edges.where(F.col("s") >= threshold - SLACK).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    return exact(pairs, nodes, threshold)


def audit(nodes: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) of a bounded, hashed sample of nodes, searched exactly among all nodes of their label.

    Of a sampled node's links one per 4,096 rows is returned, so a large cluster cannot flood the audit.
    """
    sample = nodes.orderBy(F.xxhash64("node", F.lit(1)), "node").limit(AUDITED).select("node", "label", "unit").collect()
    ids = np.array([r.node for r in sample], np.int64)
    labels = np.array([r.label for r in sample], object)
    if not sample:
        return nodes.select(F.col("node").alias("a"), F.col("node").alias("b"))
    vectors = matrix(pa.array([bytes(r.unit) for r in sample], pa.binary()), np.float64)

    def search(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                node = part.column("node").to_numpy()
                left, right = narrowed(matrix(part.column("unit"), np.float64), vectors)
                near = left @ right.T >= threshold
                near &= np.array(part.column("label").to_pylist(), object)[:, None] == labels
                near &= node[:, None] != ids
                i, j = near.argmax(0), np.flatnonzero(near.any(0))
                node = node[i[j]]
                a.append(np.minimum(node, ids[j]))
                b.append(np.maximum(node, ids[j]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return nodes.select("node", "label", "unit").mapInArrow(search, "a long, b long").distinct()


def partners(placed: DataFrame, sample: list, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Per row of ``sample`` the nodes of its label that reach the threshold, and those of them in its component."""
    true, same = np.zeros(len(sample), np.int64), np.zeros(len(sample), np.int64)
    if not sample:
        return true, same
    ids, of = (np.array([r[c] for r in sample], np.int64) for c in ("node", "component_id"))
    labels = np.array([r["label"] for r in sample], object)
    vectors = np.array([np.frombuffer(r["unit"]) for r in sample]) if len({len(r["unit"]) for r in sample}) == 1 else None
    groups = {name: np.flatnonzero(labels == name) for name in set(labels)}
    held = {name: (k, vectors[k] if vectors is not None else np.array([np.frombuffer(sample[i]["unit"]) for i in k])) for name, k in groups.items()}
    step = max(64, (1 << 21) // len(sample))

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, inside = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for batch in source:
            label, unit = np.array(batch.column("label").to_pylist(), object), batch.column("unit").to_pylist()
            node, component = batch.column("node").to_numpy(), batch.column("component_id").to_numpy()
            for name, (k, own) in held.items():
                rows = np.flatnonzero(label == name)
                for a in range(0, len(rows), step):
                    part = rows[a:a + step]
                    near = np.array([np.frombuffer(unit[i]) for i in part]) @ own.T >= threshold
                    near &= node[part][:, None] != ids[k]
                    n[k] += near.sum(0)
                    inside[k] += (near & (component[part][:, None] == of[k])).sum(0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, n[some], inside[some])], names=["k", "n", "inside"])

    read = placed.select("node", "label", "unit", "component_id").mapInArrow(count, "k long, n long, inside long")
    for r in read.groupBy("k").agg(F.sum("n").alias("n"), F.sum("inside").alias("inside")).collect():
        true[r["k"]], same[r["k"]] = r["n"], r["inside"]
    return true, same


class Audit:
    """Recall per sampled node: its partners in its component over all its partners.

    That is what ``n_links`` has of them, as links are counted exactly inside components. The
    sample grows until it holds ``ENOUGH`` nodes with few partners or all nodes; ``measured`` tells
    whether it got there within the most allowed.
    """

    def __init__(self, threshold: float):
        self.threshold, self.size, self.partnered, self.total, self.measured = threshold, AUDITED, None, None, False

    def recall(self, placed: DataFrame) -> tuple[float, float]:
        """The mean over nodes with at most ``LIST`` partners, and over those with more; 1 without such nodes."""
        self.total = placed.count() if self.total is None else self.total
        while True:
            share = F.lit(int(min(1.0, self.size / max(1, self.total)) * (1 << 40)))
            drawn = placed.select("node", "label", "unit", "component_id").where(F.pmod(F.xxhash64("node", F.lit(2)), F.lit(1 << 40)) < share).collect()
            sample = [r for r in drawn if self.partnered is None or r["node"] in self.partnered]
            true, same = partners(placed, sample, self.threshold)
            few, many = (true > 0) & (true <= LIST), true > LIST
            if self.partnered is None:
                partial = self.size < self.total
                if few.sum() < ENOUGH and partial and self.size < MOST_AUDITED:
                    self.size = min(4 * self.size, MOST_AUDITED)
                    continue
                self.measured = few.sum() >= ENOUGH or not partial
                self.partnered = {r["node"] for r, n in zip(sample, true) if n}
            return tuple(float((same[x] / true[x]).mean()) if x.any() else 1.0 for x in (few, many))


def left_out(placed: DataFrame, threshold: float) -> DataFrame:
    """A link (a, b) for every two components that hold linked nodes, found by comparing all blocks of a label.

    ``placed`` has ``node, label, component_id, unit``.
    """
    blocks = placed.groupBy("label").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("blocks"))
    columns = ["label", "node", "component_id", "unit"]
    dealt = placed.join(blocks, "label").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    left = dealt.select(*columns, F.col("own").alias("i"), F.explode(F.sequence(F.col("own"), F.col("blocks") - 1)).alias("j"), F.lit(True).alias("asks"))
    right = dealt.select(*columns, F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), F.col("own").alias("j"), F.lit(False).alias("asks"))

    def meet(pair: pd.DataFrame) -> pd.DataFrame:
        asking, asked = pair[pair["asks"]], pair[~pair["asks"]]
        found = {"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)}
        if len(asking) and len(asked):
            a, b = (np.frombuffer(b"".join(x["unit"]), np.float64).reshape(len(x), -1) for x in (asking, asked))
            of_a, of_b = asking["component_id"].to_numpy(), asked["component_id"].to_numpy()
            i, j = np.nonzero((a @ b.T >= threshold) & (of_a[:, None] != of_b))
            _, once = np.unique(np.stack([of_a[i], of_b[j]]), axis=1, return_index=True)
            found = {"a": asking["node"].to_numpy()[i[once]], "b": asked["node"].to_numpy()[j[once]]}
        return pd.DataFrame(found).astype("int64")

    return left.unionByName(right).groupBy("label", "i", "j").applyInPandas(meet, "a long, b long")


def counted(placed: DataFrame, threshold: float) -> DataFrame:
    """``node, linked``: other rows linked with a node, copies included, inside its component.

    ``placed`` has ``node, component_id, unit, copies``. Half the threshold's angle around the
    component's centre holds its core, whose nodes are linked with each other.
    """
    angle = np.arccos(threshold)
    inner = float(np.cos(angle / 2) + 1e-9)
    centre = placed.where("node = component_id").select("component_id", F.col("unit").alias("centre"))

    def place(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            core = np.zeros(0, bool)
            if batch.num_rows:
                core = (matrix(batch.column("unit"), np.float64) * matrix(batch.column("centre"), np.float64)).sum(1) >= inner
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(core, pa.bool_())], names=[*batch.schema.names[:4], "core"])

    members = materialize(
        placed.join(centre, "component_id").select("component_id", "node", "unit", "copies", "centre")
        .mapInArrow(place, "component_id long, node long, unit binary, copies long, core boolean")
    )
    sizes = materialize(
        members.groupBy("component_id").agg(
            F.sum(F.when(F.col("core"), F.col("copies")).otherwise(0)).alias("core_rows"), F.count("*").alias("all"), F.sum(F.when(F.col("core"), 0).otherwise(1)).alias("fringe")
        )
    )
    inside = members.join(sizes, "component_id")
    # A row is linked with the other rows of its core, or at least with the other copies of itself.
    own_counts = inside.select("node", (F.when(F.col("core"), F.col("core_rows")).otherwise(F.col("copies")) - 1).alias("linked"))
    # Fringe nodes meet all others, block by block.
    open_ = inside.where("fringe > 0").withColumn("blocks", F.ceil(F.col("all") / MEMBERS).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    columns = ["component_id", "node", "unit", "copies", "core"]
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    asking = open_.where("NOT core").select(*columns, F.col("own").alias("i"), F.explode(every).alias("j"), F.lit(True).alias("asks"))
    asked = open_.select(*columns, F.explode(every).alias("i"), F.col("own").alias("j"), F.lit(False).alias("asks"))

    def meet(pair: pd.DataFrame) -> pd.DataFrame:
        left, right = pair[pair["asks"]], pair[~pair["asks"]]
        if left.empty or right.empty:
            return pd.DataFrame({"node": [], "linked": []}).astype("int64")
        a, b = (np.frombuffer(b"".join(x["unit"]), np.float64).reshape(len(x), -1) for x in (left, right))
        near = (a @ b.T >= threshold) & (left["node"].to_numpy()[:, None] != right["node"].to_numpy())
        forward = near @ right["copies"].to_numpy()
        # A fringe node also counts for the core nodes it meets; fringe nodes count each other themselves.
        core = right["core"].to_numpy()
        backward = left["copies"].to_numpy() @ near[:, core]
        return pd.DataFrame({"node": np.concatenate([left["node"], right["node"].to_numpy()[core]]), "linked": np.concatenate([forward, backward])}).astype("int64")

    fringe_counts = asking.unionByName(asked).groupBy("component_id", "i", "j").applyInPandas(meet, "node long, linked long")
    return own_counts.unionByName(fringe_counts).groupBy("node").agg(F.sum("linked").alias("linked"))


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, id_column: str = "vec_id", label_column: str = "label", vector_column: str = "embedding"
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors``.

    Only rows of the same label are linked. Rows whose label or vector is null, empty, zero or
    holds nulls or non-finite numbers have no links and are components of their own; so are
    rows without id (their component is null). Vectors of different lengths are not linked.
    Repeated rows that share an id come back each. An empty table gives an empty result. Other
    columns are neither read nor returned.
    """
    rows = vectors.select(
        vectors[id_column].cast("long").alias("vec_id"), vectors[label_column].cast("string").alias("label"), vectors[vector_column].alias("embedding")
    )
    units = materialize(unit_vectors(rows))
    groups = units.groupBy("label", "unit").agg(F.min("vec_id").alias("node"), F.count_distinct("vec_id").alias("copies"))

    def shorten(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            short = [quantized(np.frombuffer(u)).tobytes() for u in batch.column("unit").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(short, pa.binary())], names=[*batch.schema.names, "q"])

    nodes = materialize(groups.select("node", "label", "unit", "copies").mapInArrow(shorten, "node long, label string, unit binary, copies long, q binary"))
    edges = materialize(trimmed(projected(nodes, range(ORDERS), LIST, BLOCK), LIST))
    truth = materialize(audit(nodes, threshold))
    check, keep, order = Audit(threshold), LIST, ORDERS

    def held(grouped: DataFrame) -> DataFrame:
        return nodes.join(grouped, "node", "left").select("node", "label", "unit", F.coalesce("component_id", "node").alias("component_id"))

    for round_ in range(MOST_ROUNDS):
        edges = materialize(trimmed(edges.unionByName(local_join(edges, nodes, keep, round_)), keep))
        links = materialize(close(edges, nodes, threshold))
        few, _ = check.recall(materialize(held(components(links))))
        if few >= RECALL or not check.measured:
            break
        if round_ + 1 >= ROUNDS:
            keep = min(2 * keep, 8 * LIST)
            fresh = projected(nodes, range(order, order + ORDERS), keep, max(BLOCK, 2 * keep))
            edges, order = materialize(trimmed(edges.unionByName(fresh), keep)), order + ORDERS
    links = links.unionByName(truth).distinct()

    # Nodes whose whole list is close may have more links: longer lists in fresh orders.
    full = materialize(
        edges.where(F.col("s") >= threshold - SLACK).groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") >= keep)
        .join(nodes, F.col("u") == F.col("node")).select("node", "label", "q")
    )
    grouped, keep = materialize(components(links)), 2 * keep
    apart, many, enlarged = full.join(grouped, "node").select("component_id").distinct().count(), 0.0, 0
    while True:
        before = None
        while apart and apart != before:
            wider = projected(full, range(order, order + ORDERS), keep, max(BLOCK, 2 * keep))
            links = materialize(links.unionByName(close(wider, nodes, threshold)).distinct())
            grouped, keep, order, enlarged = materialize(components(links)), 2 * keep, order + ORDERS, enlarged + 1
            before, apart = apart, full.join(grouped, "node").select("component_id").distinct().count()
        few, many = check.recall(materialize(held(grouped)))
        if check.measured and min(few, many) >= RECALL:
            break
        if not check.measured or not apart or enlarged >= MOST_ROUNDS:
            rest = materialize(left_out(materialize(held(grouped)), threshold))
            grouped = materialize(components(links.unionByName(rest).distinct()))
            break

    placed = nodes.join(grouped, "node", "left").select("node", "unit", "copies", F.coalesce("component_id", "node").alias("component_id"))
    linked = counted(materialize(placed), threshold)
    member = units.select("vec_id", F.col("label").alias("l"), F.col("unit").alias("x")).distinct().join(nodes, F.expr("l = label AND x = unit"))
    result = materialize(
        member.select("vec_id", "node").join(linked, "node").join(placed.select("node", "component_id"), "node")
        .groupBy("vec_id").agg(F.sum("linked").alias("n_links"), F.min("component_id").alias("component_id"))
    )
    return rows.select("vec_id").join(result, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
