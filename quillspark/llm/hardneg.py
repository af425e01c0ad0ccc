"""Hard negatives by cover trees over norm-augmented candidates.

Candidates are cut into blocks, by label and direction. A block's vectors get one more
component that brings all to one length, so that an inner product is a cosine on a sphere, and
are covered by a tree: a node's centre lies within its covering radius of all below, and its
children are centres farther apart than the radius divided by ``BASE``. With the angle between
query and centre and the angle of the radius, every node bounds the inner products below it
from both sides.

An anchor's positives are its best rows of its label; each positive opens a window of scores in
which the best rows of other labels are its negatives. Both are the same descent: nodes in the
order of their upper bounds, skipped where they lie outside all windows or below the k-th score
found so far (carried from block to block), and leaves verified exactly.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.llm.common import Leaders, carrying, meeting, products
from quillspark.session import materialize

SCALE = 256
#: Rows of a block of candidates, windows of a block of anchors.
CANDIDATES, WINDOWS = 2048, 1024
#: A child's covering radius is at most its parent's divided by this; nodes of at most LEAF rows are leaves.
BASE, LEAF = 1.3, 16
#: Bounds are widened by this share of the largest possible score.
MARGIN = 1e-7
#: Directions that order a label's rows, so that blocks hold neighbours.
DIRECTIONS = 8

BLOCK = "part long, size int, lowest long, highest long, ids binary, labels binary, numbers binary, starts binary, ends binary, radii binary, children binary"
ANY = np.iinfo(np.int64)


def cover(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The cover tree of ``rows``: their order, and per node its slice (the centre comes first), covering radius (angle) and first child.

    The children of a node are numbered in a row, up to the first child of the next inner node.
    """
    points = rows.astype(np.float64)
    squares = (points**2).sum(1)
    length = np.sqrt(squares.max(initial=0)) or 1.0
    points = np.column_stack([points, np.sqrt(np.maximum(length**2 - squares, 0))]) / length
    order = np.arange(len(points))

    def chords(some: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(np.maximum(((points[some] - points[centre]) ** 2).sum(1), 0))

    starts, ends, radii, children = [0], [len(points)], [chords(order, 0).max(initial=0)], []
    node = 0
    while node < len(starts):
        begin, end, radius = starts[node], ends[node], radii[node]
        children.append(len(starts))
        node += 1
        if end - begin <= LEAF or radius == 0:
            continue
        own = order[begin:end]
        nearest, owner, centres = chords(own, own[0]), np.zeros(len(own), np.int64), [0]
        while nearest.max() > radius / BASE:
            centre = int(nearest.argmax())
            distance = chords(own, own[centre])
            closer = distance < nearest
            closer[centre] = True
            owner[closer], nearest = len(centres), np.minimum(distance, nearest)
            centres.append(centre)
        sorted_ = np.lexsort((np.arange(len(own)) != np.array(centres)[owner], owner))
        order[begin:end] = own[sorted_]
        bounds = np.searchsorted(owner[sorted_], np.arange(len(centres) + 1))
        starts += (begin + bounds[:-1]).tolist()
        ends += (begin + bounds[1:]).tolist()
        radii += np.maximum.reduceat(nearest[sorted_], bounds[:-1]).tolist()
    children.append(len(starts))
    angles = 2 * np.arcsin(np.minimum(1, np.array(radii) / 2)) + 1e-9
    return order, np.array(starts), np.array(ends), angles, np.array(children)


class Tree:
    """A block of candidates as it was stored."""

    def __init__(self, block: dict):
        self.ids, self.labels, self.starts, self.ends, self.children = (np.frombuffer(block[c], np.int64) for c in ("ids", "labels", "starts", "ends", "children"))
        self.rows = np.frombuffer(block["numbers"], np.int64).reshape(len(self.ids), block["size"])
        self.angles = np.frombuffer(block["radii"])
        self.lowest, self.highest = block["lowest"], block["highest"]
        self.length = np.sqrt((self.rows.astype(np.float64) ** 2).sum(1).max(initial=0))


class Asked:
    """A block of windows: for each the anchor's row, label and id, the scores it admits, and whether labels must agree."""

    def __init__(self, rows: np.ndarray, anchor: np.ndarray, labels: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
        self.rows, self.anchor, self.labels, self.ids, self.low, self.high, self.same = rows, anchor, labels, ids, low, high, same
        self.reals = rows.astype(np.float64)
        self.lengths = np.sqrt((self.reals**2).sum(1))
        self.leaders = Leaders(len(anchor), k)
        self.visited = 0

    def scores(self, tree: Tree, alive: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Windows x rows; windows of one anchor share their products."""
        anchors, back = np.unique(self.anchor[alive], return_inverse=True)
        return products(self.rows[anchors], tree.rows[rows])[back]

    def bounds(self, tree: Tree, alive: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and largest score below each node for each window."""
        most = (self.lengths[self.anchor[alive]] * tree.length)[:, None]
        cosine = np.divide(self.reals[self.anchor[alive]] @ tree.rows[tree.starts[nodes]].T.astype(np.float64), most, out=np.zeros((len(alive), len(nodes))), where=most > 0)
        angle = np.arccos(np.clip(cosine, -1, 1))
        radius = tree.angles[nodes]
        return most * (np.cos(np.minimum(angle + radius, np.pi)) - MARGIN), most * (np.cos(np.maximum(angle - radius, 0)) + MARGIN)

    def able(self, alive: np.ndarray, least: np.ndarray, largest: np.ndarray) -> np.ndarray:
        floor = np.maximum(self.low, self.leaders.floor)[alive].astype(np.float64)
        return (largest >= floor.reshape(floor.shape + (1,) * (largest.ndim - 1))) & (least <= self.high[alive].astype(np.float64).reshape(floor.shape + (1,) * (least.ndim - 1)))

    def verify(self, tree: Tree, alive: np.ndarray, leaves: np.ndarray, open_: np.ndarray) -> None:
        """Exact scores of the rows of ``leaves`` for the windows they are open to."""
        sizes = (tree.ends - tree.starts)[leaves]
        rows = np.repeat(tree.starts[leaves] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        self.visited += len(rows) * len(alive)
        scores = self.scores(tree, alive, rows)
        agree = self.labels[alive][:, None] == tree.labels[rows]
        fits = np.repeat(open_, sizes, axis=1) & (agree == self.same) & (self.ids[alive][:, None] != tree.ids[rows])
        fits &= (scores >= self.low[alive][:, None]) & (scores <= self.high[alive][:, None])
        self.leaders.offer_table(alive, scores, fits, tree.ids[rows])

    def descend(self, tree: Tree) -> None:
        alive = np.arange(len(self.anchor))
        if self.same:
            alive = alive[(self.labels >= tree.lowest) & (self.labels <= tree.highest)]
        elif tree.lowest == tree.highest:
            alive = alive[self.labels != tree.lowest]
        waiting: list[tuple[float, int, np.ndarray, np.ndarray, np.ndarray]] = []

        def queue(alive: np.ndarray, nodes: np.ndarray) -> None:
            least, largest = self.bounds(tree, alive, nodes)
            open_ = self.able(alive, least, largest)
            leaf = (tree.children[nodes + 1] == tree.children[nodes]) & open_.any(0)
            if leaf.any():
                some = open_[:, leaf].any(1)
                self.verify(tree, alive[some], nodes[leaf], open_[np.ix_(some, leaf)])
            for at in np.flatnonzero(open_.any(0) & ~leaf):
                on = open_[:, at]
                heapq.heappush(waiting, (-largest[on, at].max(), int(nodes[at]), alive[on], least[on, at], largest[on, at]))

        if len(alive) and len(tree.ids):
            queue(alive, np.array([0]))
        while waiting:
            _, node, alive, least, largest = heapq.heappop(waiting)
            alive = alive[self.able(alive, least, largest)]
            if len(alive):
                queue(alive, np.arange(tree.children[node], tree.children[node + 1]))


def numbered(rows: DataFrame) -> DataFrame:
    """``vec_id, label, cell, numbers`` (64-bit, as bytes) of the rows that take part."""

    def scale(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            vectors = [np.array([np.nan] if v is None or None in v else v, np.float64) for v in batch.column("embedding").to_pylist()]
            good = [bool(np.isfinite(v).all()) for v in vectors]
            cells, numbers = [], []
            for v, ok in zip(vectors, good):
                sides = np.random.default_rng(len(v)).normal(size=(DIRECTIONS, len(v))) @ v > 0 if ok else []
                cells.append(sum(1 << i for i, side in enumerate(sides) if side))
                numbers.append(np.floor(SCALE * v).astype(np.int64).tobytes() if ok else None)
            full = pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(cells, pa.int64()), pa.array(numbers, pa.binary())], names=["vec_id", "label", "cell", "numbers"]
            )
            yield full.filter(pa.array(good, pa.bool_()))

    kept = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").select("vec_id", "label", "embedding")
    once = kept.mapInArrow(scale, "vec_id long, label long, cell long, numbers binary")
    return once.groupBy("vec_id").agg(F.min(F.struct("label", "numbers", "cell")).alias("row")).select("vec_id", "row.label", "row.cell", "row.numbers")


def planted(rows: DataFrame) -> DataFrame:
    """``rows`` as blocks of at most ``CANDIDATES`` vectors of one length, each with its cover tree."""

    def plant(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[int, int, bytes]]] = {}

        def block(width: int) -> pa.RecordBatch:
            held = waiting.pop(width)
            numbers = np.frombuffer(b"".join(n for _, _, n in held), np.int64).reshape(len(held), width // 8)
            order, *tree = cover(numbers)
            ids, labels = (np.array([r[c] for r in held], np.int64)[order] for c in (0, 1))
            starts, ends, angles, children = tree
            columns = [labels, numbers[order], starts, ends, angles, children]
            row = [int(ids[0]), width // 8, int(labels.min()), int(labels.max()), ids.tobytes(), *(c.tobytes() for c in columns)]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 7]
            names = [c.split()[0] for c in BLOCK.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=names)

        for batch in source:
            for i, label, numbers in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "numbers"))):
                held = waiting.setdefault(len(numbers), [])
                held.append((i, label, numbers))
                if len(held) == CANDIDATES:
                    yield block(len(numbers))
        for width in list(waiting):
            yield block(width)

    parts = max(1, -(-rows.count() // CANDIDATES))
    return materialize(rows.repartitionByRange(parts, "label", "cell", "vec_id").sortWithinPartitions("label", "cell", "vec_id").mapInArrow(plant, BLOCK))


def met(trees: DataFrame, windows: DataFrame, same: bool, k: int) -> DataFrame:
    """``anchor_id, positive_id, positive_score, vec_id, score``: each task's k best rows of every window.

    ``windows``: anchor_id, label, numbers, and ``open``, an array of (positive_id,
    positive_score, low, high).
    """
    spark = trees.sparkSession
    salts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), trees.count()))
    out = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"

    def pack(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors in blocks of about ``WINDOWS`` windows and one vector length."""
        waiting: dict[int, list[dict]] = {}
        for batch in source:
            for row in batch.to_pylist():
                held = waiting.setdefault(len(row["numbers"]), [])
                held.append(row)
                if sum(len(r["open"]) for r in held) >= WINDOWS:
                    yield pa.RecordBatch.from_pylist([{"q_size": len(row["numbers"]) // 8, "asked": waiting.pop(len(row["numbers"]))}], schema)
        for width, held in waiting.items():
            yield pa.RecordBatch.from_pylist([{"q_size": width // 8, "asked": held}], schema)

    window = pa.struct([(c, pa.int64()) for c in ("positive_id", "positive_score", "low", "high")])
    anchor = pa.struct([("anchor_id", pa.int64()), ("label", pa.int64()), ("numbers", pa.binary()), ("open", pa.list_(window))])
    schema = pa.schema([("q_size", pa.int32()), ("asked", pa.list_(anchor))])
    packed = "q_size int, asked array<struct<anchor_id: long, label: long, numbers: binary, open: array<struct<positive_id: long, positive_score: long, low: long, high: long>>>>"
    blocks = materialize(windows.select("anchor_id", "label", "numbers", "open").mapInArrow(pack, packed).withColumn("asked_number", F.monotonically_increasing_id()))
    spread = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    held = trees.withColumn("salt", F.pmod(F.xxhash64("part"), F.lit(salts)))

    def start(row: dict) -> tuple[Asked, np.ndarray]:
        asked = row["asked"]
        opened = [(i, w) for i, a in enumerate(asked) for w in a["open"]]
        owner = np.array([i for i, _ in opened], np.int64)
        rows = np.frombuffer(b"".join(a["numbers"] for a in asked), np.int64).reshape(len(asked), row["q_size"])
        ids, labels = (np.array([a[c] for a in asked], np.int64) for c in ("anchor_id", "label"))
        positive, score, low, high = (np.array([w[c] for _, w in opened], np.int64) for c in ("positive_id", "positive_score", "low", "high"))
        return Asked(rows, owner, labels[owner], ids[owner], low, high, same, k), np.stack([ids[owner], positive, score])

    def visit(state: tuple[Asked, np.ndarray], row: dict, tree: Tree) -> None:
        state[0].descend(tree)

    def result(state: tuple[Asked, np.ndarray]) -> pa.RecordBatch:
        found = state[0].leaders
        return pa.RecordBatch.from_arrays([*(pa.array(c[found.owner]) for c in state[1]), pa.array(found.id), pa.array(found.score)], names=[c.split()[0] for c in out.split(", ")])

    def answer(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from carrying(source, "asked_number", "part", start, Tree, visit, result)

    return meeting(held, spread).drop("salt").mapInArrow(answer, out)


def best(found: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` is a condition on ``vec_id``. For each anchor and each of its best rows of the
    same label (``positives``), the best rows of other labels with ``low`` to ``high`` percent of
    the positive's score. Equal scores go to the smaller vec_id. Rows without id, label or
    vector and vectors that hold nulls or non-finite numbers take no part; an empty vector
    scores 0; only vectors of equal length meet. Rows that share a vec_id are one row, the first
    by label and numbers. Scores must fit a 64-bit integer. An anchor without positives, and a
    positive without negatives in its window, give no rows; nor does an empty table. Other
    columns are neither read nor returned.
    """
    rows = materialize(numbered(vectors.select(
        vectors[id_column].cast("long").alias("vec_id"), vectors[label_column].cast("long").alias("label"), vectors[vector_column].alias("embedding")
    )))
    trees = planted(rows)
    asked = rows.where(anchors).select(F.col("vec_id").alias("anchor_id"), "label", "numbers")
    entire = F.array(F.struct(F.lit(0).cast("long").alias("positive_id"), F.lit(0).cast("long").alias("positive_score"),
                              F.lit(ANY.min).alias("low"), F.lit(ANY.max).alias("high")))
    close = best(met(trees, asked.withColumn("open", entire), True, positives), positives, "anchor_id")
    # Least and largest score of a window: percentages rounded up and down, without products that overflow.
    rest = "pmod(score, 100)"
    share = lambda percent: F.expr(f"((score - {rest}) div 100) * ({percent}) + ({rest} * ({percent}) - pmod({rest} * ({percent}), 100)) div 100")
    window = F.struct(F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), (-share(-low)).alias("low"), share(high).alias("high"))
    opened = close.groupBy("anchor_id").agg(F.collect_list(window).alias("open"))  # at most ``positives`` each
    far = met(trees, asked.join(opened, "anchor_id"), False, negatives)
    return best(far, negatives, "anchor_id", "positive_id").select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


#: The contract in SQL.
ORACLE = """
    WITH numbers AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
               CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM numbers a JOIN numbers c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
    ), positives AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
            SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM scored WHERE same
        ) WHERE place <= 5
    ), negatives AS (
        SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
               CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
        FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
         AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
    )
    SELECT * FROM negatives WHERE rank <= 10
"""
