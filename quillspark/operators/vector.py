"""Embedding jobs, exact filtered nearest neighbours, and vector index audits."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from quillspark.functions import contract as C
from quillspark.operators.manifest import compare_manifests
from quillspark.operators.ordering import top_per_group, with_row

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Queries and chunks of a block at most.
QUERY_BLOCK, POINT_BLOCK = 512, 4096
#: Rows of a cluster on average, parts in which a block's clusters are visited, blocks of queries a task keeps.
CLUSTER_ROWS, WAVES, SEARCHES = 32, 4, 16
HITS = "query_id bigint, chunk_key string, vector_score double"


def embed(
    rows: DataFrame, key: str, text: str, embedder: Callable[[list[str]], np.ndarray], dimension: int,
    instruction: str = "", batch: int = 32, carried: Sequence[str] = (),
) -> DataFrame:
    """Vectors of a text column from a pluggable model; a bad vector becomes an error row.

    Queries pass an ``instruction`` prefix, documents none. Columns ``carried`` along spare a join
    that would move the texts.
    """
    kept = [key, *carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = rows.column(text)
            good, errors = [], []
            for start in range(0, rows.num_rows, batch):
                vectors = embedder([instruction + t for t in texts.slice(start, batch).to_pylist()])
                for v in vectors:
                    v = np.asarray(v, dtype=np.float32)
                    problem = None
                    if v.shape != (dimension,):
                        problem = f"expected {dimension} dimensions, got {v.shape[0] if v.ndim else 0}"
                    elif not np.isfinite(v).all():
                        problem = "vector has a non-finite component"
                    good.append(None if problem else v)
                    errors.append(problem)
            made = [pa.array(good, pa.list_(pa.float32())), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in kept], *made], names=[*kept, "embedding", "error"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.select(*dict.fromkeys([*kept, text])).mapInArrow(run, f"{kinds}, embedding array<float>, error string")


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` as blocks: one row per at most ``size`` rows of a task, every column an array."""
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(kept).combine_chunks()
            ends = pa.array([0, table.num_rows], pa.int32())
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, table.column(c).combine_chunks()) for c in columns], names=columns)

        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                if sum(b.num_rows for b in kept) + part.num_rows > size:
                    yield block()
                kept.append(part)
        if kept:
            yield block()

    return rows.mapInArrow(run, ", ".join(f"{f.name} array<{f.dataType.simpleString()}>" for f in rows.schema))


def _clusters(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a block in the order of their cluster, the clusters' ends, centres and radii (no row is farther from its centre)."""
    pivots = unit[:: max(1, CLUSTER_ROWS)]
    owner = (unit @ pivots.T).argmax(1)
    order = np.argsort(owner, kind="stable")
    starts = np.flatnonzero(np.diff(owner[order], prepend=-1))
    ends = np.append(starts[1:], len(order))
    centres = np.add.reduceat(unit[order], starts, axis=0) / (ends - starts)[:, None]
    distance = np.linalg.norm(unit[order] - np.repeat(centres, ends - starts, axis=0), axis=1)
    return order, ends, centres, np.maximum.reduceat(distance, starts) + 1e-9


def _packed(points: DataFrame, fields: list[str]) -> DataFrame:
    """``points`` in blocks: the filter columns as arrays, unit vectors and their clusters as flat buffers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            rows = pa.Table.from_batches(kept).combine_chunks()
            kept.clear()
            vectors = rows.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            unit = _unit(vectors.reshape(rows.num_rows, -1))
            order, ends, centres, radii = _clusters(unit)
            rows = rows.take(pa.array(order))
            whole = pa.array([0, rows.num_rows], pa.int32())
            columns = [pa.ListArray.from_arrays(whole, rows.column(c).combine_chunks()) for c in fields]
            flat = [pa.array([x.tobytes()], pa.binary()) for x in (unit[order], ends.astype(np.int64), centres, radii)]
            return pa.RecordBatch.from_arrays([*columns, *flat], names=[*fields, "unit", "ends", "centres", "radii"])

        for batch in batches:
            for start in range(0, batch.num_rows, POINT_BLOCK):
                part = batch.slice(start, POINT_BLOCK)
                if sum(b.num_rows for b in kept) + part.num_rows > POINT_BLOCK:
                    yield block()
                kept.append(part)
        if kept:
            yield block()

    arrays = ", ".join(f"{f} array<{points.schema[f].dataType.simpleString()}>" for f in fields)
    return points.select(*fields, "embedding").mapInArrow(run, f"{arrays}, unit binary, ends binary, centres binary, radii binary")


def _searched(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Hits of every pair of blocks, and per task a row without key: its score is the share of clusters that were skipped."""
    columns = ["query_id", "embedding", "project_id", "access_scope", "document_types", "hints", "preferred_position"]
    fields = ["chunk_key", "project_id", "project_open", "visibility", "document_type", "note_id", "media_position"]
    salts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = _packed(chunks.select(*fields, "embedding"), fields).withColumn("salt", F.pmod(F.xxhash64(F.element_at("chunk_key", 1)), F.lit(salts)))
    asked = _blocks(queries.select(*columns).repartition("query_id"), QUERY_BLOCK).select(
        F.struct(*columns).alias("asked"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("salt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches: dict[int, _Search] = {}  # a block of queries keeps its k-th scores from one block of points to the next
        seen = skipped = 0
        for batch in batches:
            for i in range(batch.num_rows):
                held = batch.column("asked")[i]
                first = held["query_id"].values[0].as_py()
                if first not in searches:
                    if len(searches) >= SEARCHES:
                        old = searches.pop(next(iter(searches)))
                        seen, skipped = seen + old.seen, skipped + old.skipped
                        yield old.hits()
                    searches[first] = _Search(pd.DataFrame(held.as_py()), k)
                searches[first].visit(_Points(batch, i))
        for search in searches.values():
            seen, skipped = seen + search.seen, skipped + search.skipped
            yield search.hits()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([None], pa.string()), pa.array([skipped / seen])], names=["query_id", "chunk_key", "vector_score"])

    return points.join(asked, "salt").drop("salt").mapInArrow(run, HITS)


def vector_candidates(queries: DataFrame, chunks: DataFrame, k: int = C.CANDIDATE_LIMIT) -> DataFrame:
    """Exact cosine top ``k`` per query among the chunks its filters allow.

    ``queries``: query_id bigint, embedding, project_id, access_scope, document_types, hints,
    preferred_position. ``chunks``: chunk_key, embedding and the filter columns.

    Both sides are packed into blocks (a few megabytes), which meet through an equi-join on a
    salt: every query block goes to every salt, a chunk block to one. Inside a block points lie
    in clusters; by the triangle inequality no point of a cluster scores more than its centre
    plus its radius, so clusters that cannot reach a query's k-th score are skipped and the
    answer stays exact. One plan serves any number of queries, and none of them passes through
    the driver.
    """
    found = _searched(queries, chunks, k).where("chunk_key IS NOT NULL")
    return top_per_group(found, ["query_id"], [F.desc("vector_score"), "chunk_key"], k, "vector_rank")


def skipped_share(queries: DataFrame, chunks: DataFrame, k: int = C.CANDIDATE_LIMIT) -> DataFrame:
    """``clusters, skipped``: pairs of query and cluster a search meets, and the share it skips. One row."""
    told = _searched(queries, chunks, k).where("chunk_key IS NULL")
    return told.agg(F.sum("query_id").alias("clusters"), (F.sum(F.col("query_id") * F.col("vector_score")) / F.sum("query_id")).alias("skipped"))


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0, 1.0, norms)


class _Points:
    """One block of points, its columns read from the batch's buffers."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        self.columns = {c: batch.column(c)[row].values for c in ("chunk_key", "project_id", "project_open", "visibility", "document_type", "note_id", "media_position")}
        flat = {c: batch.column(c)[row].as_buffer() for c in ("unit", "ends", "centres", "radii")}
        self.ends = np.frombuffer(flat["ends"], np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]])
        self.unit = np.frombuffer(flat["unit"]).reshape(self.ends[-1], -1)
        self.centres, self.radii = np.frombuffer(flat["centres"]).reshape(len(self.ends), -1), np.frombuffer(flat["radii"])
        self.keys = self.columns["chunk_key"].to_numpy(zero_copy_only=False)

    def allowed(self, project: int, scope: str, kinds: tuple, hints: tuple, position: int | None) -> np.ndarray:
        c = self.columns
        if scope not in ("member", "public"):
            return np.zeros(len(self.keys), bool)
        mask = pc.equal(c["project_id"], project)
        if scope == "public":
            mask = pc.and_(mask, pc.and_(c["project_open"], pc.equal(c["visibility"], "public")))
        if kinds:
            mask = pc.and_(mask, pc.is_in(c["document_type"], pa.array(kinds, pa.string())))
        if hints:
            mask = pc.and_(mask, pc.is_in(c["note_id"], pa.array(hints, c["note_id"].type)))
        if position is not None:
            mask = pc.and_(mask, pc.equal(c["media_position"], position))
        return pc.fill_null(mask, False).to_numpy(zero_copy_only=False)


class _Search:
    """A block of queries, grouped by their filters, and the best points each has met."""

    def __init__(self, block: pd.DataFrame, k: int):
        self.k, self.ids = k, block["query_id"].to_numpy()
        self.matrix = _unit(np.stack([np.asarray(v, dtype=np.float64) for v in block["embedding"]]))
        self.groups: dict[tuple, list[int]] = {}
        for i, q in enumerate(block.itertuples(index=False)):
            position = None if pd.isna(q.preferred_position) else int(q.preferred_position)
            kinds = tuple(q.document_types) if q.document_types is not None else ()
            hints = tuple(q.hints) if q.hints is not None else ()
            self.groups.setdefault((int(q.project_id), q.access_scope, kinds, hints, position), []).append(i)
        self.floor = np.full(len(self.ids), -np.inf)
        self.owner, self.score, self.key = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)
        self.seen = self.skipped = 0

    def visit(self, points: _Points) -> None:
        for filters, members in self.groups.items():
            mask = points.allowed(*filters)
            members = np.array(members)
            if not mask.any():
                continue
            bounds = self.matrix[members] @ points.centres.T + points.radii
            self.seen += bounds.size
            # The most promising quarter first: what it finds lets the rest be skipped.
            order = np.argsort(-bounds.max(0))
            for part in np.array_split(order, min(WAVES, len(order))):
                near = bounds[:, part] >= self.floor[members][:, None] - 1e-9
                self.skipped += near.size - int(near.sum())
                part, asking = part[near.any(0)], members[near.any(1)]
                rows = [np.arange(points.starts[c], points.ends[c]) for c in part]
                rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
                rows = rows[mask[rows]]
                if len(rows):
                    self.offer(asking, self.matrix[asking] @ points.unit[rows].T, points.keys[rows])

    def offer(self, asking: np.ndarray, scores: np.ndarray, keys: np.ndarray) -> None:
        good = scores >= self.floor[asking][:, None]
        if scores.shape[1] > self.k:
            good &= scores >= np.partition(scores, -self.k, axis=1)[:, -self.k][:, None]
        i, j = np.nonzero(good)
        owner, score, key = np.concatenate([self.owner, asking[i]]), np.concatenate([self.score, scores[i, j]]), np.concatenate([self.key, keys[j]])
        order = np.lexsort((key, -score, owner))
        owner, score, key = owner[order], score[order], key[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        self.floor[owner[place == self.k - 1]] = score[place == self.k - 1]
        kept = place < self.k
        self.owner, self.score, self.key = owner[kept], score[kept], key[kept]

    def hits(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.owner], pa.int64()), pa.array(self.key, pa.string()), pa.array(self.score)], names=["query_id", "chunk_key", "vector_score"])


def audit_index(expected: DataFrame, actual: DataFrame, stored_points: int | None = None) -> DataFrame:
    """Counts of missing, orphan and mismatched points and whether the index is exact."""
    status = compare_manifests(expected, actual, "chunk_key", "content_hash")
    counts = status.agg(
        F.count_if(F.col("status") != "orphan").alias("expected_points"),
        F.count_if(F.col("status") != "missing").alias("actual_points"),
        F.count_if(F.col("status") == "missing").alias("missing_points"),
        F.count_if(F.col("status") == "orphan").alias("orphan_points"),
        F.count_if(F.col("status") == "mismatched").alias("mismatched_points"),
    )
    exact = (F.col("missing_points") == 0) & (F.col("orphan_points") == 0) & (F.col("mismatched_points") == 0)
    if stored_points is not None:
        exact = exact & (F.col("expected_points") == stored_points)
    return counts.withColumn("exact", exact)


def remove_orphans(points: DataFrame, expected: DataFrame) -> DataFrame:
    """Points kept by a repair: those the manifest still names."""
    return points.join(expected.select("chunk_key"), "chunk_key", "left_semi")


def resume_position(manifest: DataFrame, actual: DataFrame, checkpoint_points: int) -> DataFrame:
    """Where a build resumes: the earliest position before the checkpoint that is not intact.

    ``manifest``: position (0-based), chunk_key, content_hash.
    """
    points = actual.select("chunk_key", F.col("content_hash").alias("_actual"))
    covered = manifest.where(F.col("position") < checkpoint_points).join(points, "chunk_key", "left")
    broken = F.col("_actual").isNull() | (F.col("_actual") != F.col("content_hash"))
    return covered.agg(
        F.coalesce(F.min(F.when(broken, F.col("position"))), F.lit(checkpoint_points)).cast("bigint").alias("resume_points"),
        F.count_if(broken).alias("broken_points"),
    )


def rows_to_rebuild(manifest: DataFrame, resume: DataFrame) -> DataFrame:
    return with_row(manifest, resume.select("resume_points")).where("position >= resume_points").drop("resume_points")


def index_state(builds: DataFrame, now) -> DataFrame:
    """Builds, largest checkpoint lag and oldest update per status."""
    lag = F.greatest(F.col("chunk_count") - F.col("checkpoint_points"), F.lit(0))
    return builds.groupBy("status").agg(
        F.count("*").alias("build_count"), F.max(lag).alias("checkpoint_lag"),
        F.max(F.unix_timestamp(now) - F.unix_timestamp("updated_at")).alias("oldest_update_age"),
    )
