"""Centroid clustering: dimension-sharded Lloyd over exact integers.

Vectors are stored once as column blocks of ``block_dims`` components, one Parquet column a
block, so a task of one shard scans one block of the vectors and holds one slice of the
centroids. A round: every shard computes exact partial squared distances of its block to its
centroid slice; a shuffle on the row adds the partial distances of all blocks and takes the
smallest (ties: smaller centroid); the blocks that came along are summed per cluster inside each
task, and the sums meet per (block, cluster), so every shard gets its own new slice. No vector
passes the driver: per round it holds k times the dimensions integers, both parameters.

Hot clusters cost nothing extra: a task emits one partial sum per cluster, whatever its size,
and rows are dealt by a number of their own, not by cluster or id.

Defined results: rows whose vector is null, not of ``dims`` components, or holds a null or
non-finite component are left out; a repeated id is clustered row by row; a null id is
clustered but never a start; if fewer rows than ``k`` are kept there are as many centroids as
rows; equal starts stay apart, the smaller number takes all of their vectors and the other
stays as it is; an empty table gives no rows; other columns are ignored. A component whose
integer is beyond 2 ** 26 raises: its squared distances do not fit 64 bits.
"""
from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofline.llm.common import written
from proofline.llm.vectors import flat, floored, matrix, packed, sums_by, unpacked, usable

K, DIMS, SCALE, ROUNDS, BLOCK_DIMS = 16, 64, 64, 3, 32


def sharded(df: DataFrame, id_col: str, vector_col: str, dims: int, scale: int,
            block_dims: int) -> DataFrame:
    """row, id, c0, c1, ...: the kept vectors as a table of column blocks."""
    kept = df.where((F.size(vector_col) == dims) & usable(vector_col)).select(
        F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"),
        floored(vector_col, scale).alias("_q"))
    cuts = [F.slice("_q", at + 1, block_dims).alias(f"c{i}")
            for i, at in enumerate(range(0, dims, block_dims))]
    return written(kept.select("_row", "_id", *cuts), "column-blocks")


def starts(blocks: DataFrame, k: int, seed: int) -> list[np.ndarray]:
    """Per block the slice of the k rows with the smallest sha256 of ``seed:id``."""
    parts = [c for c in blocks.columns if c.startswith("c")]
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")), 256)
    first = blocks.where("_id is not null").orderBy(order, *parts).limit(k).collect()
    return [np.array([r[c] for r in first], np.int64) for c in parts]


@dataclass(frozen=True)
class Width:
    """The narrowest integers that hold the components and the partial distances."""
    part: type
    distance: type

    @classmethod
    def of(cls, blocks: DataFrame, dims: int) -> Width:
        cols = [c for c in blocks.columns if c.startswith("c")]
        top = blocks.agg(*[F.max(F.array_max(F.transform(c, F.abs))) for c in cols]).first()
        top = max((v for v in top if v is not None), default=0)
        part = next(t for t in (np.int8, np.int16, np.int32) if top < np.iinfo(t).max)
        return cls(part, np.int32 if dims * (2 * top + 1) ** 2 < np.iinfo(np.int32).max else np.int64)


def partial_distances(blocks: DataFrame, slices: list[np.ndarray], width: Width, *,
                      parts: bool) -> DataFrame:
    """One row per row and block: its distances to the centroid slice and, with ``parts`` (to
    update the centroids), the block itself, else the id."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, s = matrix(b.column(2)), slices[b.column(1)[0].as_py()]  # a task reads one shard
            d = (x * x).sum(1)[:, None] - 2 * (x @ s.T) + (s * s).sum(1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), packed(x.astype(width.part)) if parts else b.column(3),
                 packed(d.astype(width.distance))], names=["_row", "block", "own", "d"])
    shards = None
    for j in range(len(slices)):
        one = blocks.select("_row", F.lit(j).alias("block"), f"c{j}", *([] if parts else ["_id"]))
        shards = one if shards is None else shards.unionAll(one)
    own = "binary" if parts else blocks.schema["_id"].dataType.simpleString()
    return shards.mapInArrow(run, f"_row long, block int, own {own}, d binary")


def by_row(partials: DataFrame, n_blocks: int, k: int, width: Width):
    """(rows dealt by ``_row`` and sorted, a function over their batches: the blocks of each row
    one after the other, and its distances added up over the blocks)."""
    def run(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b] if rest is None else [rest, b]).combine_chunks()
            whole = len(t) // n_blocks * n_blocks
            rest = t.slice(whole).combine_chunks().to_batches()[0] if whole < len(t) else None
            if whole:
                b = t.slice(0, whole).combine_chunks().to_batches()[0]
                d = unpacked(b.column(3), width.distance).reshape(-1, n_blocks, k)
                yield b.column(2), d.sum(1, dtype=np.int64)
    return partials.repartition("_row").sortWithinPartitions("_row", "block"), run


def updated(blocks: DataFrame, slices: list[np.ndarray], width: Width) -> list[np.ndarray]:
    """The slices after one round: componentwise floor of the mean, empty clusters as they were."""
    n_blocks, k = len(slices), len(slices[0])
    block_of = np.repeat(np.arange(n_blocks), [s.shape[1] for s in slices])
    pos_of = np.concatenate([np.arange(s.shape[1]) for s in slices])
    dealt, rows = by_row(partial_distances(blocks, slices, width, parts=True), n_blocks, k, width)

    def sums(batches):
        total, n = np.zeros((k, len(block_of)), np.int64), np.zeros(k, np.int64)
        for parts, d in rows(batches):
            nearest = d.argmin(1)
            total += sums_by(nearest, k, flat(parts, width.part).reshape(len(d), -1).astype(np.int64))
            n += np.bincount(nearest, minlength=k)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.tile(block_of, len(used)), pa.int32()),
            pa.array(np.repeat(used, len(block_of)), pa.int32()),
            pa.array(np.tile(pos_of, len(used)), pa.int32()),
            pa.array(np.repeat(n[used], len(block_of)), pa.int64()),
            pa.array(total[used].ravel(), pa.int64())], names=["block", "cluster", "pos", "n", "s"])
    new = [s.copy() for s in slices]
    mean = (dealt.mapInArrow(sums, "block int, cluster int, pos int, n long, s long")
            .groupBy("block", "cluster", "pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
            .select("block", "cluster", "pos", F.expr("(s - pmod(s, n)) div n")))  # floor
    for block, cluster, pos, value in mean.collect():  # k times the dimensions integers
        new[block][cluster, pos] = value
    return new


def assigned(blocks: DataFrame, slices: list[np.ndarray], width: Width, id_col: str) -> DataFrame:
    """id, cluster, distance of every row."""
    n_blocks = len(slices)
    dealt, rows = by_row(partial_distances(blocks, slices, width, parts=False), n_blocks, len(slices[0]), width)

    def nearest(batches):
        for ids, d in rows(batches):
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(np.arange(0, len(ids), n_blocks))),
                 pa.array(d.argmin(1), pa.int32()), pa.array(d.min(1), pa.int64())],
                names=[id_col, "cluster", "distance"])
    ident = blocks.schema["_id"].dataType.simpleString()
    return dealt.mapInArrow(nearest, f"`{id_col}` {ident}, cluster int, distance long")


def centroid_clusters(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                      k: int = K, dims: int = DIMS, scale: int = SCALE, rounds: int = ROUNDS,
                      seed: int = 1, block_dims: int = BLOCK_DIMS) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance) of every kept row, the final centroids k x dims)."""
    blocks = sharded(df, id_col, vector_col, dims, scale, block_dims)
    slices = starts(blocks, k, seed)
    if not len(slices[0]):
        none = blocks.where(F.lit(False)).select(
            F.col("_id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return none, np.zeros((0, dims), np.int64)
    width = Width.of(blocks, dims)
    for _ in range(rounds):
        slices = updated(blocks, slices, width)
    return assigned(blocks, slices, width, id_col), np.concatenate(slices, 1)


def with_inertia(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The rows with cluster_inertia, inertia and the digest of their centroid."""
    rows = written(rows, "clusters")
    digests = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest())
               for i, c in enumerate(centroids)]
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    # one row a cluster from here on: k is a parameter
    sums = sums.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy()))
    shas = rows.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    per = sums.join(F.broadcast(shas), "cluster")
    return rows.join(F.broadcast(per), "cluster").select(
        *[c for c in rows.columns], "cluster_inertia", "inertia", "centroid_sha256")
