"""Embedding near-de-duplication with a pivot-permutation index.

Reference points (pivots) are fitted on a bounded sample: well-separated vectors among the
``PIVOT_SAMPLE`` with the smallest hash, filled up with fixed random directions. Every vector
is described by its ``NEAREST`` nearest pivots in order and entered into the inverted lists of
the pivot pairs among them, so two vectors meet in a list exactly when their permutations
share two pivots or more. Long lists are cut into blocks that meet block against block, each
pair of blocks in a task of its own; there the cosines are verified in double precision. A pair
is counted in the list of its first two shared pivots only. What leaves a task is linear in its
block: each vector's number of links and a spanning forest of them, never the pairs.

Identical vectors are one node from the start, however many there are.

Defined results: null vectors, zero vectors and vectors with a null, NaN or infinite component
link with nothing (no links, component their own id); vectors of different lengths are compared
as if the shorter ended in zeros; rows that repeat an id are one node for components, each row
with its own links; a null id links with nothing and its component is null; an empty table
gives no rows; columns other than id and vector are ignored.
"""
from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofline.llm.common import written
from proofline.llm.components import components

THRESHOLD = 0.9
PIVOTS = 256
NEAREST = 8
PIVOT_SAMPLE = 4096
APART = 0.5           # largest cosine of two pivots taken from the sample
BLOCK = 1024          # vectors of one block of a list
SALTS = 16


def usable(vec: str) -> Column:
    v = F.col(vec)
    inf = F.lit(float("inf"))
    return F.coalesce(
        v.isNotNull() & F.exists(v, lambda x: x != 0) & F.forall(
            v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)), F.lit(False))


def unit(vectors: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of length one in double precision, padded with zeros to ``dim``."""
    n, at = len(vectors), vectors.offsets.to_numpy().astype(np.int64)
    flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
    if n and (np.diff(at) == dim).all():
        x = flat[at[0]:at[-1]].reshape(n, dim).copy()
    else:
        x = np.zeros((n, dim))
        for i in range(n):
            x[i, :at[i + 1] - at[i]] = flat[at[i]:at[i + 1]]
    x /= np.abs(x).max(axis=1, keepdims=True, initial=1e-300)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_pivots(classes: DataFrame, dim: int, pivots: int = PIVOTS) -> np.ndarray:
    sample = (classes.orderBy(F.xxhash64("_vec")).limit(PIVOT_SAMPLE).select("_vec")
              .toArrow()["_vec"].combine_chunks())  # bounded by PIVOT_SAMPLE
    chosen = np.random.default_rng(11).standard_normal((pivots, dim))
    chosen /= np.linalg.norm(chosen, axis=1, keepdims=True)
    n = 0
    for v in unit(sample.cast(pa.list_(pa.float64())), dim) if len(sample) else ():
        if n < pivots and (not n or (chosen[:n] @ v).max() < APART):
            chosen[n], n = v, n + 1
    return chosen


def permutation(x: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """Numbers of the nearest pivots of each row, nearest first."""
    cos = x @ pivots.T
    top = np.argpartition(-cos, nearest - 1, axis=1)[:, :nearest]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(cos, top, 1), axis=1), 1)


def _lists(classes: DataFrame, pivots: np.ndarray, nearest: int) -> DataFrame:
    """A row per vector and list: list, node, n, perm (nearest pivots, nearest first), vec."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)
    pairs = list(itertools.combinations(range(nearest), 2))
    first, second = [p[0] for p in pairs], [p[1] for p in pairs]

    def run(batches):
        p = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                vec = b.column(2).cast(pa.list_(pa.float64()))
                perm = permutation(unit(vec, p.shape[1]), p, nearest).astype(np.int64)
                low = np.sort(perm, axis=1)
                key = (low[:, first] * len(p) + low[:, second]).ravel()
                row = pa.array(np.repeat(np.arange(b.num_rows), len(pairs)))
                perms = pa.array(perm.astype(np.int32).tolist(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), b.column(0).take(row), b.column(1).take(row),
                     perms.take(row), b.column(2).take(row)],
                    names=["list", "node", "n", "perm", "vec"])
    src = classes.select("_node", "_n", "_vec")
    return src.mapInArrow(run, T.StructType([
        T.StructField("list", T.LongType()), T.StructField("node", T.LongType()),
        T.StructField("n", T.LongType()), T.StructField("perm", T.ArrayType(T.IntegerType())),
        T.StructField("vec", src.schema["_vec"].dataType)]))


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Complete groups of equal keys from sorted batches."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy() for c in keys])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1), batch.num_rows]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(k[:, a])
            if held and key != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, z - a))
            held_key = key
    if held:
        yield pa.Table.from_batches(held)


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The links among (a, b) that join two parts not joined by those before."""
    root: dict[int, int] = {}

    def find(x):
        while (r := root.get(x, x)) != x:
            root[x] = root.get(r, r)
            x = r
        return x
    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = find(x), find(y)
        if rx != ry:
            root[rx] = ry
            kept.append((x, y))
    return kept


def first_two_shared(p: np.ndarray, q: np.ndarray, base: int) -> np.ndarray:
    """List number of the two smallest pivots that rows of p and q share (-1: fewer than two)."""
    p = np.sort(p, axis=1)
    hit = (p[:, :, None] == q[:, None, :]).any(axis=2)
    order = np.cumsum(hit, axis=1) * hit
    one = np.where(order == 1, p, 0).sum(axis=1)
    two = np.where(order == 2, p, 0).sum(axis=1)
    return np.where(hit.sum(axis=1) >= 2, one * base + two, -1)


def _verified(entries: DataFrame, dim: int, threshold: float, base: int) -> DataFrame:
    """(a, b, n) from the lists: b null: node a has n links here; else a link of the forest."""
    def run(batches):
        for group in _runs(batches, ["list", "i", "j"]):
            if group.num_rows < 2:
                continue
            g = group.combine_chunks()
            x = unit(g["vec"].combine_chunks().cast(pa.list_(pa.float64())), dim)
            node, n = g["node"].to_numpy(), g["n"].to_numpy()
            perm = np.stack(g["perm"].to_numpy(zero_copy_only=False))
            key, same = g["list"][0].as_py(), g["i"][0].as_py() == g["j"][0].as_py()
            left = np.arange(len(node)) if same else np.flatnonzero(g["side"].to_numpy() == 0)
            right = left if same else np.flatnonzero(g["side"].to_numpy() == 1)
            links, edges = np.zeros(len(node), np.int64), []
            for at in range(0, len(left), 128):
                part = left[at:at + 128]
                r, c = np.nonzero(x[part] @ x[right].T >= threshold)
                a, b = part[r], right[c]
                if same:
                    a, b = a[a < b], b[a < b]
                if not len(a):
                    continue
                here = first_two_shared(perm[a], perm[b], base) == key
                a, b = a[here], b[here]
                np.add.at(links, a, n[b])
                np.add.at(links, b, n[a])
                edges += forest(a, b)
            edges = forest(*np.array(edges).T) if edges else []
            hit = np.flatnonzero(links)
            if len(hit):
                one, two = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate((node[hit], node[one]))),
                     pa.array([None] * len(hit) + node[two].tolist(), pa.int64()),
                     pa.array(np.concatenate((links[hit], np.zeros(len(one), np.int64))))],
                    names=["a", "b", "n"])
    return entries.mapInArrow(run, "a long, b long, n long")


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                     threshold: float = THRESHOLD, pivots: int = PIVOTS, nearest: int = NEAREST,
                     block: int = BLOCK) -> DataFrame:
    """One row per vector: id, n_links, component_id (smallest id reachable), kept."""
    if not 0 < threshold <= 1 or not 2 <= nearest < pivots:
        raise ValueError("needs 0 < threshold <= 1 and 2 <= nearest < pivots")
    rows = vectors.select(
        F.col(id_col).alias("_id"),
        F.when(usable(vec_col) & F.col(id_col).isNotNull(), F.col(vec_col)).alias("_vec"))
    classes = written(rows.where("_vec is not null").groupBy("_vec").agg(
        F.min("_id").cast("long").alias("_node"), F.count(F.lit(1)).alias("_n")), "vector-classes")
    dim = classes.agg(F.max(F.size("_vec"))).first()[0]
    if dim is None:
        return rows.select(F.col("_id").alias(id_col), F.lit(0).cast("long").alias("n_links"),
                           F.col("_id").alias("component_id"),
                           F.col("_id").isNotNull().alias("kept"))
    lists = written(_lists(classes, fit_pivots(classes, dim, pivots), nearest), "pivot-lists")
    sizes = (lists.groupBy("list").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
             .select("list", F.ceil(F.col("size") / block).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("node", "vec"), F.col("blocks")).cast("int")
    entries = (lists.join(sizes, "list").withColumn("own", own)
               .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
               .select("list", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                       (F.col("own") > F.col("other")).cast("int").alias("side"),
                       "node", "n", "perm", "vec")
               .repartition("list", "i", "j").sortWithinPartitions("list", "i", "j"))
    found = written(_verified(entries, dim, threshold, pivots), "vector-links")
    degree = found.where("b is null").groupBy("a").agg(F.sum("n").alias("_links"))
    comp = components(found.where("b is not null").select("a", "b"))
    result = (classes.join(degree, classes["_node"] == degree["a"], "left")
              .join(comp, classes["_node"] == comp["node"], "left")
              .select(F.col("_vec").alias("_v"), "_node", "_n",
                      (F.coalesce("_links", F.lit(0)) + F.col("_n") - 1).alias("_links"),
                      F.coalesce("component", "_node").alias("_component")))
    # a vector that a third of the rows hold meets its result under several salts
    spread = result.withColumn("_s", F.explode(
        F.when(F.col("_n") > 1, F.sequence(F.lit(0), F.lit(SALTS - 1)))
        .otherwise(F.array(F.pmod(F.xxhash64("_node"), F.lit(SALTS)).cast("int")))))
    salted = rows.withColumn("_s", F.pmod(F.xxhash64(F.col("_id").cast("long")), F.lit(SALTS)).cast("int"))
    out = salted.join(spread, (salted["_vec"] == spread["_v"]) & (salted["_s"] == spread["_s"]), "left")
    component = F.coalesce(F.col("_component"), F.col("_id"))
    return out.select(
        F.col("_id").alias(id_col), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"))
