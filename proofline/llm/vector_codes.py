"""Vector code compression: product codes of exact integers, entries searched with fixed pivots.

Every vector is cut into equal parts; each part position has a codebook that a few rounds of
reassignment refine. The search for the nearest entry is LAESA's: the distances of a part to
fixed pivots are computed once and stored beside it; each round computes the distances of the
pivots to the (moved) entries, a table of pivots times entries; by the triangle inequality
|d(part, pivot) - d(pivot, entry)| bounds the distance from below. Entries are taken in the
order of their greatest bound and evaluated exactly in integers until the next bound exceeds the
best distance found, so what is pruned cannot be nearer, nor equally near.

Assignments never move vectors: a task sums its parts per (position, entry) and only those sums
are shuffled. The driver holds the codebooks: parts times entries times the length of a part,
all parameters. Pivots are entries of the first codebooks, each the farthest from those before.

Defined results: rows whose vector is null, empty or holds a null or non-finite component are
left out, and so are rows of another length than ``dims`` (unless given: the commonest length
that the number of parts divides, ties: the greater); a repeated id is coded row by row; a null
id is coded but is no start; fewer rows than ``entries`` make as many entries; equal entries
keep apart, the smaller index is used; null labels are one label; an empty table gives no
rows; other columns are ignored. A component whose integer is beyond 2 ** 26 raises.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import written
from proofline.llm.vectors import floored, matrix, packed, sums_by, unpacked, usable

PARTS, ENTRIES, SCALE, ROUNDS, PIVOTS = 4, 256, 1024, 4, 16
ROWS = 1024   # parts evaluated together
STEP = 32     # entries evaluated between two looks at the bounds
SALTS = 16


def pivots_of(entries: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first rows of a codebook."""
    chosen, near = [0], None
    while len(chosen) < min(n, len(entries)):
        d = ((entries - entries[chosen[-1]]) ** 2).sum(1)
        near = d if near is None else np.minimum(near, d)
        chosen.append(int(near.argmax()))
    return entries[chosen]


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)


def nearest(x: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray,
            pivot_entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, squared distance) of the nearest entry per row, ties to the lower index, and the
    number of exact evaluations. ``to_pivots``: distances rows x pivots; ``pivot_entry``: pivots
    x entries."""
    best = np.full(len(x), np.iinfo(np.int64).max)
    index = np.zeros(len(x), np.int64)
    done, width = 0, x.shape[1]
    # the narrowest integers that hold every squared distance
    span = int(max(np.abs(x).max(initial=0), np.abs(entries).max())) * 2
    whole = np.int32 if width * span * span < 1 << 31 else np.int64
    entries, x = entries.astype(whole), x.astype(whole)
    to_pivots, pivot_entry = to_pivots.astype(np.float32), pivot_entry.astype(np.float32)
    # more than the rounding of a bound: its two distances in single precision, subtracted
    slip = 1e-6 * float(max(to_pivots.max(initial=0), pivot_entry.max())) + 1e-6
    for a in range(0, len(x), ROWS):
        part, own = x[a:a + ROWS], to_pivots[a:a + ROWS]
        bound = np.abs(own[:, :1] - pivot_entry[0])
        for j in range(1, len(pivot_entry)):
            np.maximum(bound, np.abs(own[:, j:j + 1] - pivot_entry[j]), out=bound)
        order = bound.argsort(axis=1)
        live, low, at = np.arange(len(part)), best[a:a + ROWS], index[a:a + ROWS]
        for r in range(0, len(entries), STEP):
            if r:
                reach = np.sqrt(low[live].astype(np.float64))
                live = live[bound[live, order[live, r]] <= reach + slip]
                if not len(live):
                    break
            some = order[live, r:r + STEP]
            diff = entries[some]
            diff -= part[live][:, None, :]
            d = np.einsum("ijk,ijk->ij", diff, diff)
            done += d.size
            least = d.min(1)
            first = np.where(d == least[:, None], some, len(entries)).min(1)
            better = (least < low[live]) | ((least == low[live]) & (first < at[live]))
            low[live[better]], at[live[better]] = least[better], first[better]
    return index, best, done


class Books:
    """Codebooks of all part positions and their distances to the fixed pivots."""

    def __init__(self, entries: list[np.ndarray], pivots: list[np.ndarray]):
        self.entries, self.pivots = entries, pivots
        self.pivot_entry = [np.sqrt(squared(p, e).astype(np.float64)) for p, e in zip(pivots, entries, strict=True)]

    def assign(self, vectors: np.ndarray, to_pivots: np.ndarray):
        """(part position, its parts, indexes, squared distances) of every position."""
        width = vectors.shape[1] // len(self.entries)
        per = [len(p) for p in self.pivots]
        ends = np.cumsum(per)
        for p, e in enumerate(self.entries):
            x = vectors[:, p * width:(p + 1) * width]
            d = np.sqrt(to_pivots[:, ends[p] - per[p]:ends[p]].astype(np.float64))
            index, low, _ = nearest(x, d, e, self.pivot_entry[p])
            yield p, x, index, low


def kept_vectors(df: DataFrame, vector_col: str, parts: int, dims: int | None) -> tuple[DataFrame, int]:
    rows = df.where(usable(vector_col) & (F.size(vector_col) > 0) & (F.size(vector_col) % parts == 0))
    if dims is None:
        common = rows.groupBy(F.size(vector_col).alias("n")).count().orderBy(
            F.desc("count"), F.desc("n")).limit(1).collect()
        dims = common[0][0] if common else parts
    return rows.where(F.size(vector_col) == dims), dims


def with_pivot_distances(vectors: DataFrame, pivots: list[np.ndarray]) -> DataFrame:
    """_id, _label, _q and the squared distances to the pivots of every position, written once."""
    width = pivots[0].shape[1]

    def run(batches):
        for b in batches:
            x = matrix(b.column(2))
            if len(x):
                d = np.concatenate([squared(x[:, p * width:(p + 1) * width], v)
                                    for p, v in enumerate(pivots)], 1)
                yield pa.RecordBatch.from_arrays([*b.columns, packed(d)], names=names)
    names = ["_id", "_label", "_q", "_d"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    return written(vectors.mapInArrow(run, f"{schema}, _d binary"), "pivot-distances")


def refined(table: DataFrame, books: Books) -> Books:
    """The codebooks after one round: componentwise floor of the mean, unused entries stay."""
    width = books.entries[0].shape[1]

    def sums(batches):
        total = [np.zeros(e.shape, np.int64) for e in books.entries]
        n = [np.zeros(len(e), np.int64) for e in books.entries]
        for b in batches:
            if b.num_rows:
                for p, x, index, _ in books.assign(matrix(b.column(0)), unpacked(b.column(1), np.int64)):
                    total[p] += sums_by(index, len(total[p]), x)
                    n[p] += np.bincount(index, minlength=len(n[p]))
        for p in range(len(total)):
            used = np.flatnonzero(n[p])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(used) * width, p), pa.int32()),
                pa.array(np.repeat(used, width), pa.int32()),
                pa.array(np.tile(np.arange(width), len(used)), pa.int32()),
                pa.array(np.repeat(n[p][used], width), pa.int64()),
                pa.array(total[p][used].ravel(), pa.int64())], names=["part", "entry", "pos", "n", "s"])
    mean = (table.select("_q", "_d").mapInArrow(sums, "part int, entry int, pos int, n long, s long")
            .groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
            .select("part", "entry", "pos", F.expr("(s - pmod(s, n)) div n")))  # floor
    new = [e.copy() for e in books.entries]
    for part, entry, pos, value in mean.collect():  # the codebooks: parameters, not rows
        new[part][entry, pos] = value
    return Books(new, books.pivots)


def coded(table: DataFrame, books: Books, id_col: str, label_col: str) -> DataFrame:
    """id, label, code (two hex digits a part), error of every row."""
    digits = np.array([f"{i:02x}" for i in range(256)])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            code, error = None, np.zeros(b.num_rows, np.int64)
            for _, _, index, low in books.assign(matrix(b.column(2)), unpacked(b.column(3), np.int64)):
                text = digits[index]
                code = text if code is None else np.char.add(code, text)
                error += low
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(code.tolist(), pa.string()), pa.array(error)],
                names=[id_col, label_col, "code", "error"])
    kinds = [table.schema[c].dataType.simpleString() for c in ("_id", "_label")]
    return table.mapInArrow(run, f"`{id_col}` {kinds[0]}, `{label_col}` {kinds[1]}, code string, error long")


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all entries' decimal components by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for e in books for v in e.ravel().tolist()).encode()).hexdigest()


def vector_codes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES,
                 scale: int = SCALE, rounds: int = ROUNDS, n_pivots: int = PIVOTS,
                 dims: int | None = None) -> tuple[DataFrame, list[np.ndarray]]:
    """((id, label, code, error) of every kept row, the final codebook of each part position)."""
    if not 0 < entries <= 256:
        raise ValueError("a code digit pair holds 256 entries at most")
    rows, dims = kept_vectors(df, vector_col, parts, dims)
    vectors = rows.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"),
                          floored(vector_col, scale).alias("_q"))
    first = vectors.where("_id is not null").orderBy("_id", "_q").limit(entries).collect()
    if not first:
        none = vectors.where(F.lit(False)).select(
            F.col("_id").alias(id_col), F.col("_label").alias(label_col), F.lit("").alias("code"),
            F.lit(0).cast("long").alias("error"))
        return none, []
    width = dims // parts
    start = np.array([r["_q"] for r in first], np.int64)
    books = [start[:, p * width:(p + 1) * width] for p in range(parts)]
    pivots = [pivots_of(e, n_pivots) for e in books]
    table = with_pivot_distances(vectors, pivots)
    state = Books(books, pivots)
    for _ in range(rounds):
        state = refined(table, state)
    return coded(table, state, id_col, label_col), state.entries


def with_label_error(rows: DataFrame, label_col: str = "label") -> DataFrame:
    """The rows with label_error, the errors of all rows of their label added up. Sums are few
    and labels may be hot, so rows meet them under ``SALTS`` salts."""
    rows = written(rows, "vector-codes")
    sums = rows.groupBy(F.col(label_col).alias("_of")).agg(F.sum("error").alias("label_error"))
    sums = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("code", "error", *rows.columns[:1]), F.lit(SALTS)).cast("int"))
    return salted.join(sums, salted[label_col].eqNullSafe(sums["_of"]) & (salted["_salt"] == sums["_salt"])).select(
        *[salted[c] for c in rows.columns], "label_error")
