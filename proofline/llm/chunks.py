"""Distinct-chunk tables: tokenise each distinct piece of text once, join ids back by position.

A tokeniser whose pieces never reach across a cut gives the same ids whether a text is
encoded whole or cut by cut. A task cuts a block of texts (in Arrow, without a Python object
per word), reduces the chunks to a dictionary, encodes only entries it has not met, and takes
the ids back through the dictionary codes. The table forgets everything at ``limit`` chunks and at
the end of its task, so memory is bounded; results do not depend on that.
"""
from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 4 << 20
TABLE_CHUNKS = 300_000


def packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class ChunkTable:
    """Chunk -> ids (int32, as bytes)."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = TABLE_CHUNKS):
        self.encode, self.limit, self.ids = encode, limit, {}

    def forget(self) -> None:
        """Called at the end of a task: idle Python workers keep no table."""
        self.ids.clear()
        pa.default_memory_pool().release_unused()

    def get(self, chunks: list[str]) -> list[bytes]:
        if len(self.ids) > self.limit:
            self.ids.clear()
        ids = self.ids
        new = [c for c in chunks if c not in ids]
        if new:
            ids.update(zip(new, self.encode(new), strict=True))
        return [ids[c] for c in chunks]


def by_position(chunks: pa.ListArray, table: ChunkTable) -> pa.ListArray:
    """Ids of each row of chunk lists, in order."""
    coded = chunks.flatten().dictionary_encode()
    parts = table.get(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
    lens = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
    flat = np.frombuffer(b"".join(parts), np.int32)
    first = np.cumsum(lens) - lens
    codes = coded.indices.to_numpy()
    counts = lens[codes]
    ends = np.concatenate(([0], np.cumsum(counts)))
    ids = flat[np.repeat(first[codes] - ends[:-1], counts) + np.arange(ends[-1])]
    at = chunks.offsets.to_numpy()
    return pa.ListArray.from_arrays(pa.array(ends[at - at[0]], pa.int32()), pa.array(ids, pa.int32()))


def merged(regular: np.ndarray, fast: pa.ListArray, slow: list[list[str]]) -> pa.ListArray:
    """Chunk lists of all rows from those cut in Arrow and those cut one by one."""
    if not slow:
        return fast
    both = pa.concat_arrays([fast, pa.array(slow, pa.list_(pa.string()))])
    order = np.empty(len(regular), np.int64)
    order[np.nonzero(regular)[0]] = np.arange(len(fast))
    order[np.nonzero(~regular)[0]] = len(fast) + np.arange(len(slow))
    return both.take(pa.array(order))


def blocks(batch: pa.RecordBatch, text: int, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``limit`` bytes of text, one row at least."""
    size = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        done = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, done + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def only(mask: np.ndarray, texts: pa.Array) -> pa.Array:
    return texts.filter(pa.array(mask))
