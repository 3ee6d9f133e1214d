"""Token-id files: independent zstandard frames, a trailing seek table, per-frame checksums.

File format, one file per range of document ids:

* data frames: the ids of consecutive documents, little-endian unsigned, two bytes each where
  the vocabulary fits, else four; each is a zstandard frame of its own (with its content
  checksum) of about ``FRAME_BYTES`` before compression; a long document spans frames;
* one skippable frame (magic 0x184D2A50) with the document index: a zstandard-compressed
  Arrow stream of (doc_id, n_tokens) in file order, the id width in its metadata;
* the seek table, last, in the seekable zstandard format: a skippable frame (magic
  0x184D2A5E) of (compressed size, decompressed size, checksum) per data frame, checksum the
  low 32 bits of XXH64 of the decompressed bytes, then frame count, descriptor byte 0x80 and
  magic 0x8F92EAB1.

``write`` sorts documents by id across files; a manifest, written when all tasks are done,
names the files in order with their totals, so a file that a lost or repeated task left
behind is never read. ``read`` reads each file in its own task; with ids given, it
decompresses only the frames those documents lie in.

Defined results: null text counts as empty (only the end id, if one is appended); null ids
sort first; rows that repeat an id are each kept, ordered by a hash of their text; an empty
table gives a manifest without files and no rows; other columns are ignored.
"""
from __future__ import annotations

import io
import json
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from proofline.llm.chunks import BLOCK_BYTES, ChunkTable, blocks, by_position, merged, only, packed
from proofline.llm.common import scratch_path, whole_text

FORMAT = "token_frames"
FRAME_BYTES = 1 << 20
INDEX_MAGIC, SEEK_MAGIC, SEEK_END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
MANIFEST = "_manifest.json"


# ---- tokenising ------------------------------------------------------------------------

# White space as the byte-level pre-tokeniser's \s has it. Its pattern always cuts before a space
# that follows something else: texts are cut there.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CUTS = re.compile(f"(?<=[^{WHITE}])(?= )")
_ODD = f"[{WHITE}] |\x00|^$"
JOINED = 2000  # chunks encoded in one call
TABLE_CHUNKS = 600_000


@lru_cache(2)
def tokenizer(path: str):
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


@lru_cache(2)
def splittable(path: str) -> bool:
    """True for a byte-level pre-tokeniser with its usual pattern and no normaliser, prefix
    space or added token that could reach over a cut."""
    with open(path) as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    return (not spec.get("normalizer") and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["normalized"]
                        for t in spec["added_tokens"])
            and (spec.get("model") or {}).get("type") == "BPE")


@lru_cache(2)
def chunk_table(path: str) -> ChunkTable:
    tok = tokenizer(path)
    marks = [t.content for t in tok.get_added_tokens_decoder().values()]
    size = np.zeros(tok.get_vocab_size(), np.int64)  # bytes of each token: one per character
    for text, i in tok.get_vocab().items():
        size[i] = len(text)
    ends_white = re.compile(f"[{WHITE}]$")

    def apart(chunks: list[str]) -> list[bytes]:
        return [packed(e.ids) for e in tok.encode_batch_fast(chunks, add_special_tokens=False)]

    def together(chunks: list[str]) -> list[bytes]:
        """Chunks that begin with a space and end with something else, encoded as one text and
        parted by the bytes that the tokens stand for."""
        ids = np.array(tok.encode("".join(chunks), add_special_tokens=False).ids, np.int32)
        ends = np.cumsum(np.fromiter((len(c.encode()) for c in chunks), np.int64, len(chunks)))
        at = np.cumsum(size[ids])
        cut = np.searchsorted(at, ends) + 1
        if not len(ids) or cut[-1] != len(ids) or (at[cut - 1] != ends).any():
            return apart(chunks)
        raw, z = ids.tobytes(), (cut * 4).tolist()
        return [raw[i:j] for i, j in zip([0, *z[:-1]], z, strict=True)]

    def encode(chunks: list[str]) -> list[bytes]:
        marked = any(m in c for m in marks for c in chunks)
        joinable = [c[:1] == " " and not ends_white.search(c) and not (marked and any(m in c for m in marks))
                    for c in chunks]
        one = [c for c, ok in zip(chunks, joinable, strict=True) if ok]
        found = iter([x for i in range(0, len(one), JOINED) for x in together(one[i:i + JOINED])])
        rest = iter(apart([c for c, ok in zip(chunks, joinable, strict=True) if not ok]))
        return [next(found) if ok else next(rest) for ok in joinable]
    return ChunkTable(encode, TABLE_CHUNKS)


def encode_array(texts: pa.Array, path: str) -> pa.ListArray:
    """Ids of whole texts, as the tokenizers library gives them without special tokens."""
    if not splittable(path):
        encoded = tokenizer(path).encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
        return pa.array([e.ids for e in encoded], pa.list_(pa.int32()))
    regular = ~pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
    fast = pc.split_pattern(pc.replace_substring(only(regular, texts), " ", "\x00 "), "\x00")
    slow = [_CUTS.split(t) if t else [] for t in only(~regular, texts).to_pylist()]
    return by_position(merged(regular, fast, slow), chunk_table(path))


def with_end(ids: pa.ListArray, end_id: int | None) -> pa.ListArray:
    """Each row with ``end_id`` behind its ids."""
    if end_id is None:
        return ids
    at = ids.offsets.to_numpy()
    flat = np.insert(ids.values.to_numpy()[at[0]:at[-1]], at[1:] - at[0], end_id)
    return pa.ListArray.from_arrays(pa.array(at - at[0] + np.arange(len(at)), pa.int32()), pa.array(flat, pa.int32()))


def encode(docs: DataFrame, path: str, end_id: int | None = None, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): ids of every whole text, ``end_id`` appended to each."""
    src = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))

    def run(batches):
        for batch in batches:
            for b in blocks(batch, 1):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), with_end(encode_array(b.column(1), path), end_id)], names=[id_col, "ids"])
        chunk_table(path).forget()
    return src.mapInArrow(run, T.StructType([T.StructField(id_col, src.schema["_id"].dataType),
                                             T.StructField("ids", T.ArrayType(T.IntegerType()))]))


# ---- one file --------------------------------------------------------------------------

class FrameWriter:
    """Writes one file to a stream; memory holds a frame and the document index."""

    def __init__(self, out, width: int, frame_bytes: int = FRAME_BYTES):
        self.out, self.width, self.frame_bytes = out, width, frame_bytes
        self.pack = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.buffer, self.table, self.docs = bytearray(), [], []
        self.n_docs = self.n_tokens = 0

    def add(self, doc_ids: pa.Array, ids: pa.ListArray) -> None:
        counts = ids.value_lengths().cast(pa.int64())
        self.docs.append(pa.record_batch([doc_ids, counts], names=["doc_id", "n_tokens"]))
        at = ids.offsets.to_numpy()
        tokens = ids.values.to_numpy()[at[0]:at[-1]]
        self.n_docs += len(ids)
        self.n_tokens += len(tokens)
        if self.width == 2 and len(tokens) and tokens.max() > 0xFFFF:
            raise ValueError("an id does not fit two bytes; write with width=4")
        self.buffer += tokens.astype(f"<u{self.width}").tobytes()
        while len(self.buffer) >= self.frame_bytes:
            self.flush(self.frame_bytes)

    def flush(self, n: int) -> None:
        raw = bytes(self.buffer[:n])
        del self.buffer[:n]
        packed = self.pack.compress(raw)
        self.out.write(packed)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.buffer:
            self.flush(len(self.buffer))
        sink = io.BytesIO()
        schema = self.docs[0].schema.with_metadata({"width": str(self.width)})
        with pa.ipc.new_stream(sink, schema) as w:
            for b in self.docs:
                w.write_batch(pa.RecordBatch.from_arrays(b.columns, schema=schema))
        index = self.pack.compress(sink.getvalue())
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        entries = b"".join(struct.pack("<III", *x) for x in self.table)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(entries) + 9) + entries
                       + struct.pack("<IBI", len(self.table), 0x80, SEEK_END))


class FrameReader:
    """Reads one file: the seek table first, then the frames that are asked for."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        count, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_END:
            raise ValueError("no seek table at the end of the file")
        raw = self._at(size - 9 - 12 * count, 12 * count)
        table = np.frombuffer(raw, "<u4").reshape(-1, 3).astype(np.int64)
        self.packed, self.sums = table[:, 0], table[:, 2]
        self.starts = np.concatenate(([0], np.cumsum(table[:, 0])))
        self.offsets = np.concatenate(([0], np.cumsum(table[:, 1])))
        at = int(self.starts[-1])
        magic, length = struct.unpack("<II", self._at(at, 8))
        if magic != INDEX_MAGIC:
            raise ValueError("no document index after the data frames")
        index = zstandard.ZstdDecompressor().decompress(self._at(at + 8, length))
        self.docs = pa.ipc.open_stream(index).read_all().combine_chunks()
        self.width = int(self.docs.schema.metadata[b"width"])
        counts = self.docs["n_tokens"].to_numpy()
        self.first = np.concatenate(([0], np.cumsum(counts)))
        self.frames_read = 0
        self._last = (-1, b"")

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(int(offset))
        return self.file.read(int(n))

    def frame(self, i: int) -> bytes:
        if self._last[0] != i:
            raw = zstandard.ZstdDecompressor().decompress(self._at(self.starts[i], self.packed[i]))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[i]:
                raise ValueError(f"frame {i}: its checksum does not match")
            self.frames_read += 1
            self._last = (i, raw)
        return self._last[1]

    def tokens(self, doc: int) -> bytes:
        """Ids of the file's ``doc``-th document, little-endian unsigned 32-bit."""
        a, z = int(self.first[doc]) * self.width, int(self.first[doc + 1]) * self.width
        if a == z:
            return b""
        lo = int(np.searchsorted(self.offsets, a, "right")) - 1
        hi = int(np.searchsorted(self.offsets, z, "left"))
        raw = b"".join(self.frame(i)[max(a - int(self.offsets[i]), 0):z - int(self.offsets[i])]
                       for i in range(lo, hi))
        return raw if self.width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()


# ---- the Spark source and sink -----------------------------------------------------------

def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


@dataclass
class _Done(WriterCommitMessage):
    part: int
    name: str | None
    n_docs: int = 0
    n_tokens: int = 0


@dataclass
class _File(InputPartition):
    name: str
    start: int


class _Writer(DataSourceArrowWriter):
    """Encodes and writes the (doc_id, text) rows of one task, in their order."""

    def __init__(self, options):
        self.path, self.width, self.tokenizer = options["path"], int(options["width"]), options["tokenizer"]
        self.end_id = int(options["end_id"]) if "end_id" in options else None

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Done:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        store, path = _store(self.path)
        name, out, w = f"part-{part:06d}-{uuid.uuid4().hex}.ids.zst", None, None
        for batch in iterator:
            for b in blocks(batch, 1, 3 * BLOCK_BYTES):
                if w is None:
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                    w = FrameWriter(out, self.width)
                w.add(b.column(0), with_end(encode_array(b.column(1), self.tokenizer), self.end_id))
        chunk_table(self.tokenizer).forget()
        if w is None:
            return _Done(part, None)
        w.close()
        out.close()
        return _Done(part, name, w.n_docs, w.n_tokens)

    def commit(self, messages) -> None:
        store, path = _store(self.path)
        store.create_dir(path, recursive=True)
        files, start = [], 0
        for m in sorted((m for m in messages if m and m.name), key=lambda m: m.part):
            files.append({"name": m.name, "docs": m.n_docs, "tokens": m.n_tokens, "start": start})
            start += m.n_tokens
        with store.open_output_stream(f"{path}/{MANIFEST}") as f:
            f.write(json.dumps({"files": files, "tokens": start}).encode())

    def abort(self, messages) -> None:
        """Files without a manifest are not read; nothing to undo."""


class _Reader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.schema = options["path"], schema
        self.wanted = set(json.loads(options["doc_ids"])) if "doc_ids" in options else None

    def partitions(self) -> list[InputPartition]:
        store, path = _store(self.path)
        with store.open_input_stream(f"{path}/{MANIFEST}") as f:
            files = json.loads(f.read())["files"]
        return [_File(x["name"], x["start"]) for x in files] or [_File("", 0)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        store, path = _store(self.path)
        with store.open_input_file(f"{path}/{partition.name}") as f:
            r = FrameReader(f)
            ids = r.docs["doc_id"].combine_chunks()
            rows = np.arange(len(ids))
            if self.wanted is not None:
                rows = rows[[x in self.wanted for x in ids.to_pylist()]]
            while len(rows):
                size = np.cumsum(r.first[rows + 1] - r.first[rows])
                n = max(1, int(np.searchsorted(size, 1 << 21, "right")))  # about 8 MB a batch
                now, rows = rows[:n], rows[n:]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(now)), pa.array(partition.start + r.first[now], pa.int64()),
                     pa.array(r.first[now + 1] - r.first[now], pa.int64()),
                     pa.array([r.tokens(i) for i in now], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"])


class TokenFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        kind = self.options.get("id_type", "bigint")
        return f"doc_id {kind}, start bigint, n_tokens bigint, ids binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), schema)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = None,
          width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` and write token files below ``path`` in ascending order of ids."""
    docs.sparkSession.dataSource.register(TokenFrames)
    key = F.xxhash64(whole_text(text_col))
    ordered = (docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"),
                           key.alias("h"))
               .repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h"))
    w = ordered.write.format(FORMAT).mode("append").option("path", path).option("width", width)
    w = w.option("tokenizer", tokenizer_path)
    (w if end_id is None else w.option("end_id", end_id)).save()


def read(spark: SparkSession, path: str, doc_ids: list | None = None,
         id_type: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) from token files, all or the given documents."""
    spark.dataSource.register(TokenFrames)
    r = spark.read.format(FORMAT).option("path", path).option("id_type", id_type)
    if doc_ids is not None:
        r = r.option("doc_ids", json.dumps(doc_ids))
    return r.load()


def written_and_read(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    path = scratch_path(docs.sparkSession, "token-files")
    write(docs, path, tokenizer_path, end_id)
    return read(docs.sparkSession, path)
