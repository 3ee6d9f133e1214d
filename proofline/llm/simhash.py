"""SimHash near-de-duplication with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. Two fingerprints
within two bits of each other have at least one segment without error (pigeonhole), and
the segment after it has at most two errors. A segment, read as a 23-bit word of the perfect
binary Golay code, gets the codewords nearest to itself and to its 23 one-bit neighbours
(one or six of them); words within two bits always share one of these, because they share a
neighbour. So the keys (segment number, exact segment, codeword index of the next segment)
lose no link. They are joined and each candidate is verified by its bit distance.

Fingerprints, not documents, are joined: equal ones are one node. Buckets above
``bucket_limit`` fingerprints take an exact way that makes no pairs: fingerprints within
two bits share a point at one bit or less from both, and all fingerprints around one such
point are within two bits of each other, so each links to the smallest of them.

Defined results: null and empty texts have fingerprint zero, which links like any other;
a text of fewer words than a shingle is one shingle; repeated rows are copies of each other;
a null id is a document of its own whose component is the smallest id reached, null if
there is none; an empty table gives no rows.
"""
from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofline.llm.common import whole_text, written
from proofline.llm.components import components

WORDS = 3
MAX_BITS = 2
BUCKET_LIMIT = 64
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # shift and width of each segment
GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """SimHash of one text's UTF-8 bytes: bit set where over half the shingle hashes have it."""
    found = _WORD.findall(text.translate(_LOWER))
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - words + 1)
    starts, ends = starts[:n].tolist(), ends[min(words, len(found)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)],
                      dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 16):  # bounded memory for texts of any length
        ones += np.unpackbits(hashes[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8),
                              axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words: int = WORDS) -> DataFrame:
    """(id, text_hash, fp): the fingerprint of every whole text as a signed long, and a hash of
    the text, which tells apart rows that repeat an id with other texts."""
    def run(batches):
        for b in batches:
            fps = [fingerprint(t.as_py().encode(), words) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(fps, pa.int64())], names=names)
    text = whole_text(text_col)
    src = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("text_hash"),
                      text.alias("_text"))
    names = ["_id", "text_hash", "fp"]
    schema = T.StructType([*src.schema.fields[:2], T.StructField("fp", T.LongType())])
    return src.mapInArrow(run, schema)


# ---- Golay code ---------------------------------------------------------------------

@lru_cache(1)
def _tables() -> tuple[list[np.ndarray], np.ndarray]:
    """Remainder of each byte of a 23-bit word, and the error pattern of each remainder."""
    def rest(w: int) -> int:
        for i in range(22, 10, -1):
            if w >> i & 1:
                w ^= GENERATOR << (i - 11)
        return w
    bit = [rest(1 << i) for i in range(24)]
    parts = []
    for byte in range(3):
        t = np.zeros(256, dtype=np.int64)
        for v in range(256):
            for j in range(8):
                if v >> j & 1 and byte * 8 + j < 23:
                    t[v] ^= bit[byte * 8 + j]
        parts.append(t)
    error = np.zeros(2048, dtype=np.int64)
    for i in range(23):
        error[bit[i]] = 1 << i
        for j in range(i):
            error[bit[i] ^ bit[j]] = 1 << i | 1 << j
            for k in range(j):
                error[bit[i] ^ bit[j] ^ bit[k]] = 1 << i | 1 << j | 1 << k
    return parts, error


def golay_index(word: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword nearest to each 23-bit word (within three bits, always)."""
    (t0, t1, t2), error = _tables()
    rest = t0[word & 255] ^ t1[word >> 8 & 255] ^ t2[word >> 16]
    return (word ^ error[rest]) >> 11


def golay_keys(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of the distinct codewords near each word or one of its neighbours."""
    around = np.array([0] + [1 << i for i in range(23)], dtype=np.int64)
    near = np.sort(golay_index(word[:, None] ^ around[None, :]), axis=1)
    new = np.ones(near.shape, dtype=bool)
    new[:, 1:] = near[:, 1:] != near[:, :-1]
    rows, cols = np.nonzero(new)
    return rows, near[rows, cols]


def bucket_keys(fps: DataFrame) -> DataFrame:
    """(key, fp) for every distinct fingerprint."""
    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            u = fp.view(np.uint64)
            for i, (shift, width) in enumerate(SEGMENTS):
                exact = (u >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64)
                s2, w2 = SEGMENTS[(i + 1) % 3]
                other = (u >> np.uint64(s2) & np.uint64((1 << w2) - 1)).astype(np.int64)
                rows, index = golay_keys(other)
                key = (i << 34) | (exact[rows] << 12) | index
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.int64()), pa.array(fp[rows], pa.int64())],
                    names=["key", "fp"])
    return fps.select("fp").mapInArrow(run, "key long, fp long")


def _crowded(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links among distinct fingerprints without pairs: group around shared points."""
    flips = F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    if max_bits == 1:  # a point is a fingerprint with one named bit cleared
        point = F.transform(flips, lambda m: F.struct(
            F.col("fp").bitwiseAND(F.bitwise_not(m)).alias("v"), m.alias("m")))
    else:
        point = F.transform(F.concat(F.array(F.lit(0).cast("long")), flips), lambda m: F.struct(
            F.col("fp").bitwiseXOR(m).alias("v"), F.lit(0).cast("long").alias("m")))
    at = fps.select("fp", F.explode(point).alias("p")).select("fp", "p.v", "p.m")
    low = at.groupBy("v", "m").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("c")).where("c > 1")
    return at.join(low, ["v", "m"]).where("fp <> b").select(F.col("fp").alias("a"), "b")


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS,
                      bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(a, b) links that join exactly the fingerprints within ``max_bits`` bits, and no others
    directly: every component is right, links inside crowded buckets are stars."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the three segments and the Golay keys cover 0 to 2 differing bits")
    keys = written(bucket_keys(fps), "simhash-keys")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = keys.join(sizes, "key")
    small = sized.where(F.col("n") <= bucket_limit).select("key", "fp")
    a, b = small.withColumnRenamed("fp", "a"), small.withColumnRenamed("fp", "b")
    pairs = (a.join(b, "key")
             .where((F.col("a") < F.col("b"))
                    & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
             .select("a", "b"))
    if max_bits == 0:
        return pairs
    crowd = sized.where(F.col("n") > bucket_limit).select("fp").distinct()
    return pairs.union(_crowded(crowd, max_bits))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   words: int = WORDS, max_bits: int = MAX_BITS,
                   bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row per document: id, text_hash, fp (long), fingerprint (16 hex digits), component_id (the
    smallest id reachable through links, itself included)."""
    fp = written(fingerprints(docs, id_col, text_col, words), "simhash-fp")
    classes = written(fp.groupBy("fp").agg(F.min("_id").alias("low")), "simhash-classes")
    comp = components(fingerprint_links(classes, max_bits, bucket_limit))
    linked = classes.join(comp, classes.fp == comp.node, "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("c"))
    lows = linked.groupBy("c").agg(F.min("low").alias("component_id"))
    of = linked.select("fp", "c").join(lows, "c").select("fp", "component_id")
    return fp.join(of, "fp").select(
        F.col("_id").alias(id_col), "text_hash", "fp",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents that stay: of each group the one with the smallest id, with its columns
    as they came. Rows that repeat both id and text stay or go together."""
    groups = simhash_groups(docs, id_col, text_col, words, max_bits)
    gone = (groups.where(~F.col(id_col).eqNullSafe(F.col("component_id")))
            .select(F.col(id_col).alias("_gone"), "text_hash").distinct())
    own = docs[id_col].eqNullSafe(gone["_gone"]) & (
        F.xxhash64(whole_text(docs[text_col])) == gone["text_hash"])
    return docs.join(gone, own, "left_anti")
