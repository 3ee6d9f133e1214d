"""SentencePiece encoding and decoding with a distinct-chunk table.

A marked word is a run of whitespace markers and what follows it up to the next marker.
Where no piece of the model has a marker after another character, no merge reaches across
the start of a marked word, so words are segmented apart, each distinct one once per table
(see ``chunks``), and ids are joined back by position. A model that does not allow this
(pieces across markers, a normaliser that is not the identity, no dummy prefix) is used on
whole texts instead: same ids, more work.

Defined results: null counts as empty; an empty text has no ids and decodes to the empty
text; repeated rows and ids are encoded each; an empty table gives no rows; other columns
are ignored by ``encode`` and ``decode``.
"""
from __future__ import annotations

import re
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofline.llm.chunks import BLOCK_BYTES, ChunkTable, blocks, by_position, merged, only, packed
from proofline.llm.common import whole_text

MARK = "▁"
DECODE_BITS = 19  # ids decoded together: about 2 ** 17
_WORDS = re.compile(f"{MARK}+[^{MARK}]*")


@lru_cache(4)
def processor(model: str):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=model)


@lru_cache(4)
def splittable(model: str) -> bool:
    from sentencepiece import sentencepiece_model_pb2 as pb
    m = pb.ModelProto()
    with open(model, "rb") as f:
        m.ParseFromString(f.read())
    n = m.normalizer_spec
    plain = (not n.precompiled_charsmap and n.add_dummy_prefix and n.escape_whitespaces
             and not n.remove_extra_whitespaces
             and not m.trainer_spec.treat_whitespace_as_suffix)
    return plain and not any(re.search(f"[^{MARK}]{MARK}", p.piece) or p.type == p.USER_DEFINED
                             for p in m.pieces)


@lru_cache(4)
def word_table(model: str) -> ChunkTable:
    """Words without their first marker -> ids; the empty word is the marker alone."""
    sp = processor(model)
    alone = [sp.piece_to_id(MARK)]

    def encode(words: list[str]) -> list[bytes]:
        return [packed(ids if w else alone)
                for w, ids in zip(words, sp.encode(words, num_threads=1), strict=True)]
    return ChunkTable(encode)


def words_of(text: str) -> list[str]:
    """Marked words of any text, without their first marker, later markers as spaces."""
    if not text:
        return []
    marked = MARK + text.replace(" ", MARK)
    return [w[1:].replace(MARK, " ") for w in _WORDS.findall(marked)]


def encode_array(texts: pa.Array, model: str) -> pa.ListArray:
    if not splittable(model):
        return pa.array(processor(model).encode(texts.to_pylist(), num_threads=1),
                        pa.list_(pa.int32()))
    odd = pc.match_substring_regex(texts, f"  |{MARK}|^ | $|^$")
    regular = ~odd.to_numpy(zero_copy_only=False)
    fast = pc.split_pattern(only(regular, texts), " ")
    slow = [words_of(t) for t in only(~regular, texts).to_pylist()]
    return by_position(merged(regular, fast, slow), word_table(model))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text."""
    def run(batches):
        for batch in batches:
            for b in blocks(batch, 1):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), encode_array(b.column(1), model)], names=names)
        word_table(model).forget()
    src = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    names = [id_col, "ids"]
    schema = T.StructType([T.StructField(id_col, src.schema["_id"].dataType),
                           T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return src.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids",
           text_col: str = "text") -> DataFrame:
    """(id, ids, text) with the text that the model decodes each row of ids to; null ids
    decode to the empty text."""
    def run(batches):
        sp = processor(model)
        for batch in batches:
            size = batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.diff(np.cumsum(size) >> DECODE_BITS)) + 1
            for a, z in zip([0, *cut], [*cut, batch.num_rows], strict=True):
                b = batch.slice(a, z - a)
                ids = [x or [] for x in b.column(1).to_pylist()]
                texts = sp.decode(ids, num_threads=1) if ids else []
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(texts, pa.string())], names=names)
    src = encoded.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids"))
    names = [id_col, ids_col, text_col]
    schema = T.StructType([T.StructField(id_col, src.schema["_id"].dataType),
                           T.StructField(ids_col, T.ArrayType(T.IntegerType())),
                           T.StructField(text_col, T.StringType())])
    return src.mapInArrow(run, schema)


def round_trip(docs: DataFrame, model: str, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, ids, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of
    the text decoded from them), in one pass through one Python worker a task: for tables where
    the decoded text itself is not wanted."""
    def digests(ids: pa.ListArray):
        sp = processor(model)
        size = ids.value_lengths().to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(np.diff(np.cumsum(size) >> DECODE_BITS)) + 1
        for a, z in zip([0, *cut], [*cut, len(ids)], strict=True):
            own = ids.slice(a, z - a).to_pylist()
            for row, text in zip(own, sp.decode(own, num_threads=1) if own else [], strict=True):
                yield (sha256(",".join(map(str, row)).encode()).hexdigest(), sha256(text.encode()).hexdigest())

    def run(batches):
        try:
            for batch in batches:
                for b in blocks(batch, len(keys), BLOCK_BYTES // 4):
                    ids = encode_array(b.column(len(keys)), model)
                    one, two = zip(*digests(ids), strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [*b.columns[:len(keys)], ids, ids.value_lengths().cast(pa.int64()),
                         pa.array(one, pa.string()), pa.array(two, pa.string())], names=names)
        finally:
            word_table(model).forget()
    src = docs.select(*keys, whole_text(text_col).alias("_text"))
    names = [*keys, "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    schema = T.StructType([*src.schema.fields[:len(keys)], T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                           T.StructField("decoded_sha256", T.StringType())])
    return src.mapInArrow(run, schema)


def ids_text(ids: str = "ids"):
    """Decimal ids joined by commas."""
    return F.array_join(F.col(ids).cast("array<string>"), ",")
