"""SentencePiece codec and token files against the libraries, and exact round trips."""
import hashlib
import json
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from proofline.llm import sentencepiece_codec as sp  # noqa: E402
from proofline.llm import token_files  # noqa: E402

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "  ", "a  b", " a", "a ", "▁", "a▁b", "▁▁ x", "a \n b", "\n", "\t x  ",
       "é\x00z w", "  lead", "日本 語", "x" * 50_000, "😀 a  😀", "<s> </s> <unk>",
       "don't we'll x's 's it's,'s", "x²3 ²", "a<|endoftext|> b <|endoftext|>c", "a　b\xa0 c",
       "a\x1cb \x1c c", "l'eau d'é_x'll abc'd 12a3.b", "word.\n\nNext  line\r\n x", "   a\x85 b",
       "the the the " * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    return real.union(odd).withColumn("ids", F.lit("clash")).withColumn("_text", F.lit(1)).repartition(3)


def test_sentencepiece_is_the_library(spark, docs):
    lib = sp.processor(PIECES)
    assert sp.splittable(PIECES)
    out = sp.decode(sp.encode(docs, PIECES), PIECES).collect()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(out) == len(text)
    for r in out:
        ids = lib.encode(text[r.doc_id])
        assert r.ids == ids and r.text == lib.decode(ids)


def test_sentencepiece_repeats_and_empty(spark, docs):
    twice = docs.where("doc_id = 10004").union(docs.where("doc_id = 10004"))
    assert sp.encode(twice, PIECES).count() == 2
    assert sp.decode(sp.encode(docs.limit(0), PIECES), PIECES).count() == 0
    nulls = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert sp.decode(nulls, PIECES).first().text == ""


def expected_rows(rows, end):
    lib, start, out = token_files.tokenizer(BYTES), 0, {}
    for i, t in sorted(rows):
        ids = lib.encode(t or "", add_special_tokens=False).ids + end
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        out[i] = (start, len(ids), zlib.crc32(raw))
        start += len(ids)
    return out


def test_token_files_are_the_library(spark, docs):
    assert token_files.splittable(BYTES)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = token_files.written_and_read(docs, BYTES, 0).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("crc")).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.crc) for r in got} == expected_rows(rows, [0])


@pytest.mark.parametrize("width", [2, 4])
def test_selected_documents_read_few_frames(spark, docs, tmp_path, width, monkeypatch):
    path = str(tmp_path / "files")
    token_files.write(docs, path, BYTES, end_id=0, width=width)
    want = [3, 10016, 10001]
    got = {r.doc_id: bytes(r.ids) for r in token_files.read(spark, path, doc_ids=want).collect()}
    everything = {r.doc_id: bytes(r.ids) for r in token_files.read(spark, path).collect()}
    assert got == {i: everything[i] for i in want}
    # one file by hand: small frames, a document over several frames, only its frames are read
    import pyarrow as pa
    from pyarrow import fs
    one = str(tmp_path / "one.zst")
    with fs.LocalFileSystem().open_output_stream(one, compression=None) as f:
        w = token_files.FrameWriter(f, width, frame_bytes=64)
        ids = [list(range(n)) for n in (5, 0, 100, 3, 500)]
        w.add(pa.array(range(5)), pa.array(ids, pa.list_(pa.int32())))
        w.close()
    with fs.LocalFileSystem().open_input_file(one) as f:
        r = token_files.FrameReader(f)
        for k in (3, 2, 1, 0, 4):
            r.frames_read, r._last = 0, (-1, b"")
            assert r.tokens(k) == b"".join(x.to_bytes(4, "little") for x in ids[k])
            assert r.frames_read <= len(ids[k]) * width // 64 + 2
    # any zstandard reader decompresses the frames and skips the index and the seek table
    raw = zstandard.ZstdDecompressor().stream_reader(open(one, "rb"), read_across_frames=True).read()
    assert raw == b"".join(x.to_bytes(width, "little") for i in ids for x in i)


def test_damaged_frame_is_noticed(tmp_path):
    import pyarrow as pa
    from pyarrow import fs
    one = str(tmp_path / "one.zst")
    with fs.LocalFileSystem().open_output_stream(one, compression=None) as f:
        w = token_files.FrameWriter(f, 4)
        w.add(pa.array([1]), pa.array([list(range(256))], pa.list_(pa.int32())))
        w.close()
    raw = bytearray(open(one, "rb").read())
    raw[60] ^= 255
    open(one, "wb").write(raw)
    with fs.LocalFileSystem().open_input_file(one) as f, pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.FrameReader(f).tokens(0)


def test_files_without_manifest_are_not_read(spark, docs, tmp_path):
    path = str(tmp_path / "files")
    token_files.write(docs.limit(5), path, BYTES)
    (tmp_path / "files" / "part-000000-lost.ids.zst").write_bytes(b"left by a lost task")
    assert token_files.read(spark, path).count() == 5
    files = json.loads((tmp_path / "files" / token_files.MANIFEST).read_text())["files"]
    assert sum(f["docs"] for f in files) == 5


def test_encode_column_is_the_library(spark, docs):
    lib = token_files.tokenizer(BYTES)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for end in (None, 7):
        for r in token_files.encode(docs, BYTES, end).collect():
            want = lib.encode(text[r.doc_id], add_special_tokens=False).ids
            assert r.ids == want + ([] if end is None else [end])


def test_token_files_null_ids_repeats_empty(spark):
    rows = [(None, "b"), (2, "a"), (2, "a"), (1, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.start, r.n_tokens) for r in
                  token_files.written_and_read(frame, BYTES, 0).collect()), key=lambda r: r[1])
    assert got == [(None, 0, 2), (1, 2, 1), (2, 3, 2), (2, 5, 2)]
    assert token_files.written_and_read(frame.limit(0), BYTES, 0).count() == 0


def test_table_that_forgets_gives_the_same_ids():
    import pyarrow as pa

    from proofline.llm.chunks import ChunkTable, by_position, packed
    calls = []

    def encode(chunks):
        calls.append(list(chunks))
        return [packed([len(c), ord(c[0])]) for c in chunks]
    lists = pa.array([["ab", "c"], [], ["c", "ab", "ddd"]], pa.list_(pa.string()))
    t = ChunkTable(encode, limit=1)
    first, second = by_position(lists, t).to_pylist(), by_position(lists, t).to_pylist()
    assert first == second == [[2, 97, 1, 99], [], [1, 99, 2, 97, 3, 100]]
    assert len(calls) == 2


def test_query_digests(spark):
    from proofline.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    lib = sp.processor(PIECES)
    for r in QUERIES["op1_sentencepiece"](spark, sf).collect():
        ids = lib.encode(text[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    want = expected_rows(text.items(), [0])
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in
           QUERIES["op2_token_files"](spark, sf).collect()}
    assert got == want


def test_round_trip_in_one_pass(spark):
    import hashlib

    import public_tokenizers
    import sentencepiece

    from proofline.llm import sentencepiece_codec as codec
    model = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = [None, "", " ", "a  b", "▁x y▁", "wörter und  ", "long " * 300_000, "twice", "twice"]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, ids string, _text string")
    rows = {r.doc_id: r for r in codec.round_trip(df, model, ["doc_id"]).collect()}
    assert sorted(rows) == list(range(len(texts)))
    for i, t in enumerate(texts):
        ids = lib.encode(t or "")
        assert rows[i].ids == ids and rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    assert codec.round_trip(df.limit(0), model, ["doc_id"]).count() == 0
