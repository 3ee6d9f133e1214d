"""Exact, SimHash, embedding and line de-duplication against brute force."""
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from proofline.llm import embedding_dedup, exact_dedup, line_dedup, simhash
from proofline.llm.components import components

DOC = "doc_id long, text string, _id string, _text string, rank int, fp string, n int"


def docs_of(spark, rows):
    return spark.createDataFrame(
        [(i, t, "x", "y", 1, "z", 2) for i, t in rows], DOC)


def union_find(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# ---- components --------------------------------------------------------------------

def test_components_of_random_links(spark):
    rnd = random.Random(5)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)]
    links += [(i, i + 1) for i in range(400, 440)] + [(500, i) for i in range(501, 560)]
    root = union_find(600, links)
    got = dict(components(spark.createDataFrame(links + [(None, 3)], "x long, y long")).collect())
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: root[x] for x in nodes}


def test_components_without_links(spark):
    assert components(spark.createDataFrame([(1, 1)], "x long, y long")).count() == 0


# ---- exact ---------------------------------------------------------------------------

ROWS = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (None, "a"), (None, "c"), (7, "A"),
        (8, "a "), (9, "x" * 300_000), (10, "x" * 300_000), (3, "a"), (11, "b")]


def expected_exact(rows):
    best, size = {}, {}
    for i, t in rows:
        t = t or ""
        best[t] = max([x for x in (best.get(t), i) if x is not None], default=None)
        size[t] = size.get(t, 0) + 1
    seen, out = set(), []
    for i, t in rows:
        t = t or ""
        kept = i == best[t] and t not in seen
        if kept:
            seen.add(t)
        out.append((i, best[t], size[t], kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [exact_dedup.sha256_hex, lambda t: F.substring(F.md5(t), 1, 1)])
def test_exact_groups(spark, digest):
    docs = docs_of(spark, ROWS).repartition(4)
    got = [tuple(r) for r in exact_dedup.exact_groups(docs, salts=3, digest=digest).collect()]
    assert sorted(got, key=str) == expected_exact(ROWS)


def test_exact_dedup_keeps_columns_and_nulls(spark):
    docs = docs_of(spark, ROWS).repartition(3)
    out = exact_dedup.exact_dedup(docs, salts=3)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(3, "a"), (11, "b"), (5, ""), (None, "c"), (7, "A"), (8, "a "),
                          (10, "x" * 300_000)], key=str)
    only_null = exact_dedup.exact_dedup(docs_of(spark, [(1, ""), (2, None)]))
    assert [(r.doc_id, r.text) for r in only_null.collect()] == [(2, None)]


def test_exact_empty_table(spark):
    docs = docs_of(spark, ROWS).limit(0)
    assert exact_dedup.exact_groups(docs).count() == 0
    assert exact_dedup.exact_dedup(docs).count() == 0


# ---- SimHash -------------------------------------------------------------------------

def brute_fingerprint(text, words=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    found = [w for w in low.split(" ") if w]
    if not found:
        return 0
    parts = [" ".join(found[i:i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    texts = [None, "", " \t\n", "one", "One TWO", "a b c", "a  b\tc\nd", "É été ÀB c d é", "x " * 5000,
             "a b c\x1cd e f g", "w1 w2 w3 w1 w2 w3 w1 w2 w3"]
    docs = docs_of(spark, list(enumerate(texts)))
    got = {r["doc_id"]: r["fingerprint"] for r in simhash.simhash_groups(docs).collect()}
    assert got == {i: f"{brute_fingerprint(t):016x}" for i, t in enumerate(texts)}


def test_golay_keys_meet_within_two_bits():
    rnd = np.random.default_rng(1)
    words = rnd.integers(0, 1 << 23, 3000)
    keys = {}
    for name, w in (("a", words), ("b", words ^ (1 << rnd.integers(0, 23, 3000))
                                   ^ (1 << rnd.integers(0, 23, 3000)))):
        rows, index = simhash.golay_keys(w)
        keys[name] = [set() for _ in words]
        for r, i in zip(rows, index, strict=True):
            keys[name][r].add(int(i))
    assert all(a & b for a, b in zip(keys["a"], keys["b"], strict=True))
    assert {len(x) for x in keys["a"]} == {1, 6}


@pytest.mark.parametrize("bits", [0, 1, 2])
@pytest.mark.parametrize("limit", [2, 64])
def test_fingerprint_links(spark, bits, limit):
    rnd = random.Random(3)
    fps = set()
    for _ in range(25):
        base = rnd.getrandbits(64)
        fps.add(base)
        for _ in range(8):
            x = base
            for _ in range(rnd.randrange(5)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    links = [(i, j) for i in range(len(fps)) for j in range(i)
             if bin((fps[i] ^ fps[j]) & (1 << 64) - 1).count("1") <= bits]
    root = union_find(len(fps), links)
    frame = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = dict(components(simhash.fingerprint_links(frame, bits, limit)).collect())
    assert [got.get(x, x) for x in fps] == [fps[r] for r in root]


def test_simhash_null_ids_repeats_and_empty(spark):
    rows = [(5, "a b c d e"), (3, "A b c d e"), (3, "A b c d e"), (None, "a b c d e"),
            (None, "lone words here"), (6, None), (8, "")]
    got = sorted(((r["doc_id"], r["component_id"]) for r in
                  simhash.simhash_groups(docs_of(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (None, 3), (None, None), (6, 6), (8, 6)], key=str)
    left = simhash.simhash_dedup(docs_of(spark, rows))
    assert left.columns == docs_of(spark, rows).columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(
        [(3, "A b c d e"), (3, "A b c d e"), (None, "lone words here"), (6, None)], key=str)
    empty = docs_of(spark, rows).limit(0)
    assert simhash.simhash_groups(empty).count() == 0 and simhash.simhash_dedup(empty).count() == 0


# ---- embeddings ----------------------------------------------------------------------

def brute_links(vectors, threshold):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)
          and any(v) for v in vectors]
    dim = max((len(v) for v, k in zip(vectors, ok, strict=True) if k), default=1)
    x = np.zeros((len(vectors), dim))
    for i, (v, k) in enumerate(zip(vectors, ok, strict=True)):
        if k:
            x[i, :len(v)] = v
            x[i] /= np.linalg.norm(x[i])
    cos = x @ x.T
    return [(i, j) for i in range(len(vectors)) for j in range(i) if ok[i] and ok[j]
            and cos[i, j] >= threshold]


def test_embedding_groups_recall_near_the_threshold(spark):
    rnd = np.random.default_rng(4)
    rows = []
    for _ in range(150):
        base = rnd.standard_normal(32)
        base /= np.linalg.norm(base)
        rows.append(base)
        for _ in range(3):
            other = rnd.standard_normal(32)
            other -= other @ base * base
            other /= np.linalg.norm(other)
            c = rnd.uniform(0.88, 1.0)
            rows.append(c * base + np.sqrt(1 - c * c) * other)
    vectors = [np.float32(v * rnd.uniform(0.1, 9)).tolist() for v in rows]
    links = brute_links(vectors, 0.9)
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    out = embedding_dedup.embedding_groups(frame).collect()
    found = sum(r.n_links for r in out) / 2
    assert 0.9 * len(links) <= found <= len(links)


def test_embedding_hot_groups_blocks_and_bad_vectors(spark):
    rnd = np.random.default_rng(2)
    base = rnd.standard_normal(16)
    vectors = [np.float32(base + 0.02 * rnd.standard_normal(16)).tolist() for _ in range(90)]
    vectors += [vectors[0]] * 40 + [rnd.standard_normal(16).tolist() for _ in range(60)]
    vectors += [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] + [0.0] * 14,
                [float("inf")] + [1.0] * 15, np.float32(base).tolist()[:15], [1e30] + [0.0] * 15,
                [1e-30] + [0.0] * 15]
    links = brute_links(vectors, 0.9)
    root = union_find(len(vectors), links)
    degree = np.bincount(np.array(links).ravel(), minlength=len(vectors))
    frame = spark.createDataFrame(
        [(i, v, "a", 7) for i, v in enumerate(vectors)],
        "vec_id long, embedding array<float>, _node string, _n int").repartition(5)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept)
           for r in embedding_dedup.embedding_groups(frame, block=16).collect()}
    assert got == {i: (degree[i], root[i], root[i] == i) for i in range(len(vectors))}


def test_embedding_null_id_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    out = embedding_dedup.embedding_groups(spark.createDataFrame(
        [(None, [1.0, 0.0]), (4, [1.0, 0.0]), (2, [2.0, 0.0])], schema)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in out), key=str) == sorted(
        [(None, 0, None, False), (4, 1, 2, False), (2, 1, 2, True)], key=str)
    assert embedding_dedup.embedding_groups(spark.createDataFrame([], schema)).count() == 0


def test_runs_cross_batches():
    batches = [pa.record_batch([pa.array(x), pa.array(x)], names=["k", "v"])
               for x in ([1, 1, 2], [2, 2], pa.array([], pa.int64()), [3])]
    got = [t["v"].to_pylist() for t in embedding_dedup._runs(iter(batches), ["k"])]
    assert got == [[1, 1], [2, 2, 2], [3]]


# ---- lines ---------------------------------------------------------------------------

def brute_lines(rows, min_lines, min_words):
    """Delete every line of each window that also occurs at an earlier place."""
    docs = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, gone = set(), {}
    for i, t in docs:
        lines = [(k, x) for k, x in enumerate(t.split("\n")) if x.strip(" \t\r")]
        bad = gone.setdefault((i, t), set())
        for p in range(len(lines)):
            for n in {1, min_lines}:
                w = lines[p:p + n]
                if len(w) < n or (n < min_lines and len(w[0][1].split(" ")) < min_words):
                    continue
                key = tuple(x for _, x in w)
                if key in seen:
                    bad |= {k for k, _ in w}
                seen.add(key)
    return gone


@pytest.mark.parametrize("min_lines", [1, 2, 3, 5])
def test_line_dedup(spark, min_lines):
    rnd = random.Random(min_lines)
    words = ["alpha", "beta", "gamma", "delta", "", "  ", "one two three four five"]
    rows = [(i, "\n".join(rnd.choice(words) for _ in range(rnd.randrange(14)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "a\na\na\na\na"), (103, "hot\nline"), (104, "hot\nline"),
             (None, "hot\nline\nhot\nline"), (105, "x" * 50_000 + "\nhot\nline")]
    gone = brute_lines(rows, min_lines, 5)
    out = line_dedup.line_dedup(docs_of(spark, rows).repartition(3), min_lines=min_lines, min_words=5)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        bad = gone[(i, t or "")]
        keep = [x for k, x in enumerate((t or "").split("\n")) if k not in bad]
        assert (got[i].text or "") == "\n".join(keep), i
        assert got[i].n_deleted == len(bad)
    assert got[100].text is None


def test_line_dedup_repeated_rows_and_empty(spark):
    rows = [(1, "p\nq"), (1, "p\nq"), (1, "p\nq\nr"), (2, "q\nr")]
    got = sorted((r.doc_id, r.n_deleted) for r in line_dedup.line_dedup(docs_of(spark, rows)).collect())
    assert got in ([(1, 0), (1, 0), (1, 2), (2, 2)], [(1, 0), (1, 2), (1, 2), (2, 2)])
    assert line_dedup.line_dedup(docs_of(spark, rows).limit(0)).count() == 0
