"""Clustering and coding of vectors, and licence scans, against plain Python over the same rows."""
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofline.llm import centroids, licenses, vector_codes
from proofline.llm.vector_codes import nearest, pivots_of, squared

NAN, INF = float("nan"), float("inf")


def _rows(n, dims, seed, scale=0.2):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, scale) for _ in range(dims)], rng.choice([1, 1, 1, 2, None])) for i in range(n)]


ODD = [(900, None, 1), (901, [], 1), (902, [0.1, None], 2), (903, [NAN, 0.1], 2), (904, [INF, 0.0], None), (905, [0.1], 3)]


def _frame(spark, rows):
    """Extra columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.withColumns({c: F.lit("x") for c in ("_row", "_id", "cluster", "c0", "d", "_q", "_d", "code", "error", "part")})


def _f32(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]


def _ok(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def _dist(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def _mean(rows):
    return [sum(c) // len(rows) for c in zip(*rows, strict=True)]


def _lloyd(rows, k, dims, scale, rounds):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v, _ in rows if _ok(v) and len(v) == dims]
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    cents = [v for _, v in start]
    for r in range(rounds + 1):
        out = [(i, v, *min((_dist(v, c), j) for j, c in enumerate(cents))) for i, v in kept]
        if r < rounds:
            cents = [_mean(own) if (own := [v for _, v, _, j in out if j == c]) else cents[c] for c in range(len(cents))]
    return sorted(((i, j, d) for i, _, d, j in out), key=str), cents


@pytest.mark.parametrize("n,dims,block", [(120, 2, 1), (90, 6, 4), (5, 2, 2), (0, 2, 2)])
def test_clusters(spark, n, dims, block):
    rows = _rows(n, dims, n)
    rows += ODD + [(r[0], r[1], None) for r in rows[:9]] + ([(None, [0.0] * dims, 1)] if n else [])  # repeats, a null id
    got, cents = centroids.centroid_clusters(_frame(spark, rows).repartition(3), k=7, dims=dims, rounds=3, block_dims=block)
    if not n:
        kept = [r for r in rows if _ok(r[1]) and len(r[1]) == dims]
        assert not kept and got.count() == 0 and centroids.with_inertia(got, cents).count() == 0
        return
    want, want_cents = _lloyd(_f32(rows), 7, dims, 64, 3)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert cents.tolist() == want_cents
    out = centroids.with_inertia(got, cents).collect()
    assert len(out) == len(want) and {r.inertia for r in out} == {sum(d for *_, d in want)}
    for r in out:
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, want_cents[r.cluster])).encode()).hexdigest()


def test_equal_vectors_take_the_smaller_centroid(spark):
    rows = [(i, [0.25, -0.25], 1) for i in range(40)]
    got, cents = centroids.centroid_clusters(_frame(spark, rows), k=4, dims=2, block_dims=1)
    assert {(r.cluster, r.distance) for r in got.collect()} == {(0, 0)} and cents.tolist() == [[16, -16]] * 4


def test_components_beyond_the_range_raise(spark):
    df = _frame(spark, [(1, [1e30, 0.0], 1)])
    with pytest.raises(Exception, match="beyond"):
        centroids.centroid_clusters(df, k=2, dims=2)


def _codes(rows, parts, entries, scale, rounds, dims):
    kept = [(i, lab, [math.floor(scale * x) for x in v]) for i, v, lab in rows if _ok(v) and len(v) == dims]
    w = dims // parts
    first = sorted((i, v) for i, _, v in kept if i is not None)[:entries]
    books = [[v[p * w:(p + 1) * w] for _, v in first] for p in range(parts)]
    for r in range(rounds + 1):
        own = [[min((_dist(v[p * w:(p + 1) * w], e), j) for j, e in enumerate(books[p])) for p in range(parts)] for *_, v in kept]
        if r < rounds:
            books = [[_mean(x) if (x := [k[2][p * w:(p + 1) * w] for k, o in zip(kept, own, strict=True) if o[p][1] == j]) else e
                      for j, e in enumerate(books[p])] for p in range(parts)]
    return sorted(((i, lab, "".join(f"{j:02x}" for _, j in o), sum(d for d, _ in o)) for (i, lab, _), o in zip(kept, own, strict=True)),
                  key=str), books


@pytest.mark.parametrize("n,dims,entries", [(150, 8, 20), (60, 4, 256), (3, 4, 8)])
def test_codes(spark, n, dims, entries):
    rows = _rows(n, dims, n + 1)
    rows += ODD + [(r[0], r[1], 2) for r in rows[:9]] + [(None, [0.5] * dims, 1), (950, [0.1] * (2 * dims), 1)]
    got, books = vector_codes.vector_codes(_frame(spark, rows).repartition(3), entries=entries, rounds=3)
    want, want_books = _codes(_f32(rows), 4, entries, 1024, 3, dims)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert [b.tolist() for b in books] == want_books
    out = vector_codes.with_label_error(got).collect()
    assert len(out) == len(want)
    for r in out:
        assert r.label_error == sum(e for _, lab, _, e in want if lab == r.label)


def test_codes_of_an_empty_table(spark):
    got, books = vector_codes.vector_codes(_frame(spark, ODD[:2]))
    assert got.count() == 0 and books == [] and vector_codes.with_label_error(got).count() == 0


@pytest.mark.parametrize("seed,spread", [(0, 3), (1, 40), (2, 100000)])
def test_pivot_search_is_exact(seed, spread):
    rng = np.random.default_rng(seed)
    x = rng.integers(-spread, spread, (3000, 5))
    e = rng.integers(-spread, spread, (200, 5))
    e[50:60] = e[0]  # ties
    p = pivots_of(e, 6)
    index, low, n = nearest(x, np.sqrt(squared(x, p).astype(float)), e, np.sqrt(squared(p, e).astype(float)))
    d = squared(x, e)
    assert (index == d.argmin(1)).all() and (low == d.min(1)).all() and n < d.size


# ---- licence scans -----------------------------------------------------------------------------
def _scan(texts):
    """The definition read off word lists."""
    docs = [licenses.words_of(t or "") for t in texts]
    vocab = {w for t in licenses.TEMPLATES for w in licenses.words_of(t.text)} | {w for p in licenses.BASE for w in p.split()}
    df = {w: sum(w in d for d in map(set, docs)) for w in vocab}

    def starts(d, p):
        return [i for i in range(len(d) - len(p) + 1) if d[i:i + len(p)] == p]
    out = []
    for d in docs:
        base = sorted((i, lab) for p, lab in licenses.BASE.items() for i in starts(d, p.split()))
        found = {}
        for t in licenses.TEMPLATES:
            text = licenses.words_of(t.text)
            keys = [licenses.words_of(p) for p in t.phrases]
            sure = {w for k in keys for w in sorted(set(k), key=lambda w: (df[w], w))[:2]}
            rare = [w for w in sorted(set(text) - sure, key=lambda w: (df[w], w)) if w in d][:licenses.RARE]
            votes = {}
            for p, w in enumerate(d):
                if w in sure or w in rare:
                    for q in [q for q, x in enumerate(text) if x == w]:
                        votes[p - q] = votes.get(p - q, 0) + 1
            for s, v in votes.items():
                if v < 2:
                    continue
                at = [[i for i in starts(d, k) if abs(i - s - starts(text, k)[0]) <= licenses.SLACK] for k in keys]
                cover = sum(any(0 <= q + s + j < len(d) and d[q + s + j] == w for j in range(-licenses.SLACK, licenses.SLACK + 1))
                            for q, w in enumerate(text)) / len(text)
                if all(at) and cover >= licenses.MIN_COVER:
                    k = (t.label, at[0][0])
                    found[k] = max(found.get(k, 0), cover)
        out.append((len(d), len(base), base[0][0] if base else None, base[-1][0] if base else None,
                    ",".join(sorted({x for _, x in base})), ",".join(sorted({x for _, x in base} | {k[0] for k in found})),
                    max([0.5 if base else 0.0, *found.values()]), sorted((*k, v) for k, v in found.items())))
    return out


def _texts():
    rng = random.Random(4)
    mit = licenses.TEMPLATES[8].text
    noise = "the of and license public cc by version 2 0 software free ñandú état x9".split()
    texts = [None, "", " \n\t", "no words of note", "All Rights  Reserved.\nall rights reserved", "ALL-RIGHTS-RESERVED",
             "Licensed under CC BY-NC 4.0.", "cc by cc by", "General Public\x00License", "Ünïcode GENERAL public license é",
             mit, mit.replace("free of charge", "free of any charge"), "# " + mit.replace(" ", "\n# "), mit[:60],
             " ".join(t.text for t in licenses.TEMPLATES), "we stand by the mit license and by cc",
             "Copyright 2020 Jane. Released by us under the MIT License today."]
    for _ in range(60):
        w = [rng.choice(noise) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            t = rng.choice(licenses.TEMPLATES).text.split()
            if rng.random() < 0.5 and len(t) > 3:
                del t[rng.randrange(len(t))]
            at = rng.randrange(len(w) + 1)
            w[at:at] = t
        texts.append(" ".join(w))
    return texts + ["word " * 200_000 + "All rights reserved."] + texts[4:7]  # very long; repeats


def test_licence_scan(spark):
    texts = _texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    df = df.withColumns({c: F.lit("x") for c in ("n_words", "labels", "_id", "_text", "score", "t")})
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, want in enumerate(_scan(texts)):
        r = got[i]
        assert (*tuple(r)[1:8], sorted(map(tuple, r.notices))) == want, texts[i][:200] if texts[i] else None


def test_licence_scan_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id string, text string")
    assert licenses.scan(df).count() == 0


def test_licence_index_refuses_what_it_cannot_look_up():
    with pytest.raises(ValueError, match="two words"):
        licenses.Index((licenses.Template("x", "some notice", ("notice",)),))
    with pytest.raises(ValueError, match="no key phrase"):
        licenses.Index((licenses.Template("x", "some notice", ()),))


def test_clean_prose_has_no_licence(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = licenses.scan(docs).join(docs.select("doc_id", F.lower("text").alias("t")), "doc_id")
    words = "license|licensed|rights reserved"
    assert rows.where(F.col("labels") != "").where(~F.col("t").rlike(words)).count() == 0
    assert rows.where(F.col("labels") == "").where(F.col("t").rlike(words)).count() == 0
