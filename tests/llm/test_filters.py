"""Language identification, toxicity, mixing and URL filters."""
import datetime as dt
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from proofline.llm import langid, mixing, toxicity, url_filter

SF = "/root/testdata/sf0.01"


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# ---- language ------------------------------------------------------------------------

@pytest.fixture(scope="module")
def lang_model(spark):
    return langid.train(read(spark, "documents"), learn=langid.for_training())


def test_language_held_out_accuracy(spark, lang_model):
    docs = read(spark, "documents").withColumn("score", F.lit("clash"))
    out = langid.predict(docs, lang_model).join(docs.select("doc_id", "lang"), "doc_id")
    held = out.where(~langid.for_training()).collect()
    assert len(held) > 150
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in held)


def test_language_odd_texts(spark, lang_model):
    texts = [None, "", " 12 !? ", "the " * 30_000, "日", "A", "é" * 10]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(docs, lang_model).collect()}
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3
    assert got[3].lang_pred == "en" and all(got[i].score == 0 for i in range(3))
    assert all(got[i].lang_pred in lang_model.langs for i in range(3, 7))
    kept = langid.accepted(docs.withColumn("_language", F.lit(1)), lang_model)
    assert 3 in {r.doc_id for r in kept.collect()} and kept.columns == ["doc_id", "text", "_language"]
    assert langid.predict(docs.limit(0), lang_model).count() == 0


def test_language_few_labels(spark):
    rows = [(1, "aaa bbb", "x"), (2, "ccc ddd", None), (3, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one = langid.train(docs)
    assert one.predict("whatever") == ("x", 1.0, False)
    none = langid.train(docs.where("lang is null"))
    assert none.predict("whatever") == ("und", 0.0, False)


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 64])
def test_ngrams_do_not_depend_on_pieces(piece):
    for text in ("Ein  Haus, zwei\n\nHäuser und 12 Mäuse. " * 12, "a", "ab", " ", "12", "a b", "  ab  ", "x" * 130, "words " * 40 + "  "):
        whole = Counter(int(x) for b in langid.buckets(text) for x in b)
        parts = Counter(int(x) for b in langid.buckets(text, piece=piece) for x in b)
        assert parts == whole


def _plain_read(model, text):
    """N-grams, margins and decoding in plain Python: (language, score, ambiguous)."""
    folded = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text)
    c = " " + " ".join(folded.split()) + " " if folded.strip() else " "
    sums, n = [0.0] * len(model.scale), 0
    for size in langid.ORDERS:
        for i in range(len(c) - size + 1):
            if c[i:i + size].strip():
                h = size
                for x in c[i:i + size]:
                    h = ((h ^ ord(x)) * 0x9E3779B97F4A7C15) & (1 << 64) - 1
                    h ^= h >> 29
                row = model.weights[h % len(model.weights)]
                sums, n = [s + float(w) for s, w in zip(sums, row, strict=True)], n + 1
    if not n:
        return "und", 0.0, False
    losses = []
    for word in model.code.tolist():
        z = [b * s / n / float(sc) for b, s, sc in zip(word, sums, model.scale, strict=True)]
        losses.append(sum(float(t) * math.log1p(math.exp(-langid.SHARPNESS * x)) for t, x in zip(model.trust, z, strict=True)))
    best = losses.index(min(losses))
    p = [math.exp(min(losses) - x) for x in losses]
    gap = (sorted(losses)[1] - losses[best]) / (langid.SHARPNESS * float(model.trust.sum()))
    return model.langs[best], p[best] / sum(p), gap < langid.AMBIGUITY


def test_predictions_equal_plain_python(spark, lang_model):
    docs = read(spark, "documents").union(read(spark, "documents").limit(5))  # repeated rows too
    texts = {r.doc_id: r.text or "" for r in docs.collect() if len(r.text or "") < 6000}
    got = [r for r in langid.predict(docs, lang_model).collect() if r.doc_id in texts]
    assert len(got) > 100
    for r in got:
        lang, score, ambiguous = _plain_read(lang_model, texts[r.doc_id])
        assert (r.lang_pred, r.ambiguous) == (lang, ambiguous) and math.isclose(r.score, score, rel_tol=1e-6)


def test_a_decoding_tie_goes_to_the_first_language():
    import numpy as np
    code = langid.codewords(2)
    model = langid.Model(["aa", "bb"], code, np.zeros((langid.BUCKETS, code.shape[1]), np.float32), np.ones(code.shape[1]), np.ones(code.shape[1]))
    assert model.predict("any words") == ("aa", 0.5, True)



def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 20, 60):
        code = langid.codewords(n).astype(int)
        apart = (code.shape[1] - code @ code.T) // 2
        least = min(apart[i, j] for i in range(n) for j in range(i))
        assert least >= max(1, code.shape[1] // 4)


def test_ambiguity_is_flagged(lang_model):
    assert not lang_model.predict("the and of with this that from")[2]
    mixed = [lang_model.predict(t)[2] for t in ("e", "a", "en", "de", "es la", "or")]
    assert any(mixed)


@pytest.mark.parametrize("learned", [("de", "en", "es", "fr"), ("de", "en", "es"), ("en", "fr"), ("en",)])
def test_only_learned_languages_are_accepted(spark, lang_model, learned):
    docs = read(spark, "documents")
    model = lang_model if len(learned) == 4 else langid.train(
        docs, learn=langid.for_training() & F.col("lang").isin(*learned))
    n = {r[0]: r[1] for r in docs.groupBy("lang").count().collect()}
    kept = {r[0]: r[1] for r in langid.accepted(docs, model).groupBy("lang").count().collect()}
    for lang in n:
        if lang in learned:
            assert kept[lang] >= 0.99 * n[lang]
        else:
            assert kept.get(lang, 0) <= 0.05 * n[lang]
    odd = spark.createDataFrame([(1, "Привет, мир! Как твои дела сегодня? " * 20), (2, None), (3, "12")],
                                "doc_id long, text string")
    assert langid.accepted(odd, model).count() == 0


def test_torn_text_is_not_accepted(spark, lang_model):
    text = {r.lang: r.text[:2000] for r in read(spark, "documents").where("length(text) > 2000").collect()}
    torn = spark.createDataFrame([(1, text["de"] + " " + text["en"]), (2, text["de"]), (3, text["en"])],
                                 "doc_id long, text string")
    assert {r.doc_id for r in langid.accepted(torn, lang_model).collect()} == {2, 3}


# ---- toxicity ------------------------------------------------------------------------

def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.train(docs, labels, learn=toxicity.for_training())
    rows = toxicity.score(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), model)
    held = rows.where(~toxicity.for_training()).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    tp = sum(r.predicted and r.toxic for r in held)
    assert all(0 <= r.score <= 1 for r in held)
    assert tp / sum(r.toxic for r in held) > 0.8
    assert sum(r.predicted and not r.toxic for r in held) <= 0.01 * len(held)
    odd = spark.createDataFrame([(1, None, 0), (2, "", 1), (3, "idiot " * 20_000, 2)],
                                "doc_id long, text string, score int")
    got = {r.doc_id: r for r in toxicity.score(odd, model).collect()}
    assert got[1].score == got[2].score and got[3].predicted == 1 and got[1].predicted == 0
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1), (9, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert [r.score for r in toxicity.score(docs, model).collect()] == [0.0, 0.0]


def test_features():
    lex = toxicity.Lexicon()
    f = dict(zip(toxicity.NAMES, toxicity.features("You are an IDIOT!! and 1d10t, m*oron x", lex), strict=True))
    assert f["insults"] == 3 / 8 and f["near_you"] == 2 / 8 and f["hidden_insults"] == 2 / 8
    assert f["shouted"] == 1 / 8 and f["marks"] > 0
    assert toxicity.features("", lex) == [0.0] * len(toxicity.NAMES)


# ---- mixing --------------------------------------------------------------------------

@pytest.mark.parametrize("shares", [{"a": 1}, {"a": 1, "b": 1}, {"a": 9, "b": 1, "c": 1},
                                    {"a": 7, "b": 5, "c": 3, "d": 2}, {f"s{i}": i + 1 for i in range(20)}])
def test_period_is_pfair(shares):
    slots, total, n = mixing.period(shares), sum(shares.values()), Counter()
    assert Counter(slots) == Counter(shares)
    for t, s in enumerate(slots, 1):
        n[s] += 1
        assert all(abs(n[x] - t * shares[x] / total) < 1 for x in shares)


def test_mix_against_block_by_block(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["a"] * 6 + ["b", "c", None, "zz"]), f"t{i}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    shares, block = {"a": 2, "b": 5, "c": 3}, 7
    out = mixing.mix(docs, shares, other=2, block_size=block).collect()
    assert sorted(r.doc_id for r in out) == list(range(900))
    pool = {i: s if s in shares else mixing.OTHER for i, s, _ in rows}
    counts = Counter(pool.values())
    shares = shares | {mixing.OTHER: 2}
    by_slot = defaultdict(list)
    for r in out:
        assert r.source == pool[r.doc_id]
        by_slot[r.slot].append(r)
    slots = [{(r.source, r.block, r.phase) for r in by_slot[t]} for t in range(len(by_slot))]
    assert all(len(x) == 1 for x in slots)
    order = [next(iter(x)) for x in slots]
    done = Counter()
    for s, b, _ in order:  # blocks of a source come in order and are full but the last
        assert b == done[s]
        done[s] += 1
    assert done == {s: -(-n // block) for s, n in counts.items()}
    for p in {x[2] for x in order}:  # within a phase no source is a block or more off
        part = [s for s, _, q in order if q == p]
        active = {s for s, _, q in order if q >= p}
        total, n = sum(shares[s] for s in active), Counter()
        for t, s in enumerate(part, 1):
            n[s] += 1
            assert all(abs(n[x] - t * shares[x] / total) < 1 for x in active)


def test_mix_sizes_repeats_nulls_and_empty(spark):
    rows = [(None, "a", "x", 5), (None, "a", "x", 5), (1, None, None, None), (2, "a", "y", -4), (3, "a", "z", 100)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars long")
    out = mixing.mix(docs, {"a": 1}, size_col="n_chars", block_size=10).collect()
    assert len(out) == 5
    kept = mixing.mixed(docs, {"a": 1})
    assert kept.columns == docs.columns and kept.count() == 5
    assert mixing.mix(docs.limit(0), {"a": 1}).count() == 0
    assert mixing.mixed(docs.limit(0), {"a": 1}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"a": 0})


def test_mixed_rows_come_in_the_order_of_the_mixture(spark, tmp_path):
    docs = read(spark, "documents")
    shares = {f"src{i}": i + 1 for i in range(20)}
    mixing.mixed(docs, shares, block_size=4).write.parquet(str(tmp_path / "m"))
    want = [r.doc_id for r in mixing.mix(docs, shares, block_size=4).orderBy("slot", "place").collect()]
    import pyarrow.parquet as pq
    got = [i for p in sorted((tmp_path / "m").glob("part-*")) for i in pq.read_table(p)["doc_id"].to_pylist()]
    assert got == want


# ---- URLs ----------------------------------------------------------------------------

def at(day):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day)


ENTRIES = [("domain", "Bad.com", "x", "add", at(10)), ("domain", "bad.com", "x", "remove", at(20)),
           ("domain", "bad.com", "x", "add", at(40)), ("domain", "bad.com", "y", "add", at(15)),
           ("domain", "a.b.org", None, "add", at(0)), ("prefix", "ok.net/p/q", "z", "add", at(5)),
           ("domain", "tie.com", "x", "add", at(3)), ("domain", "tie.com", "x", "remove", at(3)),
           ("domain", None, "x", "add", at(0)), ("domain", "bad.com", "x", "add", None),
           ("domain", "bad.com", "x", "noise", at(1)), ("domain", "10.0.0.1", "ip", "add", at(0))]
CAPTURES = [(1, "http://bad.com/", at(9)), (2, "http://www.BAD.com:80/x", at(10)),
            (3, "https://u@bad.com.", at(17)), (4, "http://bad.com", at(20)), (5, "http://bad.com", at(41)),
            (6, "http://notbad.com", at(17)), (7, "http://x.a.b.org/", at(1)), (8, "http://b.org/", at(1)),
            (9, "http://ok.net/p/q/r?s", at(6)), (10, "http://ok.net/p/qq", at(6)), (11, None, at(6)),
            (12, "nonsense", at(6)), (13, "http://bad.com", None), (14, "http://tie.com", at(4)),
            (15, "http://10.0.0.1/", at(1)), (16, "http://x.10.0.0.1.com/", at(1)),
            (1, "http://bad.com/", at(9)), (17, "http://localhost/a", at(1)), (17, "http://bad.com/", at(16))]


def test_url_filter(spark):
    entries = spark.createDataFrame(ENTRIES, "kind string, value string, category string, action string, at timestamp")
    captures = spark.createDataFrame(
        [(*c, "q") for c in CAPTURES], "page_id long, url string, fetched_at timestamp, category string")
    got = [(r.page_id, r.blocked, r.n_matches, r.categories, r.listed_since)
           for r in url_filter.judged(captures, entries, salts=3).collect()]
    hit = {2: ("x", at(10)), 3: ("x,y", at(10)), 4: ("y", at(15)), 5: ("x,y", at(15)), 7: ("", at(0)),
           9: ("z", at(5)), 14: ("x", at(3)), 15: ("ip", at(0))}
    want = []
    for n, (i, _, _) in enumerate(CAPTURES):
        c, since = ("x,y", at(10)) if n == len(CAPTURES) - 1 else hit.get(i, ("", None))
        want.append((i, since is not None, 0 if since is None else 2 if "," in c else 1, c, since))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_url_filter_empty(spark):
    entries = spark.createDataFrame([], "kind string, value string, category string, action string, at timestamp")
    captures = spark.createDataFrame(CAPTURES, "page_id long, url string, fetched_at timestamp")
    assert not any(r.blocked for r in url_filter.judged(captures, entries).collect())
    assert url_filter.judged(captures.limit(0), entries).count() == 0


def test_url_filter_keeps_the_case_of_paths(spark):
    entries = spark.createDataFrame(
        [("prefix", "Host.net/Adult", "a", "add", at(0)), ("prefix", "host.net/low", "b", "add", at(0)),
         ("prefix", "HOST.net", "c", "add", at(0)), ("domain", "Other.ORG", "d", "add", at(0))],
        "kind string, value string, category string, action string, at timestamp")
    urls = ["http://host.net/Adult/x", "http://HOST.net/Adult", "http://host.net/adult", "http://host.net/Low",
            "http://host.net/low", "http://www.other.org/Adult"]
    captures = spark.createDataFrame([(i, u, at(1)) for i, u in enumerate(urls)],
                                     "page_id long, url string, fetched_at timestamp")
    got = {r.page_id: r.categories for r in url_filter.judged(captures, entries, salts=3).collect()}
    assert got == {0: "a", 1: "a", 2: "", 3: "", 4: "b", 5: "d"}
