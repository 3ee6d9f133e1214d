"""Queries against their SQL, and the pipeline against plain Python over the same rows."""
import hashlib

import pytest

import __spark_entry__ as E
import corpus_pipeline
from proofline.llm import langid, mixing, simhash
from proofline.llm.common import positioned
from proofline.llm.queries import ORACLE, QUERIES, shares_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    res = duck.execute(ORACLE[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    assert sorted(got, key=str) == sorted(res.fetchall(), key=str)


def test_registered():
    names = E.queries()
    assert "pipeline" in names and {f"op{i}_" for i in range(1, 11)} <= {n.split("_")[0] + "_" for n in names}


def test_pipeline_stages(spark):
    import public_tokenizers
    import sentencepiece
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    odd = spark.createDataFrame([(90_000, None, None, None, None), (90_001, "12 34", "en", "src1", 5)], docs.schema)
    docs = docs.union(odd).repartition(3)
    model = langid.train(docs, learn=langid.for_training())

    def step(i, d):
        out = corpus_pipeline.STAGES[i][1](spark, d, SF)
        if i < 4:
            assert out.columns == columns
        return spark.createDataFrame(out.collect(), out.schema)
    kept = step(0, docs)
    want = {i for i, r in rows.items() if (p := model.predict(r.text))[0] != "und" and p[1] >= langid.MIN_SCORE}
    assert {r.doc_id for r in kept.collect()} == want and len(want) >= len(rows) - 2
    best = {}
    for i in sorted(want):
        best[rows[i].text] = i
    kept = step(1, kept)
    assert {r.doc_id for r in kept.collect()} == (want := set(best.values()))
    fp = {i: simhash.fingerprint(rows[i].text.encode()) & (1 << 64) - 1 for i in want}
    low = {i: i for i in want}
    changed = True
    while changed:
        changed = False
        for i in want:
            near = min(low[j] for j in want if bin(fp[i] ^ fp[j]).count("1") <= 2)
            if near < low[i]:
                low[i], changed = near, True
    kept = step(2, kept)
    assert {r.doc_id for r in kept.collect()} == (want := {i for i in want if low[i] == i})
    kept = step(3, kept)
    assert sorted(map(tuple, kept.collect())) == sorted(tuple(rows[i]) for i in want)
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = step(4, kept).collect()
    assert {r.doc_id for r in out} == want
    for r in out:
        ids = lib.encode(rows[r.doc_id].text)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() <= spark.read.parquet(f"{SF}/documents.parquet").count()


def test_pipeline_rows_come_in_the_order_of_the_mixture(spark, monkeypatch):
    # several files of unlike size, read in small splits: a scan alone loses their order
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        seen = []

        def mix(s, d, sf):
            seen.append(d)
            return corpus_pipeline.mix_sources(s, d, sf)
        stages = [(n, mix if n == "mixing" else f) for n, f in corpus_pipeline.STAGES]
        monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
        out = corpus_pipeline.run(spark, SF)
        rows = out.collect()
        want = [r.doc_id for r in mixing.mix(seen[0], shares_of()).orderBy("slot", "place").collect()]
        assert [r.doc_id for r in rows] == want
        assert [r.position for r in rows] == list(range(len(want)))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_positions_of_a_table(spark, tmp_path):
    spark.range(1000).repartitionByRange(7, "id").sortWithinPartitions("id").write.parquet(str(tmp_path / "t"))
    got = positioned(spark.read.parquet(str(tmp_path / "t")), "at").collect()
    assert len(got) == 1000 and all(r.at == r.id for r in got)
    made = spark.createDataFrame([(i,) for i in range(9)], "id long")  # no scan: written first
    assert sorted((r.at, r.id) for r in positioned(made, "at").collect()) == [(i, i) for i in range(9)]
    assert positioned(made.limit(0), "at").count() == 0
