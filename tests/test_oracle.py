"""Every registered query with an oracle agrees with DuckDB on the smallest tables."""
import math

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in recs]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(dcols, res.fetchall())


def test_every_query_runs(spark):
    for name, fn in E.queries().items():
        if name not in E.oracle_sql():
            fn(spark, SF).write.format("noop").mode("overwrite").save()


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["run_id", "cases", "passed", "failed"]
    assert df.count() > 0
