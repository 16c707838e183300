import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "gate_chain_reasons" in entry.queries()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", ["task_pass_at_k", "gate_chain_reasons", "pass_fail_contrast_pairs", "exact_auc", "audit_report", "error_patterns"])
def test_query_agrees_with_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    sql = c.sql(entry.oracle_sql()[name])
    at = [sql.columns.index(k) for k in cols]
    plain = lambda v: round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    got = sorted((tuple(plain(r[k]) for k in cols) for r in df.collect()), key=str)
    want = sorted((tuple(plain(r[i]) for i in at) for r in sql.fetchall()), key=str)
    assert got == want
