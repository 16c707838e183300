
import hashlib
import os

import pytest

import __spark_entry__ as entry


def test_judge_prompts_hold_whole_texts(spark, tmp_path):
    task, code = "Add up the numbers. " * 60, "x = 1\n" * 200 + "y = 2"
    spark.createDataFrame([("r", "p", "test", True, None, code)], "response_id string, id string, split string, passed boolean, error string, extracted_code string").write.parquet(f"{tmp_path}/responses.parquet")
    spark.createDataFrame([("p", task)], "id string, prompt string").write.parquet(f"{tmp_path}/problems.parquet")
    prompt = f"Judge whether the program solves the task.\nState PASS or FAIL first, then the reason.\n\nTask:\n{task.strip()}\n\nProgram:\n{code}\n"
    assert [r.prompt_md5 for r in entry.queries()["judge_pairs_full"](spark, str(tmp_path)).collect()] == [hashlib.md5(prompt.encode()).hexdigest()]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_judge_pairs_full_agrees_with_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.01"
    c = duckdb.connect()
    for t in ("responses", "problems"):
        c.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    want = sorted(map(str, c.sql(entry.oracle_sql()["judge_pairs_full"]).fetchall()))
    got = sorted(str((r.response_id, r.prompt_md5, r.completion)) for r in entry.queries()["judge_pairs_full"](spark, d).collect())
    assert got == want and got


def test_failure_clusters_use_the_whole_text_and_all_clusters(spark, tmp_path):
    kinds = ["timeout", "logic_error", "runtime_error"]
    rows = [(f"r{i}", None if i % 3 == 0 else f"cause{i % 30} breaks part{i % 30}", kinds[i % 3], f"Error{i % 30}: value") for i in range(240)]
    spark.createDataFrame(rows, "response_id string, llm_summary string, failure_type string, error string").write.parquet(f"{tmp_path}/failures.parquet")
    got = entry.queries()["failure_clusters"](spark, str(tmp_path)).collect()
    assert {r.response_id for r in got} == {r[0] for r in rows} and len({r.cluster for r in got}) == 15
