import hashlib
import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lodestack.functions import hashing as H, jsonfn as N, pyast as Y, stats as X, text as T


def _one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()[0]


def test_hashes_agree_with_hashlib(spark):
    keys = ["", "apps/train/1", "ünï", "x" * 5000]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select(
        "k", H.bucket_sha1(F.col("k")).alias("a"), H.bucket_sha256(F.col("k")).alias("b"), H.bucket_sha256(F.col("k"), 7, 8).alias("c"), H.unit_interval(F.col("k")).alias("u"), H.side(F.col("k")).alias("s"), H.short_hash(F.col("k")).alias("h")
    ).collect()
    for r in rows:
        one, two = hashlib.sha1(r.k.encode()).hexdigest(), hashlib.sha256(r.k.encode()).hexdigest()
        assert (r.a, r.b, r.c) == (int(one[:8], 16) % 100, int(two[:16], 16) % 100, int(two[:8], 16) % 7)
        assert r.u == pytest.approx(int(two[:16], 16) / 16**16, abs=1e-15) and r.s == (int(two, 16) % 2 == 0) and r.h == two[:12]


def test_null_keys_stay_null(spark):
    row = spark.createDataFrame([(None,)], "k string").select(H.bucket_sha1(F.col("k")), H.split_by_bucket(H.bucket_sha1(F.col("k")), 80, 10), H.short_hash(F.col("k"))).first()
    assert list(row) == [None, None, None]


@pytest.mark.parametrize("wins,losses", [(0, 0), (1, 0), (5, 5), (13, 27), (0, 30), (400, 520), (3000, 3300)])
def test_exact_sign_test(spark, wins, losses):
    n, k = wins + losses, min(wins, losses)
    want = 1.0 if not n else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
    assert _one(spark, X.exact_sign_p(F.col("a"), F.col("b")), a=wins, b=losses) == pytest.approx(want, rel=1e-9)


def test_wilson_and_kappa(spark):
    low, high = X.wilson(F.col("p"), F.col("n"))
    assert _one(spark, F.array(low, high), p=0, n=0) == [0.0, 0.0]
    got = _one(spark, F.array(low, high), p=42, n=100)
    assert got == pytest.approx([0.3280, 0.5178], abs=1e-3)
    assert _one(spark, X.kappa(F.col("a"), F.col("b"), F.col("c"), F.col("d")), a=20, b=15, c=5, d=10) == pytest.approx(0.4)
    assert _one(spark, X.kappa(F.col("a"), F.col("b"), F.col("c"), F.col("d")), a=9, b=0, c=0, d=0) == 0.0


@pytest.mark.parametrize("text,want", [(None, ""), ("", ""), ("x = 1\r\ny", "x = 1\ny"), ("a\n```python\nb  \n\n```\nc ```d```", "b"), ("```\nopen", "open"), ("p\n```", "p"), ("  \n q \n", "q")])
def test_normalised_code(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.normalize_code(F.col("t"))).first()[0] == want


def test_text_functions(spark):
    assert _one(spark, T.slug(F.col("t")), t="Off by One!!") == "off_by_one"
    assert _one(spark, T.slug(F.col("t")), t="???") == "item"
    assert _one(spark, T.clipped(F.col("t"), 3), t="  abcd ") == "abc..."
    assert _one(spark, T.section(F.col("t"), "Task:", ("End:", "Stop:")), t="x Task: do it Stop: no End: y") == "do it"
    assert _one(spark, T.same_stdout(F.col("a"), F.col("b")), a=" 1 2\n", b="1\n2") is True
    assert _one(spark, T.verdict(F.col("t")), t="Some text\nVerdict: **FAIL**") == "FAIL"
    assert _one(spark, T.verdict(F.col("t")), t="nothing") is None
    assert _one(spark, T.callables_in_asserts(F.array(F.col("t")), ("len",)), t="assert f(1) == len(2)") == ["f"]
    assert _one(spark, T.problem_number(F.col("t")), t="apps/train/12__sample3") == 12


PROGRAM = "import sys\ndef solve(a: List[int], b=1):\n    return a\nclass Solution:\n    def run(self):\n        pass\nassert solve(1)\nif __name__ == '__main__':\n    solve(2)\nsolve(3)\n"


def test_program_audit():
    a = Y.audit(PROGRAM)
    assert a["parseable"] and a["functions"] == ["solve"] and a["solution_methods"] == ["run"] and a["demos"] == 3 and a["missing_typing"] == ["List"] and a["signatures"] == ["solve(a: List[int], b=1)"]
    assert not Y.audit("def f(:")["parseable"] and Y.audit(None)["parseable"] and not Y.audit("\0")["parseable"]
    assert Y.audit("(" * 3000)["parseable"] is False
    clean = Y.without_harness(PROGRAM)
    assert "assert" not in clean and "__main__" not in clean and Y.audit(clean)["demos"] == 0
    assert Y.without_harness("f()") == "f()" and Y.parseable_prefix("a = 1\nb = (") == "a = 1" and Y.parseable_prefix("(") == ""
    assert Y.reject_reasons("print(1)", ["f"]) == ["interface_missing", "top_level_demo"] and Y.reject_reasons("", []) == ["empty"]


def test_revised_code():
    raw = "ERROR_FINDINGS:\n- x\nREVISED_CODE:\n```python\ndef f():\n    return 1\nf()\n```\nthanks"
    got = Y.revised_code(raw)
    assert got["code"].strip() == "def f():\n    return 1" and got["status"] == "clean" and got["notes"] == ["fence", "harness_removed"]
    assert Y.revised_code(None)["status"] == "empty"
    assert Y.revised_code("REVISED_CODE:\na = 1\nb = (")["code"] == "a = 1"


def test_analysis_of_repeated_null_and_long_programs(spark):
    df = spark.createDataFrame([(1, "x = 1"), (2, "x = 1"), (3, None), (4, ""), (5, "y = 2\n" * 20_000)], "id int, code string")
    rows = {r.id: r.audit for r in Y.analysed(df, "code").collect()}
    assert rows[1] == rows[2] and rows[3] is None and rows[4].parseable and rows[5].parseable and len(rows) == 5
    assert Y.analysed(df.limit(0), "code").count() == 0


def test_json_recovery():
    assert N.find_object('so {"a": {"b": "}"}} and {"x": 1, "y": 2}', ("x", "y")) == {"x": 1, "y": 2}
    assert N.find_object("```json\n{'a': (1, 2)}\n```") == {"a": (1, 2)}
    assert N.find_object("no") is None and N.find_object(None) is None and N.balanced("{a {b}") == []
    assert N.truncated_items('{"tests": [{"a": 1}, {"a": 2}, {"a"', "tests") == [{"a": 1}, {"a": 2}]
    assert N.same((1, [2.0000001]), [1, (2,)]) and not N.same([1], [2]) and N.same([3], 3) and not N.same(True, 1.5)
    assert N.difference([1], [1, 2]) == "wrong_length" and N.difference(1, "1") == "wrong_type" and N.difference(1, 2) == "wrong_value"


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text(max_size=4), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=3), c, max_size=3), max_leaves=8))
def test_canonical_json_round_trip(value):
    assert N.load(N.canonical(value)) == value and N.canonical(N.load(N.canonical(value))) == N.canonical(value)


def test_input_output_in_both_encodings(spark):
    rows = [('{"a": 1}',), ('"{\\"a\\": 1}"',), ("[1]",), (None,), ("",), ("nonsense",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(N.unwrapped(F.col("t"))).collect()]
    assert got == ['{"a": 1}', '{"a": 1}', None, None, None, None]
