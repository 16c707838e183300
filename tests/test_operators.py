import random

import pytest
from pyspark.sql import functions as F

from lodestack.operators import audit as A, contrast, execute as E, gates as G, joins as J, metrics as M, ordered, paired as P, rubric as B, selection as S


def test_cumulative_and_nearest_rank(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab") if rng.random() < 0.9 else None, rng.choice([None, *range(20)])) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, v int")
    got = {r.g: r for r in ordered.nearest_rank(df, "v", ["g"]).collect()}
    for g in ("a", "b", None):
        vals = sorted(v for k, v in rows if k == g and v is not None)
        assert (got[g].n, got[g].min, got[g].max) == (len(vals), vals[0], vals[-1])
        assert got[g].p50 == vals[round((len(vals) - 1) * 0.5)] and got[g].p95 == vals[round((len(vals) - 1) * 0.95)]
    assert ordered.nearest_rank(df.limit(0), "v").count() in (0, 1)
    ranks = ordered.ranked(spark.range(100).select((99 - F.col("id")).alias("k")), ["k"])
    assert all(r.k == r.rank for r in ranks.collect())


def test_auc_matches_pairs(spark):
    rng = random.Random(5)
    rows = [(rng.random() < 0.4, rng.choice([1.0, 1.5, 2.0, None, float("nan")])) for _ in range(150)]
    df = spark.createDataFrame(rows, "y boolean, s double")
    pos = [s for y, s in rows if y and s is not None and s == s]
    neg = [s for y, s in rows if not y and s is not None and s == s]
    want = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))
    assert M.exact_auc(df, F.col("y"), F.col("s")).first().auc == pytest.approx(want)
    assert M.exact_auc(df.where("y"), F.col("y"), F.col("s")).first().auc is None
    assert M.exact_auc(df.limit(0), F.col("y"), F.col("s")).first().auc is None
    grid, distinct = M.sweep_grid(df, F.col("y"), F.col("s"), [1.0, 1.5, 2.0]), M.sweep_scores(df, F.col("y"), F.col("s"))
    key = lambda r: r["threshold"]
    assert sorted(grid.collect(), key=key) == sorted(distinct.select(*grid.columns).collect(), key=key)


def test_gate_chain_against_a_loop(spark):
    rng = random.Random(7)
    rows = [(f"p{rng.randrange(6)}", i, rng.random() < 0.2, rng.random() < 0.3) for i in range(120)]
    df = spark.createDataFrame(rows, "p string, i int, bad boolean, late boolean")
    out = {r.i: r.reason for r in G.gate_chain(df, [("bad", F.col("bad"))], [("late", F.col("late"))], "p", [F.col("i")], 2, "cap").collect()}
    used = {}
    for p, i, bad, late in rows:
        want = "bad" if bad else "cap" if used.get(p, 0) >= 2 else "late" if late else None
        used[p] = used.get(p, 0) + (want is None)
        assert out[i] == want
    counts = G.reason_counts(G.gate_chain(df, [], [], "p", [F.col("i")], 2, "cap"))
    assert sum(r.rows for r in counts.collect()) == 120


def test_greedy_caps_against_a_loop(spark):
    rng = random.Random(9)
    rows = [(i, f"p{rng.randrange(15)}" if rng.random() < 0.95 else None, f"t{min(rng.randrange(9), 3)}") for i in range(200)]
    got = {r.i for r in S.greedy_capped(spark.createDataFrame(rows, "i int, p string, t string"), ["i"], {"p": 2, "t": 7}).collect()}
    used, want = {}, set()
    for i, p, t in rows:
        if p is not None and used.get(p, 0) < 2 and used.get(t, 0) < 7:
            want.add(i)
            used[p], used[t] = used.get(p, 0) + 1, used.get(t, 0) + 1
    assert got == want
    assert S.greedy_capped(spark.createDataFrame([], "i int, p string, t string"), ["i"], {"p": 2, "t": 7}).count() == 0


def test_contrast_pairs_against_all_pairs(spark):
    rng = random.Random(11)
    rows = [(rng.choice(["a", "b", None]), f"k{i:03d}", rng.choice([1, 3, 20, 100, 900, 7000, None]), rng.choice([True, False, None])) for i in range(160)]
    got = {(r.t, r.chosen): r.rejected for r in contrast.first_compatible(spark.createDataFrame(rows, "t string, k string, n int, ok boolean"), "t", "k", "n", "ok").collect()}
    want = {}
    for t, k, n, ok in rows:
        if t and n and ok:
            fit = [k2 for t2, k2, n2, ok2 in rows if t2 == t and n2 and not ok2 and max(n, n2) <= 8 * min(n, n2)]
            if fit:
                want[t, k] = min(fit)
    assert got == want


def test_selection(spark):
    rows = [("a", "x", 1, 2.0), ("a", "x", 2, 2.0), ("a", "y", 3, float("nan")), ("b", None, 4, 1.0), (None, "x", 5, None)]
    df = spark.createDataFrame(rows, "g string, p string, k int, s double")
    assert {r.k for r in S.keep_first(df, ["g"], [F.col("k").desc() if False else F.col("k")]).collect()} == {1, 4, 5}
    assert [r.k for r in S.diverse_examples(df, "g", "p", "k", 2).where("g = 'a'").orderBy("place").collect()] == [1, 3]
    assert S.margin_pairs(df, "g", "k", "s", 0.5).count() == 0
    split = S.proportion_split(spark.range(10).selectExpr("cast(id as string) id"), "id", "s", {"train": 0.5, "validation": 0.25, "test": 0.25})
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 5, "validation": 2, "test": 3}
    assert [(r.g, r.turn) for r in S.round_robin(df.where("g is not null"), "g", [F.col("k")], 3).collect()] == [("a", 1), ("b", 1), ("a", 2)]


def test_paired_runs(spark):
    a = spark.createDataFrame([("1", True), ("2", False), ("3", True)], "id string, passed boolean")
    b = spark.createDataFrame([("1", False), ("2", True), ("4", True)], "id string, passed boolean")
    with pytest.raises(P.PairingError):
        P.strictly_paired(a, b, "id", ["passed"])
    assert list(P.overlap(P.paired(a, b, "id", ["passed"])).first()) == [2, 1, 1]
    t = P.transitions(P.paired(a, a, "id", ["passed"]), F.col("base_passed"), F.col("candidate_passed")).first()
    assert (t.net_delta, t.mcnemar_p, t.kept) == (0, 1.0, 2)
    boot = P.bootstrap_difference(P.paired(a, a, "id", ["passed"]), F.col("base_passed"), F.col("candidate_passed"), 2000).first()
    assert (boot.low, boot.high, boot.not_better) == (0.0, 0.0, 1.0)


def test_execution():
    ok = E.run_tests("def f(a, b):\n    return [a + b]", "f", [{"args": [1, 2], "expected": 3}])
    assert ok["passed"] and ok["passed_tests"] == [0]
    assert E.run_tests("def f(a):\n    return a", "f", [{"args": [1], "expected": 2}])["failure_type"] == "logic_error"
    assert E.run_tests("def f(:", "f", [{"args": []}])["failure_type"] == "syntax_error"
    assert E.run_tests("def g(): pass", "f", [{"args": []}])["first_kind"] == "missing_required_interface"
    assert E.run_tests("def f():\n    while True: pass", "f", [{"args": []}], 1.0)["failure_type"] == "timeout"
    assert E.run_tests("", "f", [])["failure_type"] == "generation_failure"
    assert E.run_tests("class Solution:\n    def f(self, x):\n        return 'y' * x", "f", [{"args": [300000], "expected": "y" * 300000}])["passed"]
    assert E.run_tests("import sys\nprint(sum(map(int, sys.stdin.read().split())))\nsys.exit(0)", None, [{"args": ["1 2\n"], "expected": "3"}])["passed"]
    assert E.run_tests("def f():\n    return 'x' * (1 << 40)", "f", [{"args": []}])["failure_type"] == "runtime_error"
    assert not E.run_tests("def f(): return 1", "f", [])["passed"]


def test_suites(spark):
    suites = spark.createDataFrame([("p", "def f(x):\n    return x + 1", "def f(x):\n    return x", "f", '[{"args": [1], "expected": 2}, {"args": [1], "expected": 9}]'), ("q", "def f(x):\n    return 1", "def f(x):\n    return 1", "f", '[{"args": [1], "expected": 1}]')], "id string, good string, bad string, fn string, tests string")
    gated = {r.id: r for r in E.gated_suites(suites, "good", "bad", "fn", "tests").collect()}
    assert gated["p"].quality_gate_passed and gated["p"].kept == 1 and not gated["q"].quality_gate_passed
    merged = E.merged_suites(spark.createDataFrame([("p", '[{"args":[1],"expected":2}]'), ("p", '[{"expected":2,"args":[1]}]')], "id string, tests string"), "id", "tests")
    assert merged.first().test_count == 1
    cands = spark.createDataFrame([("p", "c1", "def f(x):\n    return x + 1", "f"), ("p", "c2", "def f(x):\n    return 0", "f"), ("z", "c3", "def f(x):\n    return 0", "f")], "id string, response_id string, code string, fn string")
    scored = {r.response_id: r for r in E.scored_by_suites(cands, merged, "id", "code", "fn", "pass", 5.0).collect()}
    assert scored["c1"].predicted_pass and not scored["c2"].predicted_pass and scored["c3"].test_score == 1.0
    assert E.scored_by_suites(cands, merged, "id", "code", "fn").count() == 2


def test_audits(spark):
    df = spark.createDataFrame([("a", "train"), ("a", "test"), (None, "test")], "id string, split string")
    got = {r.check: r.violations for r in A.report([A.unique(df, "id"), A.filled(df, "id"), A.row_counts(df, "split", {"train": 1, "test": 3, "validation": 2}), A.constant(df, ["split"]), A.disjoint(df, df, "id")]).collect()}
    assert got == {"unique id": 1, "filled id": 1, "row counts split": 3, "constant": 1, "disjoint id": 1}
    with pytest.raises(A.AuditError):
        A.enforce([A.unique(df, "id")])
    A.enforce([A.column_free(df, {"test"})])


def test_rubric(spark):
    df = spark.sql("select map('a', named_struct('applicable', true, 'score', 4, 'rationale', 'r'), 'b', named_struct('applicable', false, 'score', 1, 'rationale', null), 'c', named_struct('applicable', true, 'score', 2, 'rationale', null)) m, cast(map() as map<string, struct<applicable: boolean, score: int, rationale: string>>) e")
    r = df.select(B.mean_score(F.col("m")).alias("mean"), B.least_score(F.col("m")).alias("least"), B.all_at_least(F.col("m"), 3).alias("high"), B.weighted_mean(F.col("m"), {"a": 3, "b": 9, "c": 1}).alias("w"), B.mean_score(F.col("e")).alias("none"), B.all_at_least(F.col("e"), 1).alias("no"), B.clamp_dimension(F.col("m"), "a", 2, "low", F.lit(True))["a"]["score"].alias("cl")).first()
    assert (r.mean, r.least, r.high, r.w, r.none, r.no, r.cl) == (3.0, 2.0, False, 3.5, None, False, 2)


def test_joins_with_clashing_columns(spark):
    a = spark.createDataFrame([("1", "x", 5), (None, "y", 6)], "id string, k string, v int")
    b = spark.createDataFrame([("1", "other", 9)], "id string, k string, v int")
    got = {r.k: (r.p_found, r.p_v) for r in J.lookup(a, b, "id", "p_").collect()}
    assert got == {"x": (True, 9), "y": (False, None)}
    with pytest.raises(J.MissingRows):
        J.restricted(a, b, "id", 2)
    assert J.without(a, b, "id").count() == 1
    assert {r.k: r.n for r in J.shared_results(a.unionAll(a), ["k"], lambda x: x.withColumn("n", F.length("k"))).collect()} == {"x": 1, "y": 1}


def test_judgments_are_mended():
    from lodestack.operators.judging import ambiguities, deranged, normalised

    dims = ["a", "b"]
    good = normalised('x {"dimension_scores": {"a": {"applicable": true, "score": 4}, "b": {"applicable": false}}, "critical_errors": [], "overall_score": 4, "confidence": "High"}', dims)
    assert good["predicted_pass"] and good["overall_score"] == 4 and good["confidence"] == "high" and good["repairs"] == []
    bad = normalised('{"dimension_scores": {"a": {"score": 9}, "z": {"score": 1}}, "critical_errors": ["e", "e ", "none"]}', dims)
    assert bad["overall_score"] is None and not bad["predicted_pass"] and bad["critical_errors"] == ["e"] and bad["repairs"] == ["bad_score:a", "missing:b"]
    assert normalised(None, dims)["repairs"][0] == "no_object"
    assert all(x != y for n in (2, 3, 9) for x, y in zip(range(n), deranged(list(range(n)), n))) and deranged(["a"], 1) == ["a"]
    assert ambiguities(["unclear", "whether ties keep the first row"], ("unclear",)) == (["whether ties keep the first row"], ["unclear"])


def test_bootstrap_of_auc_differences(spark):
    rng = random.Random(2)
    rows = [(y := (rng.random() < 0.5), rng.random() + y, rng.random(), None if rng.random() < 0.05 else 1.0) for _ in range(400)]
    df = spark.createDataFrame(rows, "y boolean, a double, b double, c double")
    worse = P.bootstrap_auc_difference(df, F.col("y"), F.col("a"), F.col("b"), 0.0, 2.0, 200).first()
    assert worse.high < 0 and worse.not_better == 1.0 and worse.rows == 400
    same = P.bootstrap_auc_difference(df, F.col("y"), F.col("a"), F.col("a"), 0.0, 2.0, 200).first()
    assert (same.low, same.high) == (0.0, 0.0)
    assert P.bootstrap_auc_difference(df.limit(0), F.col("y"), F.col("a"), F.col("b"), 0.0, 2.0).count() == 0


def test_token_lengths(spark):
    import os

    from lodestack.operators import tokens as K

    df = spark.createDataFrame([("a b  c",), ("",), (None,)], "t string")
    assert [r.t_tokens for r in K.with_lengths(df, ["t"]).collect()] == [3, 0, 0]
    path = "/opt/tokenizers/byte_bpe_50k.json"
    if os.path.exists(path):
        got = [r.t_tokens for r in K.with_lengths(df, ["t"], path).collect()]
        assert got[0] >= 3 and got[1:] == [0, 0]


def test_prompt_rows(spark):
    from lodestack.operators import projections as R

    apps = spark.createDataFrame([(1, "Add.", '{"fn_name": "f"}', "s"), (2, "Print.", '{"inputs": []}', None), (3, "X", None, None)], "problem_id int, question string, input_output string, solutions string")
    rows = {r.id: r for r in R.prompt_rows(apps, "apps", F.lit("train")).collect()}
    assert rows["apps/train/1"].io_mode == "function_call" and rows["apps/train/2"].io_mode == rows["apps/train/3"].io_mode == "stdin_stdout"
    assert "Read standard input" in rows["apps/train/2"].prompt and rows["apps/train/1"].prompt.endswith("Task:\nAdd.")
    assert R.prompt_rows(apps.limit(0), "apps", F.lit("t")).count() == 0


def test_documents(spark):
    from lodestack.operators import documents as D

    rows = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "y"), ("4", "z"), ("5", None)], "id string, c string")
    names = spark.createDataFrame([("x", "Big One"), ("y", "small"), ("q", "unused")], "cluster string, category string")
    got = {r.id: r.category for r in D.consolidated(rows, "c", names, "other", 2).collect()}
    assert got == {"1": "big_one", "2": "big_one", "3": "other", "4": "other", "5": "other"}
    assert {r.cluster: (r.mapped, r.used) for r in D.coverage(rows, "c", names).collect()} == {"x": (True, True), "y": (True, True), "z": (False, True), "q": (True, False)}
    cats = spark.createDataFrame([("a", 3, 2), ("b", 1, 1)], "category string, rows long, tasks long")
    doc = D.rubric(cats)
    assert D.rubric_problems(doc) == [] and doc["aggregation"]["critical"] == ["a", "b"] and doc["dimensions"][0]["weight"] == 0.75
    assert D.rubric_problems(D.rubric(cats.limit(0))) == ["no_dimensions"]
    assert "## 1" in D.packet(rows, "id", ["c"], ["l"]) and D.packet(rows, "id", ["c"], ["l"]).count("Label: ") == 5


def test_feedback(spark):
    from lodestack.operators import projections as R

    row = spark.sql("select array(named_struct('index', 0, 'passed', true, 'error', null), named_struct('index', 1, 'passed', false, 'error', 'KeyError'), named_struct('index', 2, 'passed', null, 'error', null)) r, slice(array(named_struct('index', 0, 'passed', true, 'error', 'x')), 1, 1) g")
    out = row.select(R.feedback(F.lit("f"), F.col("r"), 1), R.feedback(F.lit("f"), F.col("g"), 1)).first()
    assert out[0] == "Cases of f that fail: 2\n- case 2: KeyError" and out[1] is None


def test_joins_with_hot_keys(spark):
    rows = spark.createDataFrame([(f"r{i}", "hot" if i % 3 == 0 else f"k{i % 200}") for i in range(900)] + [("n", None)], "id string, k string")
    names = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(150)], "k string, v int")
    for how in ("left", "inner"):
        plain, dealt = rows.join(names, "k", how), J.hot_joined(rows, names, "k", F.col("id"), how)
        assert sorted(map(str, plain.select("k", "id", "v").collect())) == sorted(map(str, dealt.select("k", "id", "v").collect()))
    assert J.hot_joined(rows.limit(0), names, "k", F.col("id")).count() == 0
