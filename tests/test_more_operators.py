"""Adapters, suites, judgments with probes, and further text functions, on small fixtures."""

import json

from pyspark.sql import functions as F

from lodestack.functions import jsonfn, pyast, text as T
from lodestack.operators import documents as D, execute as E, filters as W, judging as JU, prompts as R, scoring as S, taxonomy as L

UNIT = "import unittest\nclass TestCases(unittest.TestCase):\n    def test_a(self):\n        self.assertEqual(f(1), 2)"
CHECK = "def check(c):\n    assert c(1) == 2"


def test_asserts_by_kind():
    got = E.run_asserts("def f(a):\n    return [a]", ["assert f(1) == [1]", "assert f(1) == [1, 2]", "assert f(1) == 1", "assert f(2) == [3]", "assert not f(1)"], names=["f"])
    assert (got["passed"], got["failure_type"], got["test_count"], got["passed_tests"], got["first_kind"]) == (False, "logic_error", 5, [0], "wrong_length")
    missing = E.run_asserts("def g(a):\n    return a", ["assert f(1)"], names=["f", "len"])
    assert missing["first_kind"] == "missing_required_interface" and missing["error"].endswith(": f")
    raised = E.run_asserts("def f(a):\n    return 1 / 0", ["assert f(1) == 1", "assert f(2) == 1"], setup="x = 1")
    assert (raised["failure_type"], raised["first_kind"], raised["pass_count"]) == ("runtime_error", "exception_on_case", 0)
    assert E.run_asserts(" ", ["assert f(1)"])["failure_type"] == "generation_failure" and E.run_asserts("def f(:", ["assert f(1)"])["failure_type"] == "syntax_error"
    assert E.run_asserts("def f(a):\n    return a", ["assert f(1) == 1"])["passed"] and not E.run_asserts("x = 1", [])["passed"]


def test_whole_tests_and_alternate_sources():
    assert E.run_whole(E.sources_of("    return a + 1", "def f(a):", ["f"]), CHECK, "f")["passed"]
    assert E.sources_of("def f(a):\n    return a", "def f(a):", ["f"]) == ["def f(a):\n    return a"] and E.sources_of(None, None) == [""]
    assert E.run_whole(["def f(a):\n    return a + 1"], UNIT)["passed"] and E.run_whole(["def f(a):\n    return a"], UNIT)["failure_type"] == "logic_error"
    assert E.run_whole(["def g(a):\n    return a"], CHECK, "f")["first_kind"] == "missing_required_interface" and E.run_whole([], CHECK)["failure_type"] == "generation_failure"
    assert E.run_whole(["while True: pass"], UNIT, timeout=1.0)["failure_type"] == "timeout"


def test_cases_end_with_the_first_failure_and_methods_come_first():
    both = "class Solution:\n    def f(self, a):\n        return a\ndef f(a):\n    return -1"
    assert E.run_tests(both, "f", [{"args": [1], "expected": 1}])["passed"]
    tests = [{"args": [1], "expected": 5}, {"args": [1], "expected": 1}]
    assert E.run_tests(both, "f", tests)["pass_count"] == 1 and E.run_tests(both, "f", tests, first_only=True)["pass_count"] == 0


def test_jobs_in_the_form_of_their_dataset(spark):
    rows = [("a", "mbpp", "def f(a):\n    return a", ["assert f(1) == 1"], None, None, None), ("b", "humanevalplus", "    return a + 1", None, CHECK, "f", "def f(a):"), ("c", "bigcodebench", "def f(a):\n    return 2", None, UNIT, None, None), ("d", "apps", "print(input())", None, None, None, None), ("e", "mbpp", None, None, None, None, None)]
    df = spark.createDataFrame(rows + rows[:1], "id string, dataset string, code string, asserts array<string>, test string, entry string, starter string")
    tests = F.when(F.col("dataset") == "apps", F.array(F.struct(F.array(F.lit('"7"')).alias("args"), F.lit('"7"').alias("expected"))))
    fields = {c: F.col(c) for c in ("dataset", "code", "asserts", "test", "entry", "starter")} | {"tests": tests, "names": F.array(F.lit("f"))}
    got = [(r.id, r.run.passed) for r in E.adapted(df, fields).orderBy("id").collect()]
    assert got == [("a", True), ("a", True), ("b", True), ("c", True), ("d", True), ("e", False)]
    assert E.adapted(df.limit(0), fields).count() == 0


def test_suites_keep_their_order(spark):
    t = lambda *xs: json.dumps([{"args": [x], "expected": x} for x in xs])
    rows = [("p", "s1", t(5, 1)), ("p", "s2", t(3, 1, 4)), ("p", "s3", '[{"expected": 3, "args": [3]}, {"args": [9], "expected": 9}]'), ("q", "s4", None), (None, "s5", t(1)), ("r", "s6", "[]")]
    df = spark.createDataFrame(rows, "problem string, suite string, cases string")
    union = {r.problem: [x["expected"] for x in json.loads(r.tests)] for r in E.merged_suites(df, "problem", "cases", [F.desc("_n"), F.asc("suite")]).collect()}
    best = {r.problem: [x["expected"] for x in json.loads(r.tests)] for r in E.merged_suites(df, "problem", "cases", [F.desc("_n"), F.asc("suite")], "best").collect()}
    assert union == {"p": [3, 1, 4, 5, 9]} and best == {"p": [3, 1, 4]}
    c = spark.createDataFrame([("p", "a", "def f(x):\n    return x", "f"), ("p", "b", " ", "f"), ("z", "c", "def f(x):\n    return x", "f"), ("p", "d", None, "f")], "problem string, id string, code string, fn string")
    suites = E.merged_suites(df, "problem", "cases")
    got = {r.id: (r.status, r.test_score, r.predicted_pass) for r in E.scored_by_suites(c, suites, "problem", "code", "fn", "pass").collect()}
    assert got == {"a": ("scored", 1.0, True), "b": ("empty_candidate_code", 0.0, False), "c": ("no_suite", 1.0, True), "d": ("empty_candidate_code", 0.0, False)}
    assert {r.id for r in E.scored_by_suites(c, suites, "problem", "code", "fn", "skip", empty="skip").collect()} == {"a"}


def test_quality_tiers(spark):
    rows = [("a", True, True, 1.0, "s", 3), ("b", True, True, 1.0, None, 3), ("c", True, True, 1.0, "s", 0), ("d", False, True, 1.0, "s", 3), ("e", True, False, 1.0, "s", 3), ("f", True, True, float("nan"), "s", 3), ("g", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id string, passed boolean, predicted boolean, score double, suite string, n int")
    tier = E.quality_tier(F.col("passed"), F.col("predicted"), F.col("score"), F.col("suite"), F.col("n"), 0.5)
    got = {r.id: (r.t.tier, r.t.reason) for r in df.select("id", tier.alias("t")).collect()}
    assert got == {"a": ("strict_rubric", None), "b": ("verifier_pass", None), "c": ("verifier_pass", None), "d": (None, "not_verifier_passed"), "e": (None, "not_predicted_pass_by_tests"), "f": (None, "test_score_too_low"), "g": (None, "not_verifier_passed")}
    kept = df.where(E.suite_filter(F.col("suite"), F.col("predicted"), "no_suite", True))
    assert {r.id for r in kept.collect()} == {"b"}


def _raw(**more):
    scores = {d: {"applicable": True, "score": 5} for d in ("numeric_formula_arithmetic_error", "edge_case_handling")}
    return json.dumps({"dimension_scores": scores, "critical_errors": [], "overall_score": 5, "confidence": "high"} | more)


PROBES = [{"kind": k, "input": "1", "expected_behavior": "gives 1", "observed_behavior": "the branch returns the value 1 at once", "consistent": True} for k in JU.PROBES]


def test_judgments_with_probes_ambiguities_and_execution():
    dims = ["numeric_formula_arithmetic_error", "edge_case_handling"]
    assert JU.normalised(_raw(test_probes=PROBES), dims, need_probes=True, strict_probes=True)["predicted_pass"]
    bare = JU.normalised(_raw(), dims, need_probes=True)
    assert not bare["predicted_pass"] and bare["overall_score"] == 3 and "probe:probes:0" in bare["repairs"]
    wrong = JU.normalised(_raw(test_probes=[*PROBES[:2], PROBES[2] | {"consistent": False, "affected_dimensions": ["edge_case_handling", "other"]}]), dims)
    assert wrong["dimension_scores"]["edge_case_handling"]["score"] == 2 and wrong["error_details"][0]["severity"] == "major" and not wrong["predicted_pass"]
    weak = [p | {"observed_behavior": p["expected_behavior"]} for p in PROBES]
    assert "probe:0:repeats_expected" in JU.normalised(_raw(test_probes=weak), dims, need_probes=True, strict_probes=True)["repairs"]
    unclear = JU.normalised(_raw(specification={"core_rule": "add", "material_ambiguities": ["unclear", "whether ties keep the first row"]}), dims)
    assert "ambiguities:1" in unclear["repairs"] and unclear["overall_score"] == 3
    failed = JU.normalised(_raw(), dims, verified={"passed": False, "failure_type": "logic_error", "error": "assertion failed"})
    assert failed["dimension_scores"]["numeric_formula_arithmetic_error"]["score"] == 2 and failed["dimension_scores"]["edge_case_handling"]["score"] == 3 and not failed["predicted_pass"]
    assert JU.normalised(_raw(), dims, verified={"passed": True})["predicted_pass"]
    assert JU.normalised(None, dims, fallback={"edge_case_handling": 4})["overall_score"] == 4
    odd = JU.normalised(_raw(critical_errors=[{"dimension_id": "edge_case_handling", "severity": "minor", "evidence": "x"}, {"dimension_id": "none", "severity": "fatal"}]), dims)
    assert odd["predicted_pass"] and not JU.normalised(_raw(critical_errors=[{"dimension_id": "edge_case_handling", "severity": "minor", "evidence": "x"}]), dims, decision="strict")["predicted_pass"]


def test_error_patterns_with_diagnostics(spark):
    rows = [("logic_error", None, "wrong_output", "wrong_type"), ("logic_error", None, None, None), ("logic_error", None, "wrong_output", "assertion_failed"), ("runtime_error", "x TypeError: KeyError", "exception_on_case", None), ("runtime_error", "KeyError then TypeError", None, None), ("runtime_error", None, "missing_required_interface", None), ("runtime_error", None, None, None), (None, "e", None, None), ("syntax_error", "invalid syntax", None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, f string, e string, d string, k string")
    got = [r.p for r in df.orderBy("i").select(T.error_pattern(F.col("f"), F.col("e"), F.lit("def f(): return g() def g(): pass"), F.lit("```"), F.col("d"), F.col("k")).alias("p")).collect()]
    assert got == ["logic_wrong_output_type", "logic_wrong_output", "logic_wrong_output", "runtime_exception_on_test_case", "runtime_type_error", "runtime_missing_required_interface", "runtime_other_exception", "unknown_failure", "syntax_duplicate_function_after_return"]


def test_names_labels_and_categories(spark):
    df = spark.createDataFrame([("Confidence: HIGH\nPrimary error: off_by_one", "Task\nThe evaluator calls:\nf, g\n\nEnd", ["def h(a):", "k", "class C:", "a b", None]), (None, None, None), ("verdict: pass", "", [])], "t string, p string, s array<string>")
    got = df.select(T.confidence(F.col("t")), T.primary_error(F.col("t")), T.called_names(F.col("p")), T.interface_names(F.col("s")), T.phrases_in(F.col("t"), ("error", "high", "low"))).collect()
    assert tuple(got[0]) == ("high", "off_by_one", ["f", "g"], ["C", "h", "k"], ["error", "high"]) and tuple(got[1])[:3] == (None, None, []) and got[2][3] == []
    label = spark.createDataFrame([(1, False, "length", "logic_error", True, True), (2, False, "stop", "timeout", True, True), (3, False, "stop", "logic_error", False, True), (4, False, None, "logic_error", True, False), (5, True, "length", None, True, True), (6, False, "stop", "logic_error", True, None)], "i int, ok boolean, fin string, f string, parse boolean, iface boolean")
    out = {r.i: r.l and r.l.label for r in label.select("i", T.deterministic_label(*(F.col(c) for c in ("ok", "fin", "f", "parse", "iface"))).alias("l")).collect()}
    assert out == {1: "truncation_or_overgeneration", 2: "runtime_exception_or_timeout", 3: "syntax_or_parse_error", 4: "interface_contract_error", 5: None, 6: None}
    texts = ["Syntax duplicate", "syntax error", "NameError x", "timeout", "empty list", "tuple shape", "other", None]
    cats = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.category_of(F.col("t"))).collect()]
    assert cats == ["format_or_duplicate_code_output", "syntax_parseability_or_truncation", "interface_name_signature_mismatch", "termination_or_complexity_control", "edge_case_boundary_handling", "output_type_container_shape", "algorithmic_wrong_value", "algorithmic_wrong_value"]


def test_prefixes_and_harness():
    assert pyast.parseable_prefix("x = 1\ny = (\nz = 2") == "x = 1" and pyast.parseable_prefix("(") == "" and pyast.parseable_prefix("try:\n    a\n    b\nc = 1") == ""
    assert pyast.parseable_prefix("a = 1\n" * 20_000 + "b = (") == ("a = 1\n" * 20_000).rstrip()
    code = "def f(a):\n    return a\ndef test_f():\n    assert f(1)\ndef main():\n    test_f()\nmain()"
    assert pyast.without_harness(code) == "def f(a):\n    return a" and "def main" in pyast.without_harness("def main():\n    pass\nmain()")
    got = pyast.revised_code("x\nREVISED_CODE:\nPython code:\ndef f():\n    return 1\nHere is why")
    assert got["code"] == "def f():\n    return 1" and "prose_cut" in got["notes"]


def test_suites_in_models_answers():
    whole = 'Sure:\n```json\n{"fn_name": "f", "tests": [{"args": [1], "expected": 2}, {"input": 3, "output": 4}, {"args": [1], "expected": 2}, {"args": [1]}, 7]}\n```'
    got = jsonfn.suite_of(whole)
    assert got == {"fn_name": "f", "tests": [{"args": [1], "expected": 2}, {"args": [3], "expected": 4}], "status": "suite"}
    cut = jsonfn.suite_of(whole[: whole.index('{"args": [1]}')])
    assert cut["status"] == "recovered" and cut["fn_name"] == "f" and len(cut["tests"]) == 2
    assert jsonfn.suite_of(None) == {"fn_name": "", "tests": [], "status": "no_tests"} == jsonfn.suite_of("no json {")
    assert jsonfn.suite_of("{'cases': [{'args': (1,), 'expected': None}]}")["tests"] == [{"args": [(1,)], "expected": None}]


def test_categories_anchors_and_rubrics():
    assert [c["id"] for c in jsonfn.candidates_of(['{"categories": [{"id": "a"}, {"x": 1}]}', 'text {"id": "b"}', None, "[]"])] == ["a", "b"]
    assert jsonfn.anchors_of({1: " one ", "2": ""}, {"1": "x", "2": "y"}) == ({"1": "one", "2": "y"}, ["2"]) and jsonfn.anchors_of(None, {"1": "x"})[1] == ["1"]
    assert jsonfn.listed("a", ["a", "b", "c"], 2) == ["a", "b"] and jsonfn.listed([" x ", "x", ""], []) == ["x"]
    anchors = {k: f"level {k}" for k in "12345"}
    taxonomy = {"categories": [{"id": "a", "rows": 3, "refined_rubric": {"score_anchors": anchors, "definition": "d"}}, {"id": "b", "rows": 1}]}
    assert D.taxonomy_faults(taxonomy) == ["anchors:b"] and D.taxonomy_faults({}) == ["no_categories"]
    doc = D.rubric_from_taxonomy(taxonomy, {"dimensions": [{"id": "b", "anchors": {"1": "mine"}}, {"id": "z"}]})
    assert D.rubric_problems(doc) == [] and doc["dimensions"][1]["anchors"]["1"] == "mine" and "refused:z" in doc["audit"] and doc["aggregation"]["critical"] == ["a", "b"]
    assert R.compact_rubric(doc)["dimensions"][0]["anchors"] == anchors and R.compact_examples([{"passed": True, "text": "x" * 999}], 1, 10) == [{"text": "x" * 7 + "..."}]
    for kind, n in (("auto", 2), ("generic", 1), ("random", 2)):
        made = S.static_rubric(kind, ["a", "b"])
        assert len(made["dimensions"]) == n and abs(sum(d["weight"] for d in made["dimensions"]) - 1) < 1e-3 and D.rubric_problems(made) == []
    assert "rejected (short)" in R.refinement_prompt({"id": "a", "examples": ["x"]}, {"id": "a"}, ["short"]) and "- a (3 failures): x" in R.consolidation_prompt([{"name": "a", "rows": 3, "examples": ["x"]}], 2, 4)


def test_filters(spark):
    df = spark.createDataFrame([("train",), ("apps/train",), ("x_train",), ("a/train/b",), ("test",), ("training",), (None,)], "s string")
    assert [r[0] for r in df.select(W.from_training(F.col("s"))).collect()] == [True, True, True, True, False, False, False]
    kinds = spark.createDataFrame([("train", "a"), ("train", "b"), ("test", "b"), (None, "a")], "s string, k string")
    assert [r[0] for r in kinds.select(W.task_type_allowed(F.col("s"), F.col("k"), ("a",), ("b",))).collect()] == [True, False, True, False]
    assert kinds.where(W.of_category(F.col("k"), "a")).count() == 2 and kinds.where(W.of_category(F.col("k"), None)).count() == 4


def test_scores_without_a_judge(spark):
    df = spark.createDataFrame([("def f(a):\n    return re.sub('a', 'b', a)", True, ["f"]), ("pass", True, None), (None, None, ["f"])], "c string, p boolean, n array<string>")
    got = df.select(S.code_checks(F.col("c"), F.col("p"), F.col("n")).alias("k")).select("k.*", S.fallback_scores(F.col("k"), ["runtime_api_type_misuse", "edge"]).alias("s")).collect()
    assert [(r.parse_ok, r.interface_ok, r.missing_dep, r.stub) for r in got] == [(True, True, True, False), (True, True, False, True), (False, False, False, False)]
    assert [r.s for r in got] == [{"runtime_api_type_misuse": 2, "edge": 4}, {"runtime_api_type_misuse": 4, "edge": 1}, {"runtime_api_type_misuse": 2, "edge": 2}]
    one = spark.range(1).select(S.deterministic_score({"fence": F.lit(True)}, F.lit(False), F.lit("logic_error")).alias("s")).first().s
    assert one.scores["code_only_response_discipline"] == 2 and one.overall == 3.0 and not one.predicted_pass and one.reasons[-1].endswith("logic_error")


def test_categories_are_split_and_merged(spark):
    rows = [("a", "p")] * 6 + [("a", "q")] * 4 + [("b", "p")] * 3 + [("c", None)] * 2 + [(None, "p")]
    df = spark.createDataFrame(rows, "c string, p string")
    out = {r["operational"]: r["count"] for r in L.resized_categories(df, "c", "p", 1, 3).groupBy("operational").count().collect()}
    assert out == {"a__p": 6, "a__q": 4, "other": 6} and L.resized_categories(df.limit(0), "c", "p", 1, 3).count() == 0
    names = L.named_clusters(spark.createDataFrame([("x", "stale cache cache value"), ("x", "stale cache again"), ("y", None), ("z", "wrong index value")], "k string, t string"), "k", "t", 2)
    assert {r.cluster: r.name for r in names.collect()}["x"] == "discovered_cache_stale" and {r.cluster: r.name for r in names.collect()}["y"] == "unlabeled"
    c = spark.createDataFrame([("k", "1", "the loop stops one step before the end of it", "off by one errors here", "all other errors here", "check the last index used"), ("k", "2", "various issues", None, "x", "expected_output shown")], "cat string, id string, a string, b string, c string, d string")
    best = L.best_definitions(c, "cat", "id", {"definition": F.col("a"), "include": F.col("b"), "exclude": F.col("c"), "checks": F.col("d")}).collect()
    assert [(r.id, r.quality.score, r.accepted) for r in best] == [("1", 100, True)]
