"""Running candidate programs against tests, each in a child process of its own.

A worker starts one child a program, with limits on CPU time, memory, output
and file size, an empty environment, an empty working directory and no
standard input but the test's.  Results are read while the child runs, so a
large result can't pass for a timeout; leaving by SystemExit with code 0 is a
normal end of a program that reads standard input and an error else.
"""

from __future__ import annotations

import json
import os
import re
import resource
import signal
import subprocess
import sys
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lodestack.functions import jsonfn

RESULT = T.StructType([
    T.StructField("passed", T.BooleanType()), T.StructField("failure_type", T.StringType()), T.StructField("error", T.StringType()),
    T.StructField("test_count", T.IntegerType()), T.StructField("pass_count", T.IntegerType()), T.StructField("passed_tests", T.ArrayType(T.IntegerType())), T.StructField("first_kind", T.StringType()),
])
MEMORY, OUTPUT = 512 << 20, 1 << 20

_CHILD = """
import ast, builtins, io, json, sys
job = json.loads(sys.stdin.readline())
out = sys.stdout
sys.stdin, sys.stdout = io.StringIO(""), io.StringIO()
def say(**x):
    out.write(json.dumps(x, default=str) + "\\n"); out.flush()
def told(e):
    return f"{type(e).__name__}: {e}"
def load(source, space):
    exec(compile(source, "candidate", "exec"), space)
def load_or_leave(source, space):
    try:
        program = compile(source, "candidate", "exec")
    except (SyntaxError, ValueError) as e:
        say(stage="syntax", error=str(e)); sys.exit(0)
    try:
        exec(program, space)
    except BaseException as e:
        say(stage="setup", error=told(e)); sys.exit(0)
def shape(v):
    return (type(v), len(v) if hasattr(v, "__len__") else None)
def asserts(space):
    for i, source in enumerate(job["tests"]):
        try:
            body = ast.parse(source).body
            test = body[0].test if len(body) == 1 and isinstance(body[0], ast.Assert) else None
            if isinstance(test, ast.Compare) and len(test.ops) == 1:
                a, b = (eval(compile(ast.Expression(x), "test", "eval"), space) for x in (test.left, test.comparators[0]))
                kind = "wrong_type" if type(a) is not type(b) else "wrong_length" if shape(a) != shape(b) else "wrong_value"
                say(i=i, ok=bool(a == b), kind="passed" if a == b else kind)
            else:
                load(source, space)
                say(i=i, ok=True, kind="passed")
        except AssertionError:
            say(i=i, ok=False, kind="assertion_failed")
        except BaseException as e:
            say(i=i, error=told(e), kind="exception_on_case"); return
def whole(space):
    if job["mode"] == "check":
        if job["entry"] not in space:
            say(stage="interface", error=job["entry"]); sys.exit(0)
        load(job["setup"], space)
        space["check"](space[job["entry"]])
        return
    import unittest
    load(job["setup"], space)
    case = space.get("TestCases")
    if not (isinstance(case, type) and issubclass(case, unittest.TestCase)):
        raise NameError("no unittest class TestCases")
    result = unittest.TextTestRunner(stream=io.StringIO(), verbosity=0).run(unittest.TestLoader().loadTestsFromTestCase(case))
    if not result.wasSuccessful():
        raise AssertionError((result.failures + result.errors)[0][1].strip().split("\\n")[-1])
if job["mode"] == "asserts":
    space = {"__name__": "candidate"}
    load_or_leave(job["setup"], space)
    load_or_leave(job["code"], space)
    missing = sorted(n for n in job["names"] if n not in space and not hasattr(builtins, n))
    if missing:
        say(stage="interface", error="required interface not defined: " + ", ".join(missing)); sys.exit(0)
    asserts(space)
elif job["mode"] in ("check", "unittest"):
    space = {"__name__": "candidate"}
    load_or_leave(job["code"], space)
    try:
        whole(space)
        say(i=0, ok=True, kind="passed")
    except AssertionError as e:
        say(i=0, ok=False, kind="assertion_failed", error=str(e) or "assertion failed")
    except BaseException as e:
        say(i=0, error=told(e), kind="exception_on_case")
elif job["fn"]:
    space = {"__name__": "candidate"}
    load_or_leave(job["code"], space)
    solution, free = space.get("Solution"), space.get(job["fn"])
    owned = isinstance(solution, type) and hasattr(solution, job["fn"])
    if not owned and not callable(free):
        say(stage="interface", error=job["fn"]); sys.exit(0)
    for i, case in enumerate(job["tests"]):
        try:
            say(i=i, value=(getattr(solution(), job["fn"]) if owned else free)(*case["args"]))
        except BaseException as e:
            say(i=i, error=told(e))
            if job["first_only"]:
                break
else:
    try:
        program = compile(job["code"], "candidate", "exec")
    except (SyntaxError, ValueError) as e:
        say(stage="syntax", error=str(e)); sys.exit(0)
    for i, case in enumerate(job["tests"]):
        sys.stdin, sys.stdout = io.StringIO(str(case["args"][0]) if case["args"] else ""), io.StringIO()
        try:
            exec(program, {"__name__": "__main__"})
            say(i=i, value=sys.stdout.getvalue())
        except SystemExit as e:
            say(i=i, value=sys.stdout.getvalue()) if not e.code else say(i=i, error=f"SystemExit: {e.code}")
        except BaseException as e:
            say(i=i, error=told(e))
            if job["first_only"]:
                break
say(stage="end")
"""


def _limits(seconds: float):
    def apply() -> None:
        os.setsid()
        resource.setrlimit(resource.RLIMIT_CPU, (int(seconds) + 1, int(seconds) + 2))
        resource.setrlimit(resource.RLIMIT_AS, (MEMORY, MEMORY))
        resource.setrlimit(resource.RLIMIT_FSIZE, (OUTPUT, OUTPUT))
        resource.setrlimit(resource.RLIMIT_CORE, (0, 0))

    return apply


def _run(job: dict, timeout: float) -> tuple[list[dict], bool]:
    """What a child says about a job, and whether it had to be ended."""
    with tempfile.TemporaryDirectory() as d:
        child = subprocess.Popen([sys.executable, "-I", "-S", "-c", _CHILD], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, cwd=d, env={}, preexec_fn=_limits(timeout))
        try:
            text, _ = child.communicate((json.dumps(job, default=str) + "\n").encode(), timeout=timeout)
            late = False
        except subprocess.TimeoutExpired:
            os.killpg(child.pid, signal.SIGKILL)
            text, _ = child.communicate()
            late = True
    return [x for line in text[:OUTPUT].decode(errors="replace").split("\n") if isinstance(x := jsonfn.load(line) if line.strip() else None, dict)], late


def _blank(tests: int) -> dict:
    return dict(passed=False, failure_type=None, error=None, test_count=tests, pass_count=0, passed_tests=[], first_kind=None)


def _stopped(out: dict, said: list[dict]) -> dict | None:
    """The result of a program that didn't get to its tests; None if it did."""
    stage = next((x for x in said if "stage" in x), {})
    if stage.get("stage") not in ("syntax", "setup", "interface"):
        return None
    kind = "syntax_error" if stage["stage"] == "syntax" else "runtime_error"
    return out | dict(failure_type=kind, error=stage["error"], first_kind="missing_required_interface" if stage["stage"] == "interface" else None)


def run_tests(code: str | None, fn: str | None, tests: list[dict], timeout: float = 5.0, first_only: bool = False) -> dict:
    """The fields of RESULT for one program; ``tests`` are {args, expected}; without ``fn`` the program reads standard input; ``first_only`` ends with the first test that fails."""
    out = _blank(len(tests))
    if not (code or "").strip():
        return out | dict(failure_type="generation_failure", error="empty")
    said, late = _run({"mode": "cases", "code": code, "fn": fn or "", "first_only": first_only, "tests": [{"args": t.get("args") or []} for t in tests]}, timeout)
    if (stopped := _stopped(out, said)) is not None:
        return stopped
    got = {x["i"]: x for x in said if "i" in x}
    for i, t in enumerate(tests):
        x = got.get(i)
        if x is None:
            out |= dict(failure_type=out["failure_type"] or ("timeout" if late else "runtime_error"), error=out["error"] or (f">{timeout}s" if late else "no result"))
            break
        kind = "equal"
        if "error" in x:
            out |= dict(failure_type=out["failure_type"] or "runtime_error", error=out["error"] or x["error"], first_kind=out["first_kind"] or "exception_on_case")
            kind = "exception_on_case"
        elif fn:
            kind = jsonfn.difference(x["value"], t.get("expected"))
        elif str(x["value"]).split() != str(t.get("expected") or "").split():
            kind = "wrong_value"
        if kind == "equal":
            out["passed_tests"].append(i)
        elif kind != "exception_on_case":
            out |= dict(failure_type=out["failure_type"] or "logic_error", error=out["error"] or "assertion failed", first_kind=out["first_kind"] or kind)
        if kind != "equal" and first_only:
            break
    out["pass_count"] = len(out["passed_tests"])
    out["passed"] = bool(tests) and out["pass_count"] == len(tests)
    return out


def _of_said(out: dict, said: list[dict], late: bool, timeout: float, tests: int) -> dict:
    """The result of tests that the child judges itself."""
    if (stopped := _stopped(out, said)) is not None:
        return stopped
    for x in said:
        if "i" not in x:
            continue
        if x.get("ok"):
            out["passed_tests"].append(x["i"])
        else:
            raised = x["kind"] == "exception_on_case"
            out |= dict(failure_type=out["failure_type"] or ("runtime_error" if raised else "logic_error"), error=out["error"] or x.get("error") or "assertion failed", first_kind=out["first_kind"] or x["kind"])
    if not any(x.get("stage") == "end" for x in said):
        out |= dict(failure_type="timeout" if late else "runtime_error", error=f">{timeout}s" if late else "no result")
    out["pass_count"] = len(out["passed_tests"])
    out["passed"] = tests > 0 and out["pass_count"] == tests
    return out


def run_asserts(code: str | None, asserts: list[str], setup: str | None = None, names: list[str] | None = None, timeout: float = 5.0) -> dict:
    """As ``run_tests`` for tests given as statements: comparisons tell how the values differ, all are tried unless one raises."""
    if not (code or "").strip():
        return _blank(len(asserts)) | dict(failure_type="generation_failure", error="empty")
    said, late = _run({"mode": "asserts", "code": code, "setup": setup or "", "names": names or [], "tests": asserts}, timeout)
    return _of_said(_blank(len(asserts)), said, late, timeout, len(asserts))


def run_whole(sources: list[str], test: str, entry: str | None = None, timeout: float = 5.0) -> dict:
    """As ``run_tests`` for one test source: a function ``check(candidate)`` with ``entry``, else a unittest class TestCases.  The sources are tried in turn until one passes; else the first one's result counts."""
    first = None
    for code in sources:
        if not (code or "").strip():
            continue
        said, late = _run({"mode": "check" if entry else "unittest", "code": code, "setup": test, "entry": entry or ""}, timeout)
        got = _of_said(_blank(1), said, late, timeout, 1)
        if got["passed"]:
            return got
        first = first or got
    return first or _blank(1) | dict(failure_type="generation_failure", error="empty")


def sources_of(code: str | None, starter: str | None, names: list[str] | None = None) -> list[str]:
    """A program by itself and, where it defines none of the names and doesn't start with it, behind its starter code."""
    code, starter = code or "", (starter or "").rstrip()
    defined = any(re.search(rf"\bdef\s+{re.escape(n)}\s*\(", code) for n in names or [])
    return [code] if not starter.strip() or defined or code.lstrip().startswith(starter.lstrip()) else [code, f"{starter}\n{code}"]


def run_job(job: dict, timeout: float = 5.0) -> dict:
    """The result of a job in the form of its dataset: {dataset, code, ...} with asserts (mbpp), check (humanevalplus), unittest (bigcodebench) or cases (all others)."""
    kind, code, names = job.get("dataset"), job.get("code"), job.get("names") or []
    if kind == "mbpp":
        return run_asserts(code, job.get("asserts") or [], job.get("setup"), names, timeout)
    if kind in ("humanevalplus", "bigcodebench"):
        return run_whole(sources_of(code, job.get("starter"), names), job.get("test") or "", job.get("entry") if kind == "humanevalplus" else None, timeout)
    tests = job.get("tests") or []
    first = None
    for source in sources_of(code, job.get("starter"), names):
        got = run_tests(source, job.get("fn"), tests, timeout, first_only=True)
        if got["passed"]:
            return got
        first = first or got
    return first or _blank(len(tests))


def _distinct_runs(df: DataFrame, job: Column, run_one, name: str) -> DataFrame:
    """``df`` with the RESULT of each row's job, a JSON text: every distinct job runs once and fans back to its rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"_key": pdf["_key"], name: [run_one(jsonfn.load(j) or {}) for j in pdf["_job"]]})

    keyed = df.withColumn("_job", job).withColumn("_key", F.sha2("_job", 256))
    once = keyed.groupBy("_key").agg(F.first("_job").alias("_job"))
    schema = T.StructType([T.StructField("_key", T.StringType()), T.StructField(name, RESULT)])
    # programs differ widely in time: small, even partitions
    spread = once.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, "_key")
    return keyed.drop("_job").join(spread.mapInPandas(run, schema), "_key").drop("_key")


def adapted(df: DataFrame, fields: dict[str, Column], timeout: float = 5.0, name: str = "run") -> DataFrame:
    """``df`` with the RESULT of each row's job of ``run_job``; ``fields`` are its columns, ``tests`` an array of {args, expected} with JSON texts in it."""
    def one(job: dict) -> dict:
        if isinstance(job.get("tests"), list):
            job["tests"] = [{"args": [jsonfn.load(a) for a in t.get("args") or []], "expected": jsonfn.load(t["expected"]) if t.get("expected") is not None else None} for t in job["tests"]]
        return run_job(job, timeout)

    return _distinct_runs(df, F.to_json(F.struct(*(c.alias(k) for k, c in fields.items()))), one, name)


def verified(df: DataFrame, code: str, fn: str, tests: str, timeout: float = 5.0, name: str = "run") -> DataFrame:
    """``df`` with the RESULT of each row: every distinct (code, function, tests) runs once and fans back to its rows.

    ``tests`` holds JSON: a list of {args, expected}.  Null code is empty; null
    or unreadable tests are none, which nothing passes.
    """
    def one(job: dict) -> dict:
        tests_ = jsonfn.load(job.get("tests") or "null")
        return run_tests(job.get("code"), job.get("fn"), tests_ if isinstance(tests_, list) else [], timeout)

    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return _distinct_runs(df, F.to_json(F.struct(blank(code).alias("code"), blank(fn).alias("fn"), blank(tests).alias("tests"))), one, name)


def _elements(tests: Column) -> Column:
    """The elements of a JSON list as JSON texts; none for anything else."""
    return F.coalesce(F.transform(F.from_json(tests, "array<variant>"), lambda v: F.to_json(v)), F.array().cast("array<string>"))


def gated_suites(suites: DataFrame, canonical: str, failed: str, fn: str, tests: str, least: int = 1, timeout: float = 5.0) -> DataFrame:
    """``suites`` with the tests that the canonical program passes, and whether they form a suite: ``least`` tests that the failed program doesn't all pass."""
    good = verified(suites, canonical, fn, tests, timeout, "_good")
    passed = F.filter(_elements(F.col(tests)), lambda x, i: F.array_contains("_good.passed_tests", i))
    kept = good.withColumn("kept_tests", F.concat(F.lit("["), F.array_join(passed, ","), F.lit("]")))
    bad = verified(kept, failed, fn, "kept_tests", timeout, "_bad")
    n = F.col("_good.pass_count")
    return bad.withColumn("kept", n).withColumn("quality_gate_passed", (n >= least) & ~F.col("_bad.passed")).drop("_good", "_bad")


def merged_suites(suites: DataFrame, problem: str, tests: str, rank: list[Column] | None = None, aggregation: str = "union") -> DataFrame:
    """(problem, tests, test_count, suites) of each problem: the tests of its best suite, or the distinct tests of all, those of the best suite first.

    The best suite is the first by ``rank``, else the one with the most tests;
    equal tests (as canonical JSON) keep their first place.
    """
    order = rank or [F.desc("_n"), F.asc("_text")]
    listed = suites.where(F.col(problem).isNotNull()).withColumn("_tests", _elements(F.col(tests))).withColumn("_n", F.size("_tests")).withColumn("_text", F.col(tests))
    ranked = listed.withColumn("_rank", F.row_number().over(Window.partitionBy(problem).orderBy(*order)))  # a problem's few suites
    n = ranked.groupBy(F.col(problem).alias("_p")).agg(F.count("*").alias("suites"))
    used = ranked if aggregation == "union" else ranked.where("_rank = 1")
    each = used.select(problem, "_rank", F.posexplode("_tests").alias("_at", "_test"))
    once = each.groupBy(problem, jsonfn.canonical_text("_test").alias("_key")).agg(F.min(F.struct("_rank", "_at", "_test")).alias("_first"))
    texts = F.transform(F.array_sort(F.collect_list("_first")), lambda x: x["_test"])  # one problem's tests
    joined = once.groupBy(problem).agg(F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")).alias("tests"), F.count("*").alias("test_count"))
    return joined.join(n, F.col(problem) == F.col("_p")).drop("_p")


def scored_by_suites(candidates: DataFrame, suites: DataFrame, problem: str, code: str, fn: str, missing: str = "skip", timeout: float = 5.0, empty: str = "fail") -> DataFrame:
    """Candidates with test_count, pass_count, test_score, predicted_pass and status; ``missing`` says what a problem without a suite means (skip, pass or fail), ``empty`` what a candidate without code means (skip or fail)."""
    s = suites.select(F.col(problem).alias("_p"), F.col("tests").alias("_tests"))
    joined = candidates.join(s, F.col(problem) == F.col("_p"), "inner" if missing == "skip" else "left").drop("_p")
    blank = F.length(F.trim(F.coalesce(F.col(code), F.lit("")))) == 0
    joined = joined.where(~blank) if empty == "skip" else joined
    run = verified(joined, code, fn, "_tests", timeout)
    none, total = F.col("_tests").isNull() & ~blank, F.when(blank, 0).otherwise(F.col("run.test_count"))
    assumed = F.lit(1.0 if missing == "pass" else 0.0)
    return run.select(
        *candidates.columns, total.alias("test_count"), F.col("run.pass_count").alias("pass_count"),
        F.when(none, assumed).when(total > 0, F.col("run.pass_count") / F.nullif(total, F.lit(0))).otherwise(0.0).alias("test_score"),
        F.when(none, F.lit(missing == "pass")).otherwise(F.col("run.passed")).alias("predicted_pass"),
        F.when(blank, "empty_candidate_code").when(none, "no_suite").otherwise("scored").alias("status"),
    )


def quality_tier(passed: Column, predicted: Column, score: Column, suite: Column, tests: Column, least: float = 0.0, predicted_too: bool = True) -> Column:
    """(tier, reason) of a scored candidate: strict_rubric with a suite behind it, verifier_pass without, null with the reason of its reject."""
    lacks = [
        (~F.coalesce(passed, F.lit(False)), "not_verifier_passed"), (F.lit(predicted_too) & ~F.coalesce(predicted, F.lit(False)), "not_predicted_pass_by_tests"), (F.coalesce(F.nanvl(score, F.lit(0.0)), F.lit(0.0)) < least, "test_score_too_low"),
    ]
    reason = F.coalesce(*(F.when(c, F.lit(r)) for c, r in lacks))
    strict = F.coalesce(suite, F.lit("")) != F.lit("")
    tier = F.when(strict & (F.coalesce(tests, F.lit(0)) > 0), "strict_rubric").otherwise("verifier_pass")
    return F.struct(F.when(reason.isNull(), tier).alias("tier"), reason.alias("reason"))


def suite_filter(suite: Column, predicted: Column, which: str = "all", predicted_only: bool = False) -> Column:
    """Whether a candidate takes part: all, those with_suite or those with no_suite; of these, all or only predicted passes."""
    has = F.coalesce(suite, F.lit("")) != ""
    kept = {"all": F.lit(True), "with_suite": has, "no_suite": ~has}[which]
    return kept & (F.coalesce(predicted, F.lit(False)) if predicted_only else F.lit(True))
