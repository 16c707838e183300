"""Building rows: prompts, responses, failures, pairs and training records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestack.functions import hashing as H, text as X

#: Columns that hold answers or hidden tests and never leave in public rows.
PRIVATE = frozenset({"canonical_solution", "canonical_solutions", "test_list", "test", "test_setup_code", "input_output", "private_diagnostics"})


def public(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Without private columns; only the named ones on request."""
    cols = [c for c in (keep or df.columns) if c in df.columns and c not in PRIVATE]
    return df.select(*cols)


def response_key(response: Column, task: Column, sample: Column) -> Column:
    """The response's identifier, else ``<task>__sample<k>``."""
    return X.or_else(response, F.concat(task, F.lit("__sample"), F.coalesce(sample.cast("string"), F.lit("0"))))


def prompt(task: Column, signatures: Column | None = None, starter: Column | None = None, stdin: Column | None = None) -> Column:
    """A prompt from a task and, where there are any, its interface, starter code and input convention."""
    def part(title: str, body: Column | None) -> Column:
        return F.lit(None).cast("string") if body is None else F.when(F.length(F.trim(body)) > 0, F.concat(F.lit(title), body))

    names = None if signatures is None else F.array_join(F.transform(signatures, lambda s: F.concat(F.lit("- "), s)), "\n")
    told = None if stdin is None else F.when(stdin, F.lit("Read standard input, write standard output."))
    return F.concat_ws("\n\n", F.lit("Solve the task in Python."), part("Task:\n", task), part("Interface:\n", names), part("Starter code:\n", starter), part("", told))


def exploded_solutions(df: DataFrame, solutions: Column, task: str, most: int) -> DataFrame:
    """One response a canonical solution, the first ``most`` of each task."""
    return df.select("*", F.posexplode(F.slice(solutions, 1, most)).alias("sample_id", "generated_code")).withColumn("response_id", F.concat(F.col(task), F.lit("__canonical"), F.col("sample_id").cast("string")))


def failures(df: DataFrame) -> DataFrame:
    """Failed responses with their error pattern and a clipped error and code."""
    code = X.or_else(F.col("extracted_code"), F.col("generated_code"))
    return df.where(~F.coalesce("passed", F.lit(False))).select(
        "response_id", "id", "sample_id", "dataset", X.inferred_split(F.col("split"), F.col("id")).alias("split"), F.coalesce("failure_type", F.lit("unknown")).alias("failure_type"),
        X.error_pattern(F.col("failure_type"), F.col("error"), code, F.col("generated_code")).alias("error_pattern"), X.clipped(F.col("error"), 220).alias("error"), X.clipped(code, 300).alias("snippet"),
    )


def sft_record(row_id: Column, split: Column, kind: str, prompt_: Column, completion: Column, source: str, **metadata: Column) -> list[Column]:
    """The columns of a training record."""
    return [row_id.alias("id"), split.alias("split"), F.lit(kind).alias("task_type"), prompt_.alias("prompt"), completion.alias("completion"), F.lit(source).alias("source"), F.struct(*(c.alias(k) for k, c in metadata.items())).alias("metadata")]


def chat(prompt_: Column, style: str) -> Column:
    """A prompt in a chat frame, or as it is."""
    return prompt_ if style == "raw" else F.concat(F.lit("<|user|>\n"), prompt_, F.lit("\n<|assistant|>\n"))


def revision(findings: Column, code: Column) -> Column:
    """A critic's answer from findings and code; its two headings are a fixed format."""
    return F.concat(F.lit("ERROR_FINDINGS:\n"), F.array_join(F.transform(findings, lambda f: F.concat(F.lit("- "), f)), "\n"), F.lit("\nREVISED_CODE:\n"), X.strip(code))


def findings(text: Column, most: int, fallback: Column | None = None) -> Column:
    """The first distinct findings of a critic's answer, without bullets; with ``fallback``, an array, filled up from it."""
    head = F.split(text, r"(?im)^\s*REVISED_CODE\s*:")[0]
    lines = F.filter(F.split(F.regexp_replace(head, r"(?im)^\s*ERROR_FINDINGS\s*:", ""), "\n"), lambda x: F.trim(x) != "")
    found = F.transform(lines, lambda x: X.strip(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s*", "")))
    found = found if fallback is None else F.concat(F.coalesce(found, F.array().cast("array<string>")), fallback)
    return F.slice(F.array_distinct(found), 1, most)




def verifier_summary(failure: Column, error: Column) -> Column:
    """What may be told of a failure in public: its kind, and its exception's name without values."""
    name = F.nullif(F.regexp_extract(F.coalesce(error, F.lit("")), r"^(\w*(?:Error|Exception|Exit|Interrupt))", 1), F.lit(""))
    return F.concat_ws(": ", F.coalesce(failure, F.lit("unknown")), name)


#: Where each kind of source row has its parts.
LAYOUTS = {
    "mbpp": {"id": "task_id", "task": "text", "solution": "code", "tests": "test_list"},
    "humanevalplus": {"id": "task_id", "task": "prompt", "solution": "canonical_solution", "tests": "test"},
    "bigcodebench": {"id": "task_id", "task": "instruct_prompt", "solution": "canonical_solution", "tests": "test"},
    "apps": {"id": "problem_id", "task": "question", "solution": "solutions", "tests": "input_output"},
}


def prompt_rows(df: DataFrame, dataset: str, split: Column | None = None) -> DataFrame:
    """(id, dataset, split, io_mode, prompt, solution, tests) from the rows of a public coding benchmark; columns that are missing are null.

    Without a split, rows are dealt 80/10/10 by a hash of their key; humanevalplus has only a test split.
    """
    at = LAYOUTS[dataset]
    if split is None:
        key = F.col(at["id"]).cast("string")
        split = F.lit("test") if dataset == "humanevalplus" else H.split_by_bucket(H.bucket_sha1(key), 80, 10)
    get = lambda k: F.col(at[k]) if at[k] in df.columns else F.lit(None).cast("string")
    tests = get("tests")
    stdin = F.lit(False) if dataset != "apps" else F.coalesce(F.get_json_object(tests, "$.fn_name").isNull(), F.lit(True))
    row_id = F.concat(F.lit(f"{dataset}/"), split, F.lit("/"), get("id").cast("string"))
    return df.select(row_id.alias("id"), F.lit(dataset).alias("dataset"), split.alias("split"), F.when(stdin, "stdin_stdout").otherwise("function_call").alias("io_mode"), prompt(X.strip(get("task").cast("string")), stdin=stdin).alias("prompt"), get("solution").alias("solution"), tests.alias("tests"))


def judge_prompt(task: Column, code: Column, task_chars: int, code_chars: int, answer_first: bool = True) -> Column:
    """A request for a verdict on one answer, with both texts clipped."""
    order = "State PASS or FAIL first, then the reason." if answer_first else "Give the reason first, then PASS or FAIL."
    return F.concat(F.lit("Judge whether the program solves the task.\n" + order + "\n\nTask:\n"), X.clipped(task, task_chars, "\n[TRUNCATED]"), F.lit("\n\nProgram:\n"), X.clipped(code, code_chars, "\n[TRUNCATED]"), F.lit("\n"))


def judge_completion(passed: Column, reason: Column, answer_first: bool = True) -> Column:
    """The answer to ``judge_prompt``."""
    word, why = F.when(F.coalesce(passed, F.lit(False)), "PASS").otherwise("FAIL"), X.collapsed(F.coalesce(reason, F.lit("no reason recorded")))
    return F.concat(F.lit("Verdict: "), word, F.lit("\nReason: "), why) if answer_first else F.concat(F.lit("Reason: "), why, F.lit("\nVerdict: "), word)


def feedback(function: Column, results: Column, most: int) -> Column:
    """What failed cases say, one line each: results are structs (index, passed, error), the first ``most`` failures are shown."""
    failed = F.filter(results, lambda r: ~F.coalesce(r["passed"], F.lit(False)))
    lines = F.transform(F.slice(failed, 1, most), lambda r: F.concat(F.lit("- case "), (r["index"] + 1).cast("string"), F.lit(": "), F.coalesce(r["error"], F.lit("wrong result"))))
    head = F.concat(F.lit("Cases of "), F.coalesce(function, F.lit("the program")), F.lit(" that fail: "), F.size(failed).cast("string"))
    return F.when(F.size(failed) > 0, F.array_join(F.concat(F.array(head), lines), "\n"))


def gate_rows(failed: DataFrame, known: DataFrame, total: int, salt: str) -> DataFrame:
    """Rows that bring a held-out gate to ``total`` problems: of failed answers to problems that ``known`` (id) lacks, one a problem, in salted order of the problems; prompts without an answer."""
    pool = failed.join(known.select("id").distinct(), "id", "left_anti")
    first = pool.groupBy("id").agg(F.min_by(F.struct(*pool.columns), "response_id").alias("r")).select("r.*")
    missing = max(0, total - known.select("id").distinct().count())
    order = H.salted_order(F.col("id"), salt)
    chosen = first.orderBy(order, "id").limit(missing)
    code = X.normalize_code(X.or_else(F.col("generated_code"), F.col("extracted_code")))
    prompt_ = F.concat(F.lit("Public task prompt:\n"), F.coalesce("prompt", F.lit("")), F.lit("\n\nFailed code:\n"), code)
    return chosen.select(F.concat(F.col("id"), F.lit("__gate")).alias("id"), F.col("id").alias("problem_id"), F.lit("validation").alias("split"), F.lit("critic_repair").alias("task_type"), prompt_.alias("prompt"), F.lit("").alias("completion"), F.lit("gate_expansion").alias("source"), F.col("response_id").alias("rejected_response_id"))
