"""Requests to models and people as columns: repairs, judgments, tests, summaries, reviews."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, functions as F

from lodestack.functions import text as X
from lodestack.operators.projections import revision

#: What a private judge must not see of a row.
HIDDEN = ("passed", "failure_type", "error", "canonical_solution", "input_output", "tests")


def _lines(*parts: str | Column | None) -> Column:
    return F.concat_ws("\n", *(F.lit(p) if isinstance(p, str) else p for p in parts if p is not None))


def _block(title: str, body: Column) -> Column:
    return F.concat(F.lit(f"\n{title}:\n"), F.coalesce(body, F.lit("")))


def interface_text(names: Column) -> Column:
    """An interface, one name a line; a program that reads standard input where there is none."""
    return F.when(F.size(F.coalesce(names, F.array().cast("array<string>"))) > 0, F.array_join(names, "\n")).otherwise("stdin/stdout program")


def repair_prompt(task: Column, code: Column, names: Column, probability: Column | None = None) -> Column:
    """A request for a repaired program, told what a critic thinks of the present one but nothing of hidden tests."""
    told = None if probability is None else F.concat(F.lit("\nEstimated chance that the program passes: "), F.format_string("%.4f", probability))
    return _lines("Repair the program. Hidden tests rejected it; they are not shown.", "Answer with Python source only.", told, _block("Interface", interface_text(names)), _block("Task", task), _block("Rejected program", code), "\nRepaired program:", "")


def repair_reason(probability: Column, threshold: float, finish: Column, mode: Column) -> Column:
    """Why a failed training response is repaired; the names are fixed values."""
    why = [(probability >= threshold, "critic_false_positive_train"), (probability >= 0.45, "critic_borderline_failed_train"), (finish == "length", "truncation_repair_train"), (mode == "stdin_stdout", "stdin_stdout_failed_train")]
    return F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in why), F.lit("failed_train_coverage"))


def specification_prompt(task: Column, names: Column) -> Column:
    """The first of two requests for a repair: what the program has to do."""
    return _lines("State what the program must do: inputs, outputs, rules and edge cases. Write no code.", _block("Interface", interface_text(names)), _block("Task", task), "")


def specified_repair_prompt(task: Column, code: Column, names: Column, specification: Column) -> Column:
    """The second request, with the answer to the first."""
    return _lines("Repair the program so that it meets the specification.", "Answer with Python source only.", _block("Interface", interface_text(names)), _block("Task", task), _block("Specification", specification), _block("Rejected program", code), "\nRepaired program:", "")


def two_stage_record(response: Column, sample: Column, specification: Column, completion: Column, finish: Column) -> list[Column]:
    """The columns of a two-stage repair."""
    code = X.normalize_code(completion)
    return [F.concat(response, F.lit("__repair"), sample.cast("string")).alias("response_id"), response.alias("original_response_id"), sample.alias("sample_id"), F.lit("two_stage").alias("prompt_mode"), specification.alias("specification"), completion.alias("generated_code"), code.alias("extracted_code"), finish.alias("finish_reason")]


#: What each profile of a judge adds to its request.
PROFILES = {
    "plain": "", "calibrated": "Most programs that look right fail a hidden case: give the highest score only where you have traced the code.",
    "strict": "Name a counterexample for every score below 5.", "probes": "Trace one ordinary, one boundary and one adversarial input through the code.",
}


def rubric_prompt(task: Column, code: Column, rubric: str, profile: str = "plain", task_chars: int = 4500, code_chars: int = 4500) -> Column:
    """A request for scores under a rubric, in one of PROFILES."""
    return _lines("Score the program under the rubric. Answer with one JSON object.", *([PROFILES[profile]] if PROFILES[profile] else []), _block("Rubric", F.lit(rubric)), _block("Task", X.clipped(task, task_chars, "\n[TRUNCATED]")), _block("Program", X.clipped(code, code_chars, "\n[TRUNCATED]")), "")


def pair_prompt(task: Column, a: Column, b: Column, task_chars: int = 4500, code_chars: int = 4500, answer_first: bool = True) -> Column:
    """A request for the better of two programs."""
    order = "State A or B first, then the reason." if answer_first else "Give the reason first, then A or B."
    return _lines("Which program solves the task?", order, _block("Task", X.clipped(task, task_chars, "\n[TRUNCATED]")), _block("Program A", X.clipped(a, code_chars, "\n[TRUNCATED]")), _block("Program B", X.clipped(b, code_chars, "\n[TRUNCATED]")), "")


def pair_completion(winner: Column, reason: Column, answer_first: bool = True) -> Column:
    """The answer to ``pair_prompt``."""
    word, why = F.concat(F.lit("Better: "), winner), F.concat(F.lit("Reason: "), X.collapsed(F.coalesce(reason, F.lit("no reason recorded"))))
    return F.concat_ws("\n", word, why) if answer_first else F.concat_ws("\n", why, word)


#: What a tag says in a sentence.
EVIDENCE = {"syntax_error": "The program does not parse.", "has_markdown_fence": "A fence is left in the program.", "has_prose_marker": "Prose follows the program.", "duplicate_defs": "A function is defined twice.", "top_level_calls": "Calls at top level run on import.", "typing_names_without_import": "Names from typing are not imported.", "many_lines": "The program is unusually long."}


def evidence(tags: Column) -> Column:
    """One sentence a tag of what can be seen, in the order of EVIDENCE."""
    return F.array_join(F.array_compact(F.array(*(F.when(F.array_contains(tags, k), F.lit(v)) for k, v in EVIDENCE.items()))), " ")


def critic_twins(prompt: Column, findings: Column, good: Column, bad: Column) -> list[Column]:
    """A critic's prompt with its right answer, and the answer that is to be rejected."""
    return [prompt.alias("prompt"), revision(findings, good).alias("chosen"), revision(findings, bad).alias("rejected"), revision(findings, good).alias("completion")]


def test_prompt(public: Column, code: Column, function: Column, tests: int, known: Column | None = None, most: int = 8) -> Column:
    """A request for tests that tell a suspect program from a right one; of known tests the first ``most`` are shown."""
    shown = None if known is None else _block("Known tests", F.concat(F.lit("["), F.array_join(F.slice(known, 1, most), ", "), F.lit("]")))
    return _lines(f"Write {tests} tests as a JSON object with fn_name and tests, a list of objects with args and expected.", F.concat(F.lit("Function: "), F.coalesce(function, F.lit("unknown"))), _block("Task", public), _block("Suspect program", code), shown, "")


def public_prompt(prompt: Column) -> Column:
    """What a critic's prompt says of the task in public."""
    return X.section(prompt, "Public task prompt:", ("Failed code:", "Previous failed code:"))


def summary_prompt(failure: Column, error: Column, task: Column, code: Column) -> Column:
    """A request for a failure's root cause in a sentence."""
    return _lines("Name the root cause of the failure in one sentence. Quote no test values.", F.concat(F.lit("Kind: "), F.coalesce(failure, F.lit("unknown"))), F.concat(F.lit("Error: "), X.clipped(error, 200)), _block("Task", X.clipped(task, 600)), _block("Program", X.clipped(code, 900)), "")


def consolidation_prompt(clusters: list[dict[str, Any]], least: int, most: int) -> str:
    """A request to merge clusters, given as dictionaries with name, rows and examples, into ``least`` to ``most`` categories."""
    lines = [f"- {c['name']} ({c['rows']} failures): " + "; ".join(c.get("examples", [])[:3]) for c in clusters]
    return f"Merge the clusters into {least} to {most} categories. Answer with a JSON list of objects with id, name and clusters.\n\n" + "\n".join(lines) + "\n"


def refinement_prompt(evidence_: dict[str, Any], rejected: dict[str, Any] | None = None, reasons: list[str] | None = None) -> str:
    """A request for a category's definition, from its evidence; with what was wrong with an earlier answer, if there is one."""
    head = f"Define the category {evidence_['id']!r}: definition, include, exclude, checks. Answer with one JSON object.\n"
    seen = "\n".join(f"- {x}" for x in evidence_.get("examples", []))
    again = "" if rejected is None else f"\nAn earlier answer was rejected ({', '.join(reasons or [])}):\n{rejected}\n"
    return f"{head}\nPatterns: {evidence_.get('patterns', {})}\nExamples:\n{seen}\n{again}"


def compact_rubric(document: dict[str, Any], chars: int = 240) -> dict[str, Any]:
    """What a judge needs of a rubric document: identifiers, weights, short anchors and the rule of aggregation."""
    short = lambda v: " ".join(str(v).split())[:chars]
    dims = [{"id": d["id"], "weight": d.get("weight"), "anchors": {k: short(v) for k, v in d.get("anchors", {}).items()}} for d in document.get("dimensions", [])]
    return {"dimensions": dims, "aggregation": {k: v for k, v in document.get("aggregation", {}).items() if k in ("method", "pass_threshold", "critical")}}


def compact_examples(examples: list[dict[str, Any]], most: int = 3, chars: int = 400) -> list[dict[str, Any]]:
    """The first examples with clipped texts and without private fields."""
    return [{k: v if not isinstance(v, str) or len(v) <= chars else v[: chars - 3] + "..." for k, v in e.items() if k not in HIDDEN} for e in examples[:most]]


def review_item(key: Column, category: Column, task: Column, code: Column, reason: str, task_chars: int = 1200, code_chars: int = 1600) -> list[Column]:
    """The columns of an item for review, with an empty annotation."""
    stub = F.struct(F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("confidence"), F.lit("").alias("notes"), F.lit("pending").alias("status"))
    return [F.concat(F.lit("item-"), F.substring(F.sha2(key, 256), 1, 12)).alias("item_id"), key.alias("response_id"), category.alias("category"), X.clipped(task, task_chars).alias("task"), X.clipped(code, code_chars).alias("code"), F.lit(reason).alias("sampling_reason"), stub.alias("annotation")]
