"""Scores that follow from a program and its record without a judge, static rubrics, and verdicts against labels."""

from __future__ import annotations

import random
from typing import Any

from pyspark.sql import Column, functions as F

from lodestack.functions import text as X
from lodestack.operators.documents import ANCHORS

#: Modules that a use of their name needs, and words of a program that isn't finished.
NEEDS = {"re.": "import re", "math.": "import math", "heapq.": "import heapq"}
STUB = r"\b(?:pass|TODO|NotImplementedError)\b"


def code_checks(code: Column, parseable: Column, names: Column) -> Column:
    """(parse_ok, interface_ok, missing_dep, stub) of a program."""
    text = F.coalesce(code, F.lit(""))
    lacking = [text.contains(use) & ~text.contains(imported) for use, imported in NEEDS.items()]
    return F.struct(F.coalesce(parseable, F.lit(False)).alias("parse_ok"), X.defines_named(text, names).alias("interface_ok"), F.greatest(*(x.cast("int") for x in lacking)).cast("boolean").alias("missing_dep"), text.rlike(STUB).alias("stub"))


def fallback_scores(checks: Column, dimensions: list[str]) -> Column:
    """A map of scores that ``code_checks`` allow: dimension to 1 to 5."""
    ok = checks["parse_ok"] & checks["interface_ok"]
    of = {
        "syntax_parseability_truncation": F.when(checks["parse_ok"], 5).otherwise(1), "interface_name_signature_mismatch": F.when(checks["interface_ok"], 5).otherwise(1),
        "runtime_api_type_misuse": F.when(checks["parse_ok"] & ~checks["missing_dep"], 4).otherwise(2),
    }
    other = F.when(~ok, 2).when(checks["stub"], 1).otherwise(4)
    return F.map_from_arrays(F.array(*map(F.lit, dimensions)), F.array(*(of.get(d, other) for d in dimensions)))


#: Dimensions of the deterministic score, their weights, and those whose lowest score caps the mean.
WEIGHTS = {"syntax_parseability_truncation": 1.25, "public_interface_contract": 1.2, "runtime_safety": 1.1, "output_contract_type_shape": 0.9, "algorithmic_logic_edge_cases": 1.25, "code_only_response_discipline": 0.85}
FLOOR = ("syntax_parseability_truncation", "public_interface_contract", "runtime_safety", "code_only_response_discipline")
_S, _I, _R, _O, _A, _D = WEIGHTS
#: What a finding allows at most, by dimension, and how it is told.
CAPS = {
    "empty": ({_S: 1, _D: 1}, "empty code"), "unparseable": ({_S: 1}, "Python parser rejects the code"), "long": ({_S: 2, _D: 2}, "length finish or unusually long completion"), "fence": ({_D: 2}, "Markdown fence visible in generated response"),
    "prose": ({_D: 2}, "non-code prose marker visible inside code"), "duplicates": ({_S: 3, _D: 3}, "duplicate callable definitions"), "typing": ({_R: 3}, "typing annotation names used without visible typing import"),
    "demos": ({_I: 3, _D: 3}, "top-level demo/assert/call may interfere with evaluation"), "interface": ({_I: 1}, "required callable interface is not visible"),
}
FAILURE_CAPS = {"syntax_error": {_S: 1}, "runtime_error": {_R: 1}, "timeout": {_R: 2}, "logic_error": {_A: 2, _O: 4}, "generation_failure": {_S: 1, _D: 1}}
OTHER_FAILURE = {_A: 3}


def deterministic_score(found: dict[str, Column], passed: Column, failure: Column) -> Column:
    """(scores, overall, predicted_pass, reasons): every dimension starts at 5 and is capped by what is found (keys of CAPS) and by how the program failed."""
    seen = {k: F.coalesce(found.get(k, F.lit(False)), F.lit(False)) for k in CAPS}
    failed, kind = ~F.coalesce(passed, F.lit(False)), F.coalesce(failure, F.lit("unknown_failure"))
    scores = {}
    for d in WEIGHTS:
        caps = [F.when(seen[k], F.lit(c[d])) for k, (c, _) in CAPS.items() if d in c] + [F.when(failed & (kind == k), F.lit(c[d])) for k, c in FAILURE_CAPS.items() if d in c]
        caps += [F.when(failed & ~kind.isin(*FAILURE_CAPS), F.lit(OTHER_FAILURE[d]))] if d in OTHER_FAILURE else []
        scores[d] = F.least(F.lit(5), F.lit(5), *caps)
    mean = sum((scores[d] * w for d, w in WEIGHTS.items()), F.lit(0.0)) / sum(WEIGHTS.values())
    floor = F.least(*(scores[d] for d in FLOOR))
    overall = F.bround(F.when(floor <= 1, F.least(mean, F.lit(2.0))).when(floor == 2, F.least(mean, F.lit(3.0))).otherwise(mean), 4)
    told = F.array_compact(F.array(*(F.when(seen[k], F.lit(why)) for k, (_, why) in CAPS.items()), F.when(failed, F.concat(F.lit("external verifier outcome: "), kind))))
    return F.struct(F.map_from_arrays(F.array(*map(F.lit, scores)), F.array(*scores.values())).alias("scores"), overall.alias("overall"), (overall >= 4.0).alias("predicted_pass"), F.slice(told, 1, 6).alias("reasons"))


def static_rubric(kind: str, categories: list[str], threshold: float = 3.5, seed: int = 42) -> dict[str, Any]:
    """A rubric that no model wrote: ``auto`` has a dimension a category, ``generic`` one of overall quality, ``random`` the categories with drawn weights."""
    ids = ["overall_quality"] if kind == "generic" else list(categories)
    rng = random.Random(seed)
    drawn = [rng.random() for _ in ids] if kind == "random" else [1.0] * len(ids)
    total = sum(drawn) or 1.0
    return {"dimensions": [{"id": d, "weight": round(w / total, 4), "anchors": dict(ANCHORS)} for d, w in zip(ids, drawn)], "aggregation": {"method": "weighted_mean", "pass_threshold": threshold, "critical": []}}


def judged_pass(verdict: Column, gold: Column) -> Column:
    """A verdict as a decision; one that can't be read counts as the wrong one, whatever the label."""
    return F.coalesce(F.when(verdict == "PASS", True).when(verdict == "FAIL", False), ~gold)
