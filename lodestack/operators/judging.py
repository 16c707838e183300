"""From a judge's raw answer to a judgment of known shape."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lodestack.functions import jsonfn

_DIMENSION = T.StructType([T.StructField("applicable", T.BooleanType()), T.StructField("score", T.IntegerType()), T.StructField("rationale", T.StringType())])
_ERROR = T.StructType([T.StructField(c, T.StringType()) for c in ("dimension_id", "severity", "evidence", "counterexample")])
_PROBE = T.StructType([*(T.StructField(c, T.StringType()) for c in ("kind", "input", "expected_behavior", "observed_behavior")), T.StructField("consistent", T.BooleanType()), T.StructField("affected_dimensions", T.ArrayType(T.StringType()))])
_SPECIFICATION = T.StructType([*(T.StructField(c, T.StringType()) for c in ("input_contract", "output_contract", "core_rule")), *(T.StructField(c, T.ArrayType(T.StringType())) for c in ("boundary_cases", "material_ambiguities"))])
JUDGMENT = T.StructType([
    T.StructField("dimension_scores", T.MapType(T.StringType(), _DIMENSION)), T.StructField("critical_errors", T.ArrayType(T.StringType())), T.StructField("error_details", T.ArrayType(_ERROR)), T.StructField("specification", _SPECIFICATION), T.StructField("test_probes", T.ArrayType(_PROBE)),
    T.StructField("overall_score", T.DoubleType()), T.StructField("predicted_pass", T.BooleanType()), T.StructField("confidence", T.StringType()), T.StructField("repairs", T.ArrayType(T.StringType())),
])
#: Severities, kinds of probes, the most items kept, and words by which an observation refers to the code.
SEVERITIES, PROBES, MOST = ("minor", "major", "fatal"), ("ordinary", "boundary", "adversarial"), 6
TRACES = ("return", "branch", "loop", "variable", "expression", "value", "type", "index", "append", "if ", "==", "computes", "evaluates", "raises")


def clipped(value, limit: int) -> str:
    text = " ".join(str(value if value is not None else "").split())
    return text if len(text) <= limit else text[: limit - 3].rstrip() + "..."


def _items(source, most: int = MOST) -> list:
    return source[:most] if isinstance(source, list) else []


def _score(value) -> int | None:
    try:
        n = round(float(value))
    except (TypeError, ValueError, OverflowError):
        return None
    return n if 1 <= n <= 5 else None


def critical_errors(source, dimensions: list[str]) -> list[dict]:
    """Errors with a known dimension and severity; bare texts become minor ones of no dimension."""
    out = []
    for x in source if isinstance(source, list) else []:
        if isinstance(x, dict):
            severity = str(x.get("severity") or "minor").lower()
            if str(x.get("dimension_id") or "") in dimensions and severity in SEVERITIES:
                out.append({"dimension_id": str(x["dimension_id"]), "severity": severity, "evidence": clipped(x.get("evidence"), 320), "counterexample": clipped(x.get("counterexample"), 240)})
        elif (text := clipped(x, 320)) and text.lower() not in ("none", "n/a"):
            out.append({"dimension_id": None, "severity": "minor", "evidence": text, "counterexample": None})
    return list({tuple(e.items()): e for e in out}.values())


def specification(source) -> dict | None:
    if not isinstance(source, dict):
        return None
    one = {k: clipped(source.get(k), n) for k, n in (("input_contract", 320), ("output_contract", 320), ("core_rule", 400))}
    many = {k: [clipped(v, n) for v in _items(source.get(k)) if str(v).strip()] for k, n in (("boundary_cases", 180), ("material_ambiguities", 240))}
    return one | many


def probes(source, dimensions: list[str]) -> list[dict]:
    """Probes of a known kind that say whether they are consistent."""
    out = []
    for x in _items(source):
        if isinstance(x, dict) and str(x.get("kind") or "").lower() in PROBES and isinstance(x.get("consistent"), bool):
            texts = {k: clipped(x.get(k), n) for k, n in (("input", 240), ("expected_behavior", 280), ("observed_behavior", 280))}
            out.append({"kind": str(x["kind"]).lower(), **texts, "consistent": x["consistent"], "affected_dimensions": [d for d in _items(x.get("affected_dimensions"), 99) if d in dimensions]})
    return out


def probe_faults(found: list[dict], strict: bool = False) -> list[str]:
    """What keeps probes from being one of each kind with all fields; strictly, observations must also trace the code."""
    kinds = [p["kind"] for p in found]
    out = [f"probes:{len(found)}"] * (len(found) != len(PROBES)) + [f"{k}:{kinds.count(k)}" for k in sorted(PROBES) if kinds.count(k) != 1]
    for i, p in enumerate(found):
        out += [f"{i}:empty_{k}" for k in ("input", "expected_behavior", "observed_behavior") if not p[k].strip()]
        if strict and (why := weak_trace(p["expected_behavior"], p["observed_behavior"])):
            out.append(f"{i}:{why}")
    return out


def weak_trace(expected: str, observed: str) -> str | None:
    """Why an observation shows no trace of the code; None if it does."""
    plain = lambda t: re.sub(r"\W+", " ", t.lower()).strip()
    if not observed.strip():
        return "empty"
    if plain(expected) == plain(observed):
        return "repeats_expected"
    if len(observed.split()) < 4:
        return "too_short"
    return None if any(t in observed.lower() for t in TRACES) else "no_code"


def normalised(
    text: str | None, dimensions: list[str], threshold: float = 3.5, semantic: list[str] | None = None, need_probes: bool = False, strict_probes: bool = False,
    decision: str = "plain", verified: dict | None = None, fallback: dict[str, int] | None = None,
) -> dict:
    """The fields of JUDGMENT from a judge's raw answer.

    Only known dimensions stay, missing ones take the fallback's score or don't
    apply, scores are 1 to 5.  An inconsistent probe caps the dimensions it
    affects at 2 and adds a major error; missing or weak probes cap the semantic
    dimensions at 3 where they are needed, and so do ambiguities that matter.
    ``verified``, {passed, failure_type, error, ...}, caps the dimension that a
    failure points at, and all semantic ones.  The mean and the decision (plain,
    calibrated or strict) follow from the scores; what was mended is listed.
    """
    found = jsonfn.find_object(text, ("dimension_scores", "critical_errors", "overall_score"))
    repairs = [] if found is not None else ["no_object"]
    found, semantic = found or {}, dimensions if semantic is None else semantic
    raw = found.get("dimension_scores")
    raw = raw if isinstance(raw, dict) else {}
    scores: dict[str, dict] = {}
    for d in dimensions:
        x = raw.get(d)
        if not isinstance(x, dict):
            x = {"score": x} if isinstance(x, (int, float)) and not isinstance(x, bool) else {}
        score = _score(x.get("score"))
        if d not in raw:
            repairs.append(f"missing:{d}")
        elif score is None and x.get("applicable", True):
            repairs.append(f"bad_score:{d}")
        if score is None and fallback and d in fallback and x.get("applicable", True):
            score = fallback[d]
            repairs.append(f"fallback:{d}")
        applies = bool(x.get("applicable", score is not None)) and score is not None
        scores[d] = {"applicable": applies, "score": score if applies else None, "rationale": str(x["rationale"]) if x.get("rationale") else None}

    def cap(d: str, most: int, why: str) -> None:
        s = scores.get(d)
        if s and s["applicable"] and s["score"] > most:
            scores[d] = {"applicable": True, "score": most, "rationale": " ".join(filter(None, (s["rationale"], f"[{why}]")))}
            repairs.append(f"capped:{d}")

    errors, tested, spec = critical_errors(found.get("critical_errors"), dimensions), probes(found.get("test_probes"), dimensions), specification(found.get("specification"))
    for p in tested:
        if not p["consistent"]:
            hit = [d for d in p["affected_dimensions"] if d in semantic] or semantic[:1]
            for d in hit:
                cap(d, 2, f"inconsistent {p['kind']} probe")
            errors.append({"dimension_id": hit[0] if hit else None, "severity": "major", "evidence": clipped(f"{p['kind']} probe {p['input']}: expected {p['expected_behavior']}; code implies {p['observed_behavior']}", 320), "counterexample": clipped(p["input"], 240)})
    if need_probes and (faults := probe_faults(tested, strict_probes)):
        repairs += [f"probe:{x}" for x in faults]
        for d in semantic:
            cap(d, 3, "probes missing or weak")
    unclear = ambiguities(spec["material_ambiguities"], VAGUE)[0] if spec else []
    if unclear:
        repairs.append(f"ambiguities:{len(unclear)}")
        for d in semantic:
            cap(d, 3, "ambiguous task")
    if verified is not None and not verified.get("passed"):
        primary = failure_dimension(verified, dimensions)
        if primary:
            cap(primary, 2, "verifier failure")
        for d in semantic:
            if d != primary:
                cap(d, 3, "no verified behaviour")
        errors.append({"dimension_id": primary, "severity": "major", "evidence": clipped("; ".join(f"{k}={verified[k]}" for k in ("failure_type", "error", "first_kind", "test_count", "pass_count") if verified.get(k) is not None) or "verifier reported failure", 320), "counterexample": ""})
    if len(errors) > MOST:
        repairs.append("errors_cut")
    given = [s["score"] for s in scores.values() if s["applicable"]]
    mean = sum(given) / len(given) if given else None
    stated = found.get("overall_score")
    if mean is not None and not (isinstance(stated, (int, float)) and abs(stated - mean) < 0.5):
        repairs.append("overall_from_scores")
    lowest = min((scores[d]["score"] for d in semantic if d in scores and scores[d]["applicable"]), default=5)
    grave = [e for e in errors if e["severity"] != "minor" or e["dimension_id"] is None]
    passes = mean is not None and mean >= threshold and not (grave if decision != "strict" else errors)
    passes = passes and (decision == "plain" or lowest >= 3)
    confidence = str(found.get("confidence") or "").lower()
    return {"dimension_scores": scores, "critical_errors": [e["evidence"] for e in errors[:MOST]], "error_details": errors[:MOST], "specification": spec, "test_probes": tested, "overall_score": mean, "predicted_pass": passes, "confidence": confidence if confidence in ("low", "medium", "high") else "low", "repairs": repairs}


#: What an observed failure points at, by words in its kind and error.
FAILURE_WORDS = {"syntax": "syntax_parseability_truncation", "interface": "interface_name_signature_mismatch", "nameerror": "interface_name_signature_mismatch", "not defined": "interface_name_signature_mismatch", "type": "runtime_api_type_misuse", "exception": "runtime_api_type_misuse", "runtime": "runtime_api_type_misuse", "timeout": "runtime_api_type_misuse", "wrong_length": "output_type_or_container_shape"}


def failure_dimension(verified: dict, dimensions: list[str]) -> str | None:
    """The dimension that a verifier's failure points at, if the rubric has it, else the first one that speaks of numbers, else none."""
    text = " ".join(str(verified.get(k) or "") for k in ("failure_type", "first_kind", "error")).lower()
    named = next((d for w, d in FAILURE_WORDS.items() if w in text), "numeric_formula_arithmetic_error")
    return named if named in dimensions else next((d for d in dimensions if "numeric" in d), None)


def judged(df: DataFrame, raw: str, key: str, dimensions: list[str], threshold: float = 3.5, verified: Column | None = None, **rules) -> DataFrame:
    """(key, judgment.*) of raw answers; a null answer is one without an object; ``verified`` is a struct of what a verifier saw; ``rules`` are those of ``normalised``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen = [jsonfn.load(v) if isinstance(v, str) else None for v in pdf["verified"]]
            yield pd.DataFrame({"key": pdf["key"], "judgment": [normalised(t, dimensions, threshold, verified=v, **rules) for t, v in zip(pdf["raw"], seen)]})

    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("judgment", JUDGMENT)])
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(raw).alias("raw"), (F.lit(None).cast("string") if verified is None else F.to_json(verified)).alias("verified"))
    return rows.mapInPandas(run, schema).select(F.col("key").alias(key), "judgment.*")


def deranged(items: list[str], seed: int) -> list[str]:
    """A seeded order in which nothing keeps its place; the same order for fewer than two items."""
    if len(items) < 2:
        return list(items)
    rng, out = random.Random(seed), list(items)
    for i in range(len(out) - 1, 0, -1):  # a cyclic permutation has no fixed point
        j = rng.randrange(i)
        out[i], out[j] = out[j], out[i]
    return out


#: Ambiguities that say nothing.
VAGUE = ("unclear", "ambiguous", "not specified", "task is unclear", "the task is unclear", "none", "n/a", "unknown", "edge cases are unclear")


def ambiguities(items: list[str], vague: tuple[str, ...]) -> tuple[list[str], list[str]]:
    """(actionable, vague) ambiguities: vague ones are short or say only that something is unclear."""
    soft = re.compile("|".join(map(re.escape, vague)), re.I)
    keep = [x for x in items if len(x.split()) >= 4 and not soft.fullmatch(x.strip(" ."))]
    return keep, [x for x in items if x not in keep]
