"""Lenient JSON: objects inside prose, one of two encodings, canonical keys and tolerant equality."""

from __future__ import annotations

import ast
import json
import math
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

_FENCED = re.compile(r"(?is)```(?:json)?\s*(.*?)```")


def balanced(text: str) -> list[str]:
    """All outermost {...} parts of a text, with braces inside strings left alone; a part that isn't closed is dropped."""
    out, depth, start, quote, skip = [], 0, 0, False, False
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif quote:
            skip, quote = c == "\\", c != '"'
        elif c == '"' and depth:
            quote = True
        elif c == "{":
            start = i if not depth else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                out.append(text[start : i + 1])
    return out


def load(text: str) -> Any:
    """JSON, else a Python literal, else None."""
    try:
        return json.loads(text)
    except ValueError:
        pass
    try:
        return ast.literal_eval(text.strip())
    except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
        return None


def find_object(text: str | None, wanted: tuple[str, ...] = ()) -> dict | None:
    """The object in a text that has most of the wanted keys: the whole text, a fenced block or a balanced part; first of equals."""
    best, score = None, -1
    for part in [text or "", *_FENCED.findall(text or ""), *balanced(text or "")]:
        got = load(part)
        if isinstance(got, dict) and (n := sum(k in got for k in wanted)) > score:
            best, score = got, n
    return best


def truncated_items(text: str, key: str) -> list:
    """The complete elements of a list under ``key`` in an object that breaks off."""
    m = re.search(rf'"{re.escape(key)}"\s*:\s*\[', text)
    return [x for x in map(load, balanced(text[m.end() :])) if x is not None] if m else []


#: Keys under which a suite holds its tests.
SUITE_KEYS = ("tests", "cases", "test_cases")


def inner_objects(text: str) -> list[str]:
    """All {...} parts of a text at every depth, in the order of their beginnings."""
    open_, found, quote, skip = [], [], False, False
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif quote:
            skip, quote = c == "\\", c != '"'
        elif c == '"' and open_:
            quote = True
        elif c == "{":
            open_.append(i)
        elif c == "}" and open_:
            start = open_.pop()
            found.append((start, text[start : i + 1]))
    return [t for _, t in sorted(found)]


def case_of(raw: Any) -> dict | None:
    """A test as {args, expected}: arguments under args, input or inputs, one that isn't a list as a list of one; None without an expectation."""
    if not isinstance(raw, dict):
        return None
    given = next((raw[k] for k in ("args", "input", "inputs") if k in raw), None)
    wanted = next((raw[k] for k in ("expected", "output", "expected_output") if k in raw), ...)
    if given is None or wanted is ...:
        return None
    return {"args": given if isinstance(given, list) else [given], "expected": wanted}


def suite_of(text: str | None, most: int = 50) -> dict:
    """(fn_name, tests, status) of a generated suite: an object with tests, else the tests that stand in a text that breaks off; equal tests count once."""
    text = text or ""
    holders = [o for part in [text, *_FENCED.findall(text), *reversed(balanced(text))] if isinstance(o := load(part), dict)]
    suite = next((o for o in holders if any(k in o for k in SUITE_KEYS)), None)
    if suite is not None:
        raw, status = next((suite[k] for k in SUITE_KEYS if k in suite), []), "suite"
    else:
        raw, status = [o for part in inner_objects(text) if isinstance(o := load(part), dict)], "recovered"
    tests = {canonical(c): c for x in (raw if isinstance(raw, list) else []) if (c := case_of(x)) is not None}
    name = (suite or {}).get("fn_name") or next(iter(re.findall(r"""["']fn_name["']\s*:\s*["']([^"']+)["']""", text)), "")
    kept = list(tests.values())[:most]
    return {"fn_name": str(name).strip(), "tests": kept, "status": status if kept else "no_tests"}


def candidates_of(texts: list[str | None]) -> list[dict]:
    """Categories in models' answers: of an object with a list of categories each with an id, of an object with an id itself; others give none."""
    out = []
    for t in texts:
        o = find_object(t, ("categories", "id")) or {}
        listed = o.get("categories") if isinstance(o.get("categories"), list) else [o]
        out += [c for c in listed if isinstance(c, dict) and c.get("id")]
    return out


def anchors_of(value: Any, fallback: dict[str, str]) -> tuple[dict[str, str], list[str]]:
    """The anchors of a score, texts for the fallback's keys, and the keys that had to be filled."""
    source = {str(k): " ".join(str(v or "").split()) for k, v in value.items()} if isinstance(value, dict) else {}
    filled = [k for k in sorted(fallback) if not source.get(k)]
    return {k: source.get(k) or fallback[k] for k in sorted(fallback)}, filled


def listed(value: Any, fallback: list[str], least: int = 1) -> list[str]:
    """A list of distinct texts, filled up from the fallback to ``least``; a bare text is a list of one."""
    given = [value] if isinstance(value, str) else value if isinstance(value, list) else []
    out = list(dict.fromkeys(t for x in given if (t := " ".join(str(x).split()))))
    return out + [x for x in fallback if x not in out][: max(0, least - len(out))]


#: Fields of a verifier's diagnostics that may be shown, and their names outside.
SHOWN = {"diagnostic_kind": "diagnostic_kind", "first_failure_kind": "first_failure_kind", "first_actual": "observed_value_shape", "first_expected": "reference_value_shape", "exception_type": "exception_type", "syntax_error_type": "syntax_error_type"}


def safe_diagnostics(fields: dict[str, Column]) -> Column:
    """A map of the diagnostics that may be shown; columns named as in SHOWN, nulls are left out."""
    pairs = F.array(*(F.struct(F.lit(SHOWN[k]).alias("k"), c.cast("string").alias("v")) for k, c in fields.items() if k in SHOWN))
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))


@F.pandas_udf(T.StructType([T.StructField("fn_name", T.StringType()), T.StructField("tests", T.StringType()), T.StructField("test_count", T.IntegerType()), T.StructField("status", T.StringType())]))
def parsed_suite(texts: pd.Series) -> pd.DataFrame:
    """The suite in each text, its tests as a JSON list."""
    rows = [suite_of(t) for t in texts]
    return pd.DataFrame({"fn_name": [r["fn_name"] for r in rows], "tests": [json.dumps(r["tests"], ensure_ascii=False) for r in rows], "test_count": pd.Series([len(r["tests"]) for r in rows], dtype="int32"), "status": [r["status"] for r in rows]})


def canonical(value: Any) -> str:
    """One text for equal values: sorted keys, tuples as lists, sets sorted, whole floats as integers."""
    def plain(v: Any) -> Any:
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        if isinstance(v, (set, frozenset)):
            return sorted((plain(x) for x in v), key=repr)
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        return int(v) if isinstance(v, float) and v.is_integer() else v

    return json.dumps(plain(value), sort_keys=True, ensure_ascii=False, default=str)


def same(a: Any, b: Any, tolerance: float = 1e-6, unwrap: int = 3) -> bool:
    """Equality with lists for tuples, a tolerance for numbers and, up to ``unwrap`` levels, lists of one for their element."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b if isinstance(a, bool) and isinstance(b, bool) else a == b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return a == b or (math.isfinite(a) and math.isfinite(b) and abs(a - b) <= tolerance)
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        if len(a) == len(b) and all(same(x, y, tolerance, unwrap) for x, y in zip(a, b)):
            return True
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k], tolerance, unwrap) for k in a)
    if unwrap:
        if isinstance(a, (list, tuple)) and len(a) == 1 and not isinstance(b, (list, tuple)):
            return same(a[0], b, tolerance, unwrap - 1)
        if isinstance(b, (list, tuple)) and len(b) == 1 and not isinstance(a, (list, tuple)):
            return same(a, b[0], tolerance, unwrap - 1)
    return a == b


def difference(actual: Any, expected: Any) -> str:
    """How two values differ: equal, wrong_type, wrong_length or wrong_value."""
    if same(actual, expected):
        return "equal"
    if isinstance(actual, (list, tuple)) != isinstance(expected, (list, tuple)) or isinstance(actual, (int, float)) != isinstance(expected, (int, float)):
        return "wrong_type"
    if hasattr(actual, "__len__") and hasattr(expected, "__len__") and len(actual) != len(expected):
        return "wrong_length"
    return "wrong_value"


@F.pandas_udf(T.StringType())
def object_text(texts: pd.Series) -> pd.Series:
    """The canonical text of the object in each text; null without one."""
    return texts.map(lambda t: None if (o := find_object(t)) is None else canonical(o))


@F.pandas_udf(T.StringType())
def canonical_text(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None or (v := load(t)) is None else canonical(v))


def unwrapped(text: Column) -> Column:
    """JSON that may be encoded once more as a JSON string, as plain JSON text; null where it isn't an object."""
    inner = F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v")
    out = F.when(F.trim(text).startswith('"'), inner).otherwise(text)
    return F.when(F.trim(out).startswith("{"), out)


def flags(passed: Column, total: Column) -> Column:
    """One boolean a test from the indices of the tests that passed."""
    return F.when(total > 0, F.transform(F.sequence(F.lit(0), total - 1), lambda i: F.array_contains(passed, i))).otherwise(F.array().cast("array<boolean>"))
