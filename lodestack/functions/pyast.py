"""What only a parser can tell about Python source.

All results of one text come from one parse, and ``analysed`` parses every
distinct text once, whatever the number of rows that hold it.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

AUDIT = T.StructType([
    T.StructField("parseable", T.BooleanType()), T.StructField("syntax_error", T.StringType()), T.StructField("functions", T.ArrayType(T.StringType())),
    T.StructField("solution_methods", T.ArrayType(T.StringType())), T.StructField("duplicate_functions", T.IntegerType()), T.StructField("demos", T.IntegerType()),
    T.StructField("signatures", T.ArrayType(T.StringType())), T.StructField("missing_typing", T.ArrayType(T.StringType())), T.StructField("calls_input", T.BooleanType()),
    T.StructField("node_counts", T.MapType(T.StringType(), T.IntegerType())), T.StructField("max_depth", T.IntegerType()),
])
#: Names that annotations take from typing.
TYPING = ("Any", "Callable", "Dict", "Iterable", "List", "Optional", "Sequence", "Set", "Tuple", "Union")
#: Kinds of nodes that the features count.
#: Pieces of source whose occurrences the features count.
TERMS = ("for ", "while ", "if ", "elif ", "else", "return", "print", "input(", "import ", "from ", "class ", "def ", "try:", "except", "lambda", "sort", "sorted", "Counter", "defaultdict", "heapq", "bisect", "math.", "re.", "List[", "Dict[", "set(", "dict(", "append", "pop(", "split(", "join(", "replace(")
COUNTED = ("For", "While", "If", "Return", "Call", "Compare", "BinOp", "BoolOp", "Subscript", "ListComp", "DictComp", "Lambda", "Try", "FunctionDef", "ClassDef", "Import", "Assign")


def parse(code: str | None) -> tuple[ast.Module | None, str | None]:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(code or ""), None
    except SyntaxError as e:
        return None, f"{e.msg} at line {e.lineno}"
    except (ValueError, RecursionError, MemoryError) as e:
        return None, type(e).__name__


def is_main_guard(node: ast.stmt) -> bool:
    return isinstance(node, ast.If) and ast.unparse(node.test).replace('"', "'") in ("__name__ == '__main__'", "'__main__' == __name__")


def is_demo(node: ast.stmt) -> bool:
    """Statements at top level that run something: asserts, main guards and bare calls."""
    return isinstance(node, ast.Assert) or is_main_guard(node) or (isinstance(node, ast.Expr) and isinstance(node.value, ast.Call))


def _signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    return f"{node.name}({ast.unparse(node.args)})"


def _depth(tree: ast.AST) -> int:
    """The deepest nesting of nodes, by levels and without recursion."""
    depth, level = 0, [tree]
    while level:
        depth, level = depth + 1, [c for n in level for c in ast.iter_child_nodes(n)]
    return depth


def audit(code: str | None) -> dict:
    """The fields of AUDIT; everything but the error is empty for text that doesn't parse."""
    tree, error = parse(code)
    out = dict(parseable=tree is not None, syntax_error=error, functions=[], solution_methods=[], duplicate_functions=0, demos=0, signatures=[], missing_typing=[], calls_input=False, node_counts={}, max_depth=0)
    if tree is None:
        return out
    defs = [n for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    methods = [m.name for n in tree.body if isinstance(n, ast.ClassDef) and n.name == "Solution" for m in n.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
    nodes = list(ast.walk(tree))
    names = {n.id for n in nodes if isinstance(n, ast.Name)}
    bound = {a.asname or a.name.split(".")[0] for n in nodes if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names} | {n.name for n in nodes if isinstance(n, (ast.ClassDef, ast.FunctionDef))}
    kinds = Counter(type(n).__name__ for n in nodes)
    out |= dict(
        functions=sorted({d.name for d in defs}), solution_methods=sorted(set(methods)), duplicate_functions=len(defs) - len({d.name for d in defs}), demos=sum(map(is_demo, tree.body)),
        signatures=[_signature(d) for d in defs], missing_typing=[t for t in TYPING if t in names and t not in bound and "*" not in bound],
        calls_input=any(isinstance(n, ast.Call) and ast.unparse(n.func) in ("input", "sys.stdin.read", "sys.stdin.readline") for n in nodes),
        node_counts={k: kinds[k] for k in COUNTED if kinds[k]}, max_depth=_depth(tree),
    )
    return out


#: Functions that only try out others.
_DEMO_NAME = re.compile(r"(?:main|demo|example|run_tests?|test\w*|check_\w+)$")


def _tries_out(node: ast.stmt, keep: frozenset[str]) -> bool:
    return isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) and bool(_DEMO_NAME.match(node.name)) and node.name not in keep and not node.args.args


def without_harness(code: str, keep: frozenset[str] = frozenset()) -> str:
    """The source without its top-level demos and, where something else is defined, the functions without arguments that only try it out; unchanged if what is left doesn't parse or is empty."""
    tree, _ = parse(code)
    if tree is None:
        return code
    lines = code.split("\n")
    others = any(isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and not _tries_out(n, keep) for n in tree.body)
    drop = {i for n in tree.body if is_demo(n) or (others and _tries_out(n, keep)) for i in range(n.lineno - 1, (n.end_lineno or n.lineno))}
    kept = "\n".join(x for i, x in enumerate(lines) if i not in drop).strip("\n")
    return kept if kept.strip() and parse(kept)[0] is not None else code


def parseable_prefix(code: str) -> str:
    """The longest run of first lines that parses and isn't blank; '' without one.

    A parser that stops at a line stops there in every longer run too, so the
    next cut is before that line.
    """
    lines = code.split("\n")
    n = len(lines)
    while n > 0:
        part = "\n".join(lines[:n]).rstrip()
        if not part:
            return ""
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(part)
            return part
        except SyntaxError as e:
            n = min(n, part.count("\n") + 1, e.lineno or n) - 1
        except (ValueError, RecursionError, MemoryError):
            n -= 1
    return ""


_MARK = re.compile(r"(?im)^\s*REVISED_CODE\s*:\s*")
_END = re.compile(r"(?im)^\s*(?:END_OF_CODE|END_REVISED_CODE|### END).*$")
_FENCED = re.compile(r"(?is)```(?:python)?\s*\n?(.*?)```")


#: What stands in for a program, and the openings of prose that follows one.
_PLACEHOLDER = re.compile(r"(?i)^(?:python code:|<valid python code only>)\s*")
_PROSE = re.compile(r"\n(?:ERROR_FINDINGS:|Public task prompt:|Previous failed code:|The (?:provided|original) code|No changes|Here is)")


def revised_code(raw: str | None) -> dict:
    """(code, status, notes) of a critic's raw answer: what follows its marker, unfenced, cut to what parses, without demos."""
    text, notes = raw or "", []
    parts = _MARK.split(text)
    if len(parts) > 2:
        notes.append("repeated_marker")
    text = parts[-1] if len(parts) > 1 else text
    if len(parts) == 1:
        notes.append("no_marker")
    if (m := _END.search(text)) is not None:
        text = text[: m.start()]
        notes.append("end_marker")
    if (m := _FENCED.search(text)) is not None:
        text = m.group(1)
        notes.append("fence")
    text = _PLACEHOLDER.sub("", text.strip("\n").lstrip())
    if (m := _PROSE.search(text)) is not None:
        text = text[: m.start()]
        notes.append("prose_cut")
    code = text.strip("\n").rstrip()
    if parse(code)[0] is None:
        code = parseable_prefix(code)
        notes.append("cut_to_parse")
    clean = without_harness(code)
    if clean != code:
        notes.append("harness_removed")
    status = "empty" if not clean.strip() else "clean" if not {"no_marker", "cut_to_parse"} & set(notes) else "repaired"
    return {"code": clean, "status": status, "notes": notes}


def reject_reasons(code: str | None, required: list[str] | None) -> list[str]:
    """Why a completion isn't fit as strict training text; [] if it is."""
    a = audit(code)
    if not (code or "").strip():
        return ["empty"]
    if not a["parseable"]:
        return ["not_parseable"]
    out = []
    if required and not set(required) & set(a["functions"] + a["solution_methods"]):
        out.append("interface_missing")
    out += ["top_level_demo"] * bool(a["demos"]) + ["duplicate_function"] * bool(a["duplicate_functions"]) + ["missing_typing_import"] * bool(a["missing_typing"]) + ["fence_left"] * ("```" in (code or ""))
    return out


def _map(df: DataFrame, text: str, name: str, schema: T.DataType, f) -> DataFrame:
    """``df`` with ``name``: f of each distinct text, joined back by a hash and the text's length."""
    out = T.StructType([T.StructField("_key", T.StringType()), T.StructField(name, schema)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"_key": pdf["_key"], name: [f(t) for t in pdf["_text"]]})

    keyed = df.withColumn("_key", F.sha2(F.col(text), 256))
    once = keyed.where(F.col(text).isNotNull()).groupBy("_key").agg(F.first(text).alias("_text"))
    return keyed.join(once.mapInPandas(run, out), "_key", "left").drop("_key")


def feature_tags(audit_: Column, code: Column) -> Column:
    """Tags of what can be seen of a program: (audit, source) to an array of names."""
    lines = F.size(F.filter(F.split(F.coalesce(code, F.lit("")), "\n"), lambda x: F.trim(x) != ""))
    tags = [
        (audit_["syntax_error"].isNotNull(), "syntax_error"), (code.contains("```"), "has_markdown_fence"), (code.rlike(_PROSE.pattern), "has_prose_marker"), (code.contains("#"), "has_comment"), (lines >= 50, "many_lines"),
        (audit_["duplicate_functions"] > 0, "duplicate_defs"), (audit_["demos"] > 0, "top_level_calls"), (F.size(audit_["missing_typing"]) > 0, "typing_names_without_import"),
    ]
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in tags)))


def hard_positive(tags: Column) -> Column:
    """Whether a passing program looks like a failing one."""
    return F.arrays_overlap(tags, F.array(*map(F.lit, ("top_level_calls", "has_comment", "many_lines", "duplicate_defs"))))


def visible_negative(tags: Column, label: Column) -> Column:
    """Whether a failing program shows what its label says."""
    has = lambda t: F.array_contains(tags, t)
    of = lambda *labels: F.coalesce(label.isin(*labels), F.lit(False))
    broken = ("syntax_or_parse_error", "truncation_or_overgeneration")
    return (
        has("syntax_error") | has("has_prose_marker") | has("has_markdown_fence") | (has("duplicate_defs") & of(*broken, "interface_contract_error"))
        | (has("typing_names_without_import") & of("runtime_exception_or_timeout")) | (has("many_lines") & of(*broken))
    )


def analysed(df: DataFrame, text: str, name: str = "audit") -> DataFrame:
    """``df`` with the AUDIT of a text column; null for null texts."""
    return _map(df, text, name, AUDIT, audit)


def extracted(df: DataFrame, text: str, name: str = "revised") -> DataFrame:
    schema = T.StructType([T.StructField("code", T.StringType()), T.StructField("status", T.StringType()), T.StructField("notes", T.ArrayType(T.StringType()))])
    return _map(df, text, name, schema, revised_code)


def static_features(df: DataFrame, text: str, name: str = "features") -> DataFrame:
    """``df`` with a map of log-scaled features of the source: sizes and counts of nodes."""
    import math

    def f(code: str | None) -> dict[str, float]:
        a, lines, low = audit(code), (code or "").split("\n"), (code or "").lower()
        raw = {"chars": len(code or ""), "lines": len(lines), "blank_lines": sum(not x.strip() for x in lines), "comment_lines": sum(x.lstrip().startswith("#") for x in lines), "depth": a["max_depth"], "functions": len(a["functions"]), "demos": a["demos"], "parseable": a["parseable"]}
        terms = {f"term_{t.strip(' (:.[').lower()}": low.count(t.lower()) for t in TERMS}
        return {k: math.log1p(float(v)) for k, v in (raw | terms | {f"ast_{k}": v for k, v in a["node_counts"].items()}).items()}

    return _map(df, text, name, T.MapType(T.StringType(), T.DoubleType()), f)
