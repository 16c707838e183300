"""Text functions as column expressions; null in gives null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_FENCE = r"(?is)```(?:python)?\s*(.*?)```"


def or_else(first: Column, second: Column) -> Column:
    """``first`` unless it is null or empty."""
    return F.coalesce(F.nullif(first, F.lit("")), second)


def extract_code(text: Column) -> Column:
    """The first fenced block, else the whole text; null counts as ''."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(_FENCE), F.regexp_extract(text, _FENCE, 1)).otherwise(text)


def strip(text: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def normalize_code(text: Column) -> Column:
    """The first fenced block with plain line ends, no blanks at line ends or around, and no fence left at its ends."""
    code = strip(F.regexp_replace(extract_code(text), "\r\n?", "\n"))
    code = F.regexp_replace(code, r"[ \t\f\x0b]+(?=\n)", "")
    code = F.regexp_replace(code, r"(?i)^\s*```(?:python)?\s*\n", "")
    code = F.regexp_replace(code, r"\n\s*```\s*\z", "")
    return strip(F.regexp_replace(code, r"(?i)^```(?:python)?\z", ""))


def without_fence_lines(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.ltrim(x).startswith("```")), "\n")


def clipped(text: Column, limit: int, suffix: str = "...") -> Column:
    """Stripped, and cut at ``limit`` characters with a suffix; null counts as ''."""
    s = strip(F.coalesce(text, F.lit("")))
    return F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit), F.lit(suffix))).otherwise(s)


def collapsed(text: Column) -> Column:
    """Runs of blanks as one, none at the ends."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def section(text: Column, start: str, ends: tuple[str, ...]) -> Column:
    """What follows ``start`` up to the first of ``ends``; the whole text where ``start`` is missing."""
    at = F.locate(start, text)
    rest = F.substring(text, at + len(start), F.length(text))
    cut = F.least(*(F.when(F.locate(e, rest) > 0, F.locate(e, rest)) for e in ends), F.length(rest) + 1)
    return strip(F.when(at > 0, F.substring(rest, F.lit(1), cut - 1)).otherwise(text))


def slug(text: Column, fallback: str = "item", limit: int = 64) -> Column:
    s = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_")
    return or_else(F.substring(F.regexp_replace(s, "^_+|_+$", ""), 1, limit), F.lit(fallback))


def line_count(text: Column) -> Column:
    """Lines that aren't blank; null counts as none."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != ""))


def token_count(text: Column) -> Column:
    """Runs of characters without blanks; null and blank count as none."""
    s = strip(F.coalesce(text, F.lit("")))
    return F.when(s == "", 0).otherwise(F.size(F.split(s, r"\s+")))


def length_ratio(a: Column, b: Column) -> Column:
    """The longer length over the shorter, which counts as 1 at least."""
    x, y = F.length(a), F.length(b)
    return F.greatest(x, y) / F.greatest(F.lit(1), F.least(x, y))


def same_stdout(a: Column, b: Column) -> Column:
    """Whether two outputs have the same tokens."""
    return F.split(strip(F.coalesce(a, F.lit(""))), r"\s+") == F.split(strip(F.coalesce(b, F.lit(""))), r"\s+")


def keyword_hits(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words the text contains, ignoring case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = [F.contains(low, F.lit(w)).cast("int") for w in words]
    return sum(hits[1:], hits[0])


def best_label(text: Column, labels: dict[str, tuple[str, ...]], fallback: str, margin: int = 1) -> Column:
    """The label with the most keyword hits, if it leads the next one by ``margin``; the fallback else."""
    scored = F.array_sort(F.array(*(F.struct((-keyword_hits(text, w)).alias("n"), F.lit(k).alias("label")) for k, w in labels.items())))
    first, second = F.element_at(scored, 1), F.element_at(scored, 2)
    return F.when((first["n"] < 0) & (second["n"] - first["n"] >= margin), first["label"]).otherwise(F.lit(fallback))


def masked(text: Column, phrases: tuple[str, ...], mask: str = "[MASKED]") -> Column:
    return F.regexp_replace(text, "(?i)" + "|".join(_quoted(p) for p in phrases), mask)


def _quoted(phrase: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in phrase)


def callables_in_asserts(tests: Column, builtins: tuple[str, ...]) -> Column:
    """Names called right after ``assert``, sorted and distinct, without builtins."""
    names = F.flatten(F.transform(tests, lambda t: F.regexp_extract_all(t, F.lit(r"assert\s+\(?\s*([A-Za-z_]\w*)\s*\("), F.lit(1))))
    return F.array_sort(F.array_except(F.array_distinct(names), F.array(*(F.lit(b) for b in builtins))))


def defines_all(code: Column, names: Column) -> Column:
    """Whether the code defines every name as a function (text only, no parsing); true for no names."""
    defined = F.regexp_extract_all(F.coalesce(code, F.lit("")), F.lit(r"(?m)^\s*(?:async\s+)?def\s+(\w+)\s*\("), F.lit(1))
    return F.size(F.array_except(F.coalesce(names, F.array().cast("array<string>")), defined)) == 0


def verdict(text: Column) -> Column:
    """PASS or FAIL by a labelled line, else by the first word; null if neither is there."""
    low = F.lower(F.coalesce(text, F.lit("")))
    labelled = F.regexp_extract(low, r"(?m)^\s*(?:verdict|label|answer)\s*[:=]\s*\W*(pass|fail)", 1)
    first = F.regexp_extract(low, r"^\W*(pass|fail)(?:ed|s)?\b", 1)
    return F.upper(F.coalesce(F.nullif(labelled, F.lit("")), F.nullif(first, F.lit(""))))


def inferred_split(split: Column, row_id: Column) -> Column:
    """The given split, else the one that the identifier names, else 'unknown'."""
    named = F.regexp_extract(row_id, r"^[a-z]+/([a-z]+)/", 1)
    return or_else(split, or_else(named, F.lit("unknown")))


def io_mode(mode: Column, prompt: Column) -> Column:
    """The given mode, else by whether the prompt speaks of standard input."""
    return or_else(mode, F.when(F.lower(prompt).contains("standard input"), "stdin_stdout").otherwise("function_call"))


#: Exceptions in the order in which an error text is searched for them, and the buckets of failed responses.
RUNTIME_ERRORS = ("NameError", "TypeError", "AttributeError", "IndexError", "KeyError", "ValueError", "ImportError", "ZeroDivisionError")
OUTPUT_KINDS = ("wrong_type", "wrong_length", "wrong_value")


def _first(choices: list[tuple[Column, str]], otherwise: str) -> Column:
    """The name of the first choice that holds."""
    held = F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in choices)))
    return F.coalesce(F.try_element_at(held, F.lit(1)), F.lit(otherwise))


def error_pattern(failure: Column, error: Column, code: Column, raw: Column, diagnostic: Column | None = None, first_kind: Column | None = None) -> Column:
    """The rule bucket of a failed response: by its kind of failure and what the error text, the source and the verifier's diagnostics show."""
    text, shown = F.lower(F.coalesce(error, F.lit(""))), F.coalesce(code, F.lit(""))
    kind, first = (F.lit(None).cast("string") if c is None else c for c in (diagnostic, first_kind))
    named = F.array_intersect(F.array(*(F.lit(n.lower()) for n in RUNTIME_ERRORS)), F.regexp_extract_all(text, F.lit("(" + "|".join(n.lower() for n in RUNTIME_ERRORS) + ")"), F.lit(1)))
    refused = text.contains("invalid syntax")
    by_kind = {
        "syntax_error": _first([
            (text.contains("unexpected indent"), "syntax_unexpected_indent"), (refused & shown.rlike(r"\)\s+def\s+"), "syntax_duplicate_function_after_return"),
            (refused & F.coalesce(raw, F.lit("")).contains("```"), "syntax_markdown_or_fence_artifact"), (text.rlike("was never closed|unexpected eof"), "syntax_truncated_or_unclosed_block"),
        ], "syntax_malformed_code"),
        "runtime_error": F.when(kind == "exception_on_case", "runtime_exception_on_test_case").otherwise(F.coalesce(F.concat(F.lit("runtime_"), F.regexp_replace(F.try_element_at(named, F.lit(1)), "error$", "_error")), F.lit("runtime_other_exception"))),
        "logic_error": F.when(first.isin(*OUTPUT_KINDS), F.concat(F.lit("logic_"), F.regexp_replace(first, "^wrong_", "wrong_output_"))).otherwise("logic_wrong_output"),
        "timeout": F.lit("timeout_nonterminating_or_too_slow"), "generation_failure": F.lit("generation_empty_or_non_code"),
    }
    found = F.coalesce(*(F.when(failure == k, v) for k, v in by_kind.items()), F.lit("unknown_failure"))
    return F.when(kind == "missing_required_interface", "runtime_missing_required_interface").otherwise(found)


def interface_names(signatures: Column) -> Column:
    """Names in an interface, sorted and distinct: of ``def`` and ``class`` lines, and bare names."""
    def name(v: Column) -> Column:
        return or_else(F.regexp_extract(v, r"\b(?:def|class)\s+([A-Za-z_]\w*)", 1), F.when(F.trim(v).rlike(r"^[A-Za-z_]\w*$"), F.trim(v)))

    return F.array_sort(F.array_distinct(F.array_compact(F.transform(signatures, name))))


def called_names(prompt: Column, marker: str = "The evaluator calls:") -> Column:
    """Names that a prompt lists behind a marker, up to an empty line; none without it."""
    listed = F.regexp_extract(F.coalesce(prompt, F.lit("")), "(?m)^[ \\t]*" + _quoted(marker) + r"[ \t]*\r?\n([^\n]*)", 1)
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(listed, ","), lambda x: F.trim(x)), lambda x: x.rlike(r"^[A-Za-z_]\w*$"))))


def defines_named(code: Column, names: Column) -> Column:
    """Whether the code has a ``def`` or ``class`` line of every name; true for no names."""
    defined = F.regexp_extract_all(F.coalesce(code, F.lit("")), F.lit(r"\b(?:def|class)\s+([A-Za-z_]\w*)"), F.lit(1))
    return F.size(F.array_except(F.coalesce(names, F.array().cast("array<string>")), defined)) == 0


def _labelled(text: Column, label: str, value: str) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?im)^\s*{label}\s*[:=]\s*\W*({value})", 1), F.lit(""))


def confidence(text: Column) -> Column:
    """low, medium or high of a labelled line, in lower case; null without one."""
    return F.lower(_labelled(text, "confidence", r"low|medium|high\b"))


def primary_error(text: Column) -> Column:
    """The identifier on a line ``Primary error:``; null without one."""
    return _labelled(text, r"primary[ _]error", r"[A-Za-z_]\w*")


def phrases_in(text: Column, phrases: tuple[str, ...]) -> Column:
    """Those of the phrases that a text contains, ignoring case, in the given order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*(F.lit(p) for p in phrases)), lambda p: F.contains(low, F.lower(p)))


#: Labels of failed responses, the kinds of failure that say them, and their confidence.
LABEL_OF_FAILURE = {"runtime_error": ("runtime_exception_or_timeout", "high"), "timeout": ("runtime_exception_or_timeout", "medium")}


def deterministic_label(passed: Column, finish: Column, failure: Column, parseable: Column, interface: Column) -> Column:
    """(label, source, confidence) that the record itself shows; null for passed ones and where nothing shows."""
    def said(label: str, source: str, sure: str) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit("deterministic_" + source).alias("source"), F.lit(sure).alias("confidence"))

    shows = [
        (finish == "length", said("truncation_or_overgeneration", "finish_reason", "high")), (failure == "generation_failure", said("unclear_other_or_not_failure", "generation_failure", "medium")),
        ((failure == "syntax_error") | ~F.coalesce(parseable, F.lit(False)), said("syntax_or_parse_error", "parse_or_syntax", "high")), (~F.coalesce(interface, F.lit(True)), said("interface_contract_error", "interface_missing", "high")),
        *((failure == k, said(label, k, sure)) for k, (label, sure) in LABEL_OF_FAILURE.items()),
    ]
    return F.when(~F.coalesce(passed, F.lit(False)), F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), v) for c, v in shows)))


#: Categories of failures and the tokens that say them, in the order in which they are looked for.
CATEGORY_TOKENS = {
    "format_or_duplicate_code_output": (("syntax",), ("duplicate", "markdown", "format")),
    "syntax_parseability_or_truncation": (("syntax",),),
    "interface_name_signature_mismatch": (("interface", "nameerror"),),
    "runtime_api_type_misuse": (("runtime", "typeerror"),),
    "termination_or_complexity_control": (("timeout",),),
    "string_regex_pattern_logic": (("regex", "pattern", "string"),),
    "edge_case_boundary_handling": (("edge", "empty", "duplicate", "boundary", "does handle", "handle cases"),),
    "numeric_formula_correctness": (("number", "numeric", "formula", "ceil", "floor", "triangle", "integer"),),
    "output_type_container_shape": (("wrong_output_type", "wrong_output_length", "tuple", "list"),),
}


def category_of(text: Column) -> Column:
    """The first category of CATEGORY_TOKENS whose every group has a token in the text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    any_of = lambda words: keyword_hits(low, words) > 0
    holds = [(any_of(groups[0]) if len(groups) == 1 else any_of(groups[0]) & any_of(groups[1]), name) for name, groups in CATEGORY_TOKENS.items()]
    return _first(holds, "algorithmic_wrong_value")


def problem_number(text: Column) -> Column:
    """The number at the end of an identifier's base name; null without one."""
    return F.nullif(F.regexp_extract(text, r"/(\d+)(?:__.*)?$", 1), F.lit("")).cast("long")
