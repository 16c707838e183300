"""Queries over prompts, labels, deterministic scores, suites and categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions import jsonfn as N, pyast as Y, text as T
from lodestack.operators import execute as E, filters as W, projections as P, prompts as R, scoring as S, taxonomy as L
from lodestack.plans.tables import FAILURES, JUDGMENTS, PROBLEMS, RESPONSES, SFT, derived, judgments, once, problems, responses

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_NL = "chr(10)"
_STRIP = lambda c: f"trim({c}, chr(10) || chr(13) || chr(9) || ' ')"
_CLIP = lambda c, n, suffix=f"{_NL} || '[TRUNCATED]'": f"substr({_STRIP(f'coalesce({c}, {chr(39) * 2})')}, 1, {n}) || case when length({_STRIP(f'coalesce({c}, {chr(39) * 2})')}) > {n} then {suffix} else '' end"
_IFACE = f"case when len(coalesce(r.interface_names, [])) > 0 then array_to_string(r.interface_names, {_NL}) else 'stdin/stdout program' end"
_BLOCK = lambda title, body: f"{_NL} || {_NL} || '{title}:' || {_NL} || coalesce({body}, '')"
_FAILED = "not coalesce(r.passed, false)"


@query(f"""select dataset || '/' || case when dataset = 'humanevalplus' then 'test' else b.split end || '/' || regexp_extract(id, '/(\\d+)(?:__.*)?$', 1) as id, dataset,
 case when dataset = 'apps' and coalesce(case when starts_with(trim(t), '{{') then json_extract_string(t, '$.fn_name') end, '') = '' then 'stdin_stdout' else 'function_call' end as io_mode,
 md5('Solve the task in Python.' || {_NL} || {_NL} || 'Task:' || {_NL} || {_STRIP("prompt")} || case when dataset = 'apps' and coalesce(case when starts_with(trim(t), '{{') then json_extract_string(t, '$.fn_name') end, '') = '' then {_NL} || {_NL} || 'Read standard input, write standard output.' else '' end) as prompt_md5
 from (select *, case when starts_with(trim(input_output), '"') then input_output::json ->> '$' else input_output end as t, (('0x' || substr(sha1(regexp_extract(id, '/(\\d+)(?:__.*)?$', 1)), 1, 8))::bigint) % 100 as bucket from {PROBLEMS} where dataset in ('mbpp', 'humanevalplus', 'bigcodebench', 'apps')) p,
 lateral (select case when bucket < 80 then 'train' when bucket < 90 then 'validation' else 'test' end as split) b""")
def benchmark_prompts(spark, d):
    """The problems in the shape of their public sources, made into prompt rows again; splits by hash."""
    rows = problems(spark, d, "dataset", "prompt", "canonical_solution", "input_output")
    number = F.regexp_extract("id", r"/(\d+)(?:__.*)?$", 1)
    out = None
    for name, at in P.LAYOUTS.items():
        source = rows.where(F.col("dataset") == name).select(number.alias(at["id"]), F.col("prompt").alias(at["task"]), F.col("canonical_solution").alias(at["solution"]), N.unwrapped(F.col("input_output")).alias(at["tests"]))
        part = P.prompt_rows(source, name).select("id", "dataset", "io_mode", F.md5("prompt").alias("prompt_md5"))
        out = part if out is None else out.unionAll(part)
    return out


@query(f"""select r.response_id, md5('Repair the program. Hidden tests rejected it; they are not shown.' || {_NL} || 'Answer with Python source only.' || {_NL} || {_NL} || 'Estimated chance that the program passes: ' || case when j.p is null then 'null' else printf('%.4f', j.p) end || {_BLOCK("Interface", _IFACE)} || {_BLOCK("Task", "p.prompt")} || {_BLOCK("Rejected program", "coalesce(nullif(r.extracted_code, ''), r.generated_code)")} || {_NL} || {_NL} || 'Repaired program:' || {_NL}) as prompt_md5,
 case when j.p >= 0.6 then 'critic_false_positive_train' when j.p >= 0.45 then 'critic_borderline_failed_train' when r.finish_reason = 'length' then 'truncation_repair_train' when r.io_mode = 'stdin_stdout' then 'stdin_stdout_failed_train' else 'failed_train_coverage' end as reason
 from {RESPONSES} r join {PROBLEMS} p on r.id = p.id left join (select response_id, case when not isnan(overall_score) then overall_score / 5 end as p from {JUDGMENTS}) j on r.response_id = j.response_id where {_FAILED} and r.split = 'train'""")
def repair_candidates(spark, d):
    r = responses(spark, d, "id", "split", "passed", "interface_names", "extracted_code", "generated_code", "finish_reason", "io_mode").where("split = 'train' and not coalesce(passed, false)")
    p = judgments(spark, d, "overall_score").select("response_id", (F.nanvl("overall_score", F.lit(None).cast("double")) / 5).alias("p"))
    rows = r.join(problems(spark, d, "prompt"), "id").join(p, "response_id", "left")
    prompt = R.repair_prompt(F.col("prompt"), T.or_else(F.col("extracted_code"), F.col("generated_code")), F.col("interface_names"), F.col("p"))
    return rows.select("response_id", F.md5(prompt).alias("prompt_md5"), R.repair_reason(F.col("p"), 0.6, F.col("finish_reason"), F.col("io_mode")).alias("reason"))


@query(f"""select response_id || '__repair0' as response_id, response_id as original_response_id, md5('State what the program must do: inputs, outputs, rules and edge cases. Write no code.' || {_BLOCK("Interface", _IFACE)} || {_BLOCK("Task", "p.prompt")} || {_NL}) as specification_md5,
 md5('Repair the program so that it meets the specification.' || {_NL} || 'Answer with Python source only.' || {_BLOCK("Interface", _IFACE)} || {_BLOCK("Task", "p.prompt")} || {_BLOCK("Specification", "p.difficulty")} || {_BLOCK("Rejected program", "r.extracted_code")} || {_NL} || {_NL} || 'Repaired program:' || {_NL}) as prompt_md5 from {RESPONSES} r join {PROBLEMS} p on r.id = p.id where {_FAILED} and r.split = 'train'""")
def two_stage_repairs(spark, d):
    r = responses(spark, d, "id", "split", "passed", "interface_names", "extracted_code", "generated_code", "finish_reason").where("split = 'train' and not coalesce(passed, false)")
    rows = r.join(problems(spark, d, "prompt", "difficulty"), "id")
    record = R.two_stage_record(F.col("response_id"), F.lit(0), F.col("difficulty"), F.col("generated_code"), F.col("finish_reason"))
    first = R.specification_prompt(F.col("prompt"), F.col("interface_names"))
    second = R.specified_repair_prompt(F.col("prompt"), F.col("extracted_code"), F.col("interface_names"), F.col("difficulty"))
    return rows.select(*record[:2], F.md5(first).alias("specification_md5"), F.md5(second).alias("prompt_md5"))


_PAIRS = f"(select r.response_id, o.extracted_code as a, r.extracted_code as b, o.passed as pa, r.passed as pb, r.id, o.error as error from {RESPONSES} r join {RESPONSES} o on r.original_response_id = o.response_id where coalesce(r.passed, false) <> coalesce(o.passed, false))"


@query(f"""select x.response_id, md5('Which program solves the task?' || {_NL} || 'State A or B first, then the reason.' || {_BLOCK("Task", _CLIP("p.prompt", 4500))} || {_BLOCK("Program A", _CLIP("x.a", 4500))} || {_BLOCK("Program B", _CLIP("x.b", 4500))} || {_NL}) as prompt_md5,
 'Better: ' || case when coalesce(pa, false) then 'A' else 'B' end || {_NL} || 'Reason: ' || coalesce(trim(regexp_replace(x.error, '\\s+', ' ', 'g')), 'no reason recorded') as completion from {_PAIRS} x join {PROBLEMS} p on x.id = p.id""")
def pair_judgments(spark, d):
    """Repairs and the answers they repair, of which just one passes, as a choice."""
    r = responses(spark, d, "id", "original_response_id", "passed", "extracted_code", "error")
    o = r.select(F.col("response_id").alias("original_response_id"), F.coalesce("passed", F.lit(False)).alias("pa"), F.col("extracted_code").alias("a"), F.col("error").alias("why"))
    pairs = r.where("original_response_id is not null").join(o, "original_response_id").where("coalesce(passed, false) <> pa").join(problems(spark, d, "prompt"), "id")
    return pairs.select("response_id", F.md5(R.pair_prompt(F.col("prompt"), F.col("a"), F.col("extracted_code"))).alias("prompt_md5"), R.pair_completion(F.when(F.col("pa"), "A").otherwise("B"), F.col("why")).alias("completion"))


@query(f"""select r.response_id, md5('Write 5 tests as a JSON object with fn_name and tests, a list of objects with args and expected.' || {_NL} || 'Function: ' || coalesce(r.interface_names[1], 'unknown') || {_BLOCK("Task", "p.prompt")} || {_BLOCK("Suspect program", "r.extracted_code")} || {_NL}) as prompt_md5 from {RESPONSES} r join {PROBLEMS} p on r.id = p.id where {_FAILED} and r.io_mode = 'function_call'""")
def test_requests(spark, d):
    r = responses(spark, d, "id", "passed", "io_mode", "interface_names", "extracted_code").where("io_mode = 'function_call' and not coalesce(passed, false)").join(problems(spark, d, "prompt"), "id")
    prompt = R.test_prompt(F.col("prompt"), F.col("extracted_code"), F.try_element_at("interface_names", F.lit(1)), 5)
    return r.select("response_id", F.md5(prompt).alias("prompt_md5"))


@query(f"""select r.response_id, md5('Name the root cause of the failure in one sentence. Quote no test values.' || {_NL} || 'Kind: ' || coalesce(r.failure_type, 'unknown') || {_NL} || 'Error: ' || {_CLIP("r.error", 200, "'...'")} || {_BLOCK("Task", _CLIP("p.prompt", 600, "'...'"))} || {_BLOCK("Program", _CLIP("r.extracted_code", 900, "'...'"))} || {_NL}) as prompt_md5 from {RESPONSES} r join {PROBLEMS} p on r.id = p.id where {_FAILED}""")
def summary_requests(spark, d):
    r = responses(spark, d, "id", "passed", "failure_type", "error", "extracted_code").where("not coalesce(passed, false)").join(problems(spark, d, "prompt"), "id")
    return r.select("response_id", F.md5(R.summary_prompt(F.col("failure_type"), F.col("error"), F.col("prompt"), F.col("extracted_code"))).alias("prompt_md5"))


_NAMED = "len(list_filter(coalesce(r.interface_names, []), lambda n: not list_contains(regexp_extract_all(coalesce(r.extracted_code, ''), '\\b(?:def|class)\\s+([A-Za-z_]\\w*)', 1), n))) = 0"
_DEP = " or ".join(f"(contains(coalesce(r.extracted_code, ''), '{u}') and not contains(coalesce(r.extracted_code, ''), '{i}'))" for u, i in S.NEEDS.items())


@query(f"""with c as (select response_id, coalesce(failure_type, '') <> 'syntax_error' as parse_ok, {_NAMED} as interface_ok, {_DEP} as missing_dep, regexp_matches(coalesce(extracted_code, ''), '\\b(?:pass|TODO|NotImplementedError)\\b') as stub from {RESPONSES} r)
 select *, case when parse_ok then 5 else 1 end as syntax_score, case when parse_ok and not missing_dep then 4 else 2 end as runtime_score, case when not (parse_ok and interface_ok) then 2 when stub then 1 else 4 end as other_score from c""")
def code_checks(spark, d):
    """What can be told of a program without running it; that it parses is taken from its kind of failure."""
    checked = derived(spark, d, "responses", "response_id", S.code_checks(F.col("extracted_code"), ~F.col("failure_type").eqNullSafe("syntax_error"), F.col("interface_names")).alias("c"))
    scores = S.fallback_scores(F.col("c"), ["syntax_parseability_truncation", "runtime_api_type_misuse", "edge_case_handling"])
    return checked.select("response_id", "c.*", scores.alias("s")).select("response_id", "parse_ok", "interface_ok", "missing_dep", "stub", *(F.col("s")[k].alias(n) for k, n in (("syntax_parseability_truncation", "syntax_score"), ("runtime_api_type_misuse", "runtime_score"), ("edge_case_handling", "other_score"))))


_LINES = "len(list_filter(string_split(coalesce(r.extracted_code, ''), chr(10)), lambda x: trim(x) <> ''))"


@query(f"""with f as (select response_id, coalesce(passed, false) as ok, coalesce(failure_type, 'unknown_failure') as kind, trim(coalesce(extracted_code, '')) = '' as e, coalesce(failure_type, '') = 'syntax_error' as u, coalesce(finish_reason, '') = 'length' or {_LINES} >= 50 as l, contains(coalesce(generated_code, ''), '```') as m, coalesce(io_mode, '') = 'function_call' and not ({_NAMED}) as i from {RESPONSES} r),
 s as (select *, least(5, case when e or u then 1 else 5 end, case when l then 2 else 5 end, case when not ok and kind in ('syntax_error', 'generation_failure') then 1 else 5 end) as a, case when i then 1 else 5 end as b,
 case when ok then 5 when kind = 'runtime_error' then 1 when kind = 'timeout' then 2 else 5 end as c, case when not ok and kind = 'logic_error' then 4 else 5 end as o, case when ok then 5 when kind = 'logic_error' then 2 when kind in ('syntax_error', 'runtime_error', 'timeout', 'generation_failure') then 5 else 3 end as g,
 least(5, case when e then 1 else 5 end, case when l or m then 2 else 5 end, case when not ok and kind = 'generation_failure' then 1 else 5 end) as w from f),
 t as (select *, (a * 1.25 + b * 1.2 + c * 1.1 + o * 0.9 + g * 1.25 + w * 0.85)::double / (1.25 + 1.2 + 1.1 + 0.9 + 1.25 + 0.85) as mean, least(a, b, c, w) as floor from s)
 select response_id, round_even((case when floor <= 1 then least(mean, 2) when floor = 2 then least(mean, 3) else mean end)::double, 4) as overall, (case when floor <= 1 then least(mean, 2) when floor = 2 then least(mean, 3) else mean end) >= 4 as predicted_pass from t""")
def deterministic_scores(spark, d):
    """The six-dimension score from what the record shows; that a program parses is taken from its kind of failure."""
    code = F.coalesce("extracted_code", F.lit(""))
    found = {
        "empty": F.trim(code) == "", "unparseable": F.col("failure_type") == "syntax_error", "long": F.col("finish_reason").eqNullSafe("length") | (T.line_count(F.col("extracted_code")) >= 50), "fence": F.col("generated_code").contains("```"),
        "interface": (F.col("io_mode") == "function_call") & ~T.defines_named(F.col("extracted_code"), F.col("interface_names")),
    }
    return derived(spark, d, "responses", "response_id", S.deterministic_score(found, F.col("passed"), F.col("failure_type")).alias("s")).select("response_id", "s.overall", "s.predicted_pass")


@query(f"""with q as (select case when not coalesce(r.passed, false) then 'not_verifier_passed' when not coalesce(j.predicted_pass, false) then 'not_predicted_pass_by_tests' when coalesce(case when not isnan(j.overall_score) then j.overall_score / 5 end, 0) < 0.5 then 'test_score_too_low' end as reason, len(coalesce(r.interface_names, [])) > 0 as suite from {RESPONSES} r left join {JUDGMENTS} j on r.response_id = j.response_id)
 select case when reason is null then case when suite then 'strict_rubric' else 'verifier_pass' end end as tier, reason, count(*) as rows from q group by all""")
def quality_tiers(spark, d):
    r = responses(spark, d, "passed", "interface_names").join(judgments(spark, d, "predicted_pass", "overall_score"), "response_id", "left")
    names = F.coalesce("interface_names", F.array().cast("array<string>"))
    tier = E.quality_tier(F.col("passed"), F.col("predicted_pass"), F.col("overall_score") / 5, F.array_join(names, ","), F.size(names), 0.5)
    return r.select(tier.alias("t")).groupBy("t.tier", "t.reason").agg(F.count("*").alias("rows"))


@query(f"""with s as (select id, response_id, ['"' || coalesce(difficulty, 'none') || '"', '"' || coalesce(finish_reason, 'none') || '"', '"' || coalesce(model, 'none') || '"'] as t from {RESPONSES} where id is not null), k as (select id, t, row_number() over (partition by id order by response_id) as rank, count(*) over (partition by id) as suites from s),
 e as (select id, rank, suites, unnest(t) as x, unnest(range(3)) as i from k), f as (select id, x, min(rank * 10 + i) as place, any_value(suites) as suites from e group by id, x)
 select id, '[' || string_agg(x, ',' order by place) || ']' as tests, count(*) as test_count, any_value(suites) as suites from f group by id""")
def suite_union(spark, d):
    """The distinct tests of a task's suites in the order of the suites; here each response's labels stand for a suite."""
    r = responses(spark, d, "id", "difficulty", "finish_reason", "model").where("id is not null")
    tests = F.to_json(F.array(*(F.coalesce(c, F.lit("none")) for c in ("difficulty", "finish_reason", "model"))))
    return E.merged_suites(r.withColumn("cases", tests), "id", "cases", [F.asc("response_id")]).select("id", "tests", "test_count", F.col("suites").cast("long").alias("suites"))



@query(f"""select case when n = 4 then 'runtime_missing_required_interface' when failure_type = 'logic_error' then case n when 0 then 'logic_wrong_output_type' when 1 then 'logic_wrong_output_length' when 2 then 'logic_wrong_output_value' else 'logic_wrong_output' end when n = 3 then 'runtime_exception_on_test_case' else 'other' end as pattern, count(*) as rows
 from (select failure_type, length(response_id) % 5 as n from {RESPONSES} where failure_type in ('logic_error', 'runtime_error')) group by 1""")
def diagnosed_patterns(spark, d):
    """Error patterns with a verifier's diagnostics; here the length of the key stands for them."""
    r = responses(spark, d, "failure_type", "error").where("failure_type in ('logic_error', 'runtime_error')").withColumn("n", F.length("response_id") % 5)
    kind = F.when(F.col("n") == 3, "exception_on_case").when(F.col("n") == 4, "missing_required_interface")
    first = F.element_at(F.array(*map(F.lit, (*T.OUTPUT_KINDS, "other", "other"))), F.col("n") + 1)
    pattern = T.error_pattern(F.col("failure_type"), F.col("error"), F.lit(""), F.lit(""), kind, first)
    shown = F.when(pattern.startswith("logic_") | pattern.isin("runtime_exception_on_test_case", "runtime_missing_required_interface"), pattern).otherwise("other")
    return r.groupBy(shown.alias("pattern")).agg(F.count("*").alias("rows"))


_HAS = lambda ws: "(" + " or ".join(f"contains(t, '{w}')" for w in ws) + ")"
_CATEGORY = " ".join("when " + " and ".join(_HAS(g) for g in groups) + f" then '{name}'" for name, groups in T.CATEGORY_TOKENS.items())


@query(f"select case {_CATEGORY} else 'algorithmic_wrong_value' end as category, count(*) as rows from (select lower(concat_ws(' ', error_pattern, llm_summary)) as t from {FAILURES}) group by 1")
def fallback_categories(spark, d):
    rows = once(spark, d, "failures", "response_id", "error_pattern", "llm_summary")
    return rows.groupBy(T.category_of(F.concat_ws(" ", "error_pattern", "llm_summary")).alias("category")).agg(F.count("*").alias("rows"))


@query(f"""select x.l as label, x.s as label_source, x.c as confidence, count(*) as rows from (select case when finish_reason = 'length' then {{'l': 'truncation_or_overgeneration', 's': 'deterministic_finish_reason', 'c': 'high'}} when failure_type = 'generation_failure' then {{'l': 'unclear_other_or_not_failure', 's': 'deterministic_generation_failure', 'c': 'medium'}}
 when failure_type = 'syntax_error' then {{'l': 'syntax_or_parse_error', 's': 'deterministic_parse_or_syntax', 'c': 'high'}} when not ({_NAMED}) then {{'l': 'interface_contract_error', 's': 'deterministic_interface_missing', 'c': 'high'}} when failure_type = 'runtime_error' then {{'l': 'runtime_exception_or_timeout', 's': 'deterministic_runtime_error', 'c': 'high'}}
 when failure_type = 'timeout' then {{'l': 'runtime_exception_or_timeout', 's': 'deterministic_timeout', 'c': 'medium'}} end as x from {RESPONSES} r where {_FAILED}) group by all""")
def deterministic_labels(spark, d):
    r = responses(spark, d, "passed", "finish_reason", "failure_type", "interface_names", "extracted_code").where("not coalesce(passed, false)")
    label = T.deterministic_label(F.col("passed"), F.col("finish_reason"), F.col("failure_type"), F.lit(True), T.defines_named(F.col("extracted_code"), F.col("interface_names")))
    return r.select(label.alias("x")).groupBy(F.col("x.label").alias("label"), F.col("x.source").alias("label_source"), F.col("x.confidence").alias("confidence")).agg(F.count("*").alias("rows"))


@query(f"select id, list_sort(list_distinct(list_filter(list_transform(string_split(regexp_extract(coalesce(prompt, ''), '(?m)^[ \\t]*The evaluator calls:[ \\t]*\\r?\\n([^\\n]*)', 1), ','), lambda x: trim(x)), lambda x: regexp_full_match(x, '[A-Za-z_]\\w*')))) as names from {PROBLEMS}")
def prompted_names(spark, d):
    return problems(spark, d, "prompt").select("id", T.called_names(F.col("prompt")).alias("names"))


@query(f"select response_id, list_filter(['root cause', 'never refreshes', 'in most runs', 'as far as we can tell'], lambda p: contains(lower(coalesce(llm_summary, '')), p)) as phrases from {FAILURES}")
def phrase_hits(spark, d):
    return once(spark, d, "failures", "response_id", "llm_summary").select("response_id", T.phrases_in(F.col("llm_summary"), ("root cause", "never refreshes", "in most runs", "as far as we can tell")).alias("phrases"))


@query(f"""with v as (select s.id, upper(coalesce(nullif(regexp_extract(lower(completion), '(?m)^\\s*(?:verdict|label|answer)\\s*[:=]\\s*\\W*(pass|fail)', 1), ''), nullif(regexp_extract(lower(completion), '^\\W*(pass|fail)(?:ed|s)?\\b', 1), ''))) as verdict, length(id) % 2 = 0 as gold from {SFT} s where task_type = 'single_judge')
 select count(*) as rows, count(*) filter (verdict is null) as unparsed, count(*) filter (gold and coalesce(verdict = 'PASS', not gold)) as tp, count(*) filter (not gold and not coalesce(verdict = 'PASS', not gold)) as tn, count(*) filter (not gold and coalesce(verdict = 'PASS', not gold)) as fp, count(*) filter (gold and not coalesce(verdict = 'PASS', not gold)) as fn from v""")
def verdict_evaluation(spark, d):
    """Verdicts against labels, those that can't be read as wrong ones; here the length of the key stands for the label."""
    rows = once(spark, d, "sft_records", "id", "task_type", "completion").where("task_type = 'single_judge'").withColumn("gold", F.length("id") % 2 == 0)
    v = rows.select("gold", T.verdict(F.col("completion")).alias("verdict")).withColumn("said", S.judged_pass(F.col("verdict"), F.col("gold")))
    return v.agg(F.count("*").alias("rows"), F.count_if(F.col("verdict").isNull()).alias("unparsed"), F.count_if(F.col("gold") & F.col("said")).alias("tp"), F.count_if(~F.col("gold") & ~F.col("said")).alias("tn"), F.count_if(~F.col("gold") & F.col("said")).alias("fp"), F.count_if(F.col("gold") & ~F.col("said")).alias("fn"))


@query(f"""with c as (select coalesce(failure_type, 'other') as c, coalesce(error_pattern, 'unknown') as p, count(*) as n from {FAILURES} group by all), g as (select c, sum(n) as n, count(*) as k from c group by 1), t as (select sum(n) as t from g),
 m as (select case when g.k > 1 and g.n > 0.3 * t.t then c.c || '__' || c.p else c.c end as name, c.n from c join g using (c), t), s as (select name, sum(n) as n from m group by 1), r as (select name, n, row_number() over (order by n desc, name) as r, count(*) over () as total from s)
 select case when r <= case when total <= 8 then 8 else 7 end then name else 'other' end as operational, sum(n)::bigint as rows from r group by 1""")
def operational_categories(spark, d):
    """Kinds of failure as categories: broad ones split by pattern, and the smallest merged."""
    rows = once(spark, d, "failures", "response_id", "failure_type", "error_pattern")
    return L.resized_categories(rows, "failure_type", "error_pattern", 1, 8, 0.3).groupBy("operational").agg(F.count("*").alias("rows"))


_WORDS = lambda c: f"len(list_filter(regexp_split_to_array(trim(coalesce({c}, '')), '\\s+'), lambda w: w <> ''))"
_ANY = lambda c, ps: "(" + " or ".join(f"contains(lower(trim(coalesce({c}, ''))), '{p}')" for p in ps) + ")"
_COST = lambda c, n: f"case when trim(coalesce({c}, '')) = '' then 20 else case when {_WORDS(c)} < {n} then 10 else 0 end + case when {_ANY(c, L.GENERIC)} then 15 else 0 end + case when {_ANY(c, L.LEAKS)} then 40 else 0 end end"


@query(f"""with q as (select failure_type as category, response_id, greatest(0, 100 - ({_COST("llm_summary", 8)}) - ({_COST("error", 4)}) - ({_COST("error_pattern", 4)}) - ({_COST("split", 4)})) as score from {FAILURES})
 select category, response_id, score, score >= 60 as accepted from q qualify row_number() over (partition by category order by score desc, response_id) = 1""")
def best_definitions(spark, d):
    """The best of each category's candidates; here a failure's summary, error, pattern and split stand for the parts of a definition."""
    rows = once(spark, d, "failures", "response_id", "failure_type", "llm_summary", "error", "error_pattern", "split").withColumnRenamed("failure_type", "category")
    fields = {"definition": F.col("llm_summary"), "include": F.col("error"), "exclude": F.col("error_pattern"), "checks": F.col("split")}
    return L.best_definitions(rows, "category", "response_id", fields).select("category", "response_id", F.col("quality.score").alias("score"), "accepted")


@query(f"""with l as (select r.*, case when finish_reason = 'length' then 'deterministic_finish_reason' when failure_type = 'generation_failure' then 'deterministic_generation_failure' when failure_type = 'syntax_error' then 'deterministic_parse_or_syntax' when not ({_NAMED}) then 'deterministic_interface_missing' when failure_type = 'runtime_error' then 'deterministic_runtime_error' when failure_type = 'timeout' then 'deterministic_timeout' end as s,
 (select any_value(error_pattern) from {FAILURES} f where f.response_id = r.response_id and f.error_pattern <> 'unknown') as human from {RESPONSES} r where {_FAILED} and r.id is not null)
 select case when b < 80 then 'train' when b < 90 then 'validation' else 'test' end as train_split, case when human is not null then 'human' else s end as label_source, count(*) as rows from (select *, (('0x' || substr(sha1(id), 1, 8))::bigint) % 100 as b from l) group by all""")
def evaluator_rows(spark, d):
    """Rows for training an evaluator: the task's split, a person's label before a deterministic one, no private columns."""
    from lodestack.functions import hashing as H

    r = responses(spark, d, "id", "passed", "finish_reason", "failure_type", "interface_names", "extracted_code", "error").where("id is not null and not coalesce(passed, false)")
    human = once(spark, d, "failures", "response_id", "error_pattern").where("error_pattern <> 'unknown'").select("response_id", F.col("error_pattern").alias("human"))
    label = T.deterministic_label(F.col("passed"), F.col("finish_reason"), F.col("failure_type"), F.lit(True), T.defines_named(F.col("extracted_code"), F.col("interface_names")))
    rows = L.training_rows(r.join(human, "response_id", "left"), H.split_by_bucket(H.bucket_sha1(F.col("id")), 80, 10), F.col("human"), label, ("error", "passed"))
    return rows.groupBy("train_split", "label_source").agg(F.count("*").alias("rows"))


@query(f"""select 'item-' || substr(sha256(response_id), 1, 12) as item_id, response_id, coalesce(failure_type, 'unknown') as category, md5({_CLIP("extracted_code", 1600, "'...'")}) as code_md5, 'pending' as status from {RESPONSES} r where {_FAILED}""")
def review_stubs(spark, d):
    r = responses(spark, d, "passed", "failure_type", "extracted_code").where("not coalesce(passed, false)")
    items = r.select(*R.review_item(F.col("response_id"), F.coalesce("failure_type", F.lit("unknown")), F.lit(""), F.col("extracted_code"), "failed"))
    return items.select("item_id", "response_id", "category", F.md5("code").alias("code_md5"), "annotation.status")


@query()
def cluster_names(spark, d):
    """Names of the kinds of failure by the words of their summaries."""
    return L.named_clusters(once(spark, d, "failures", "response_id", "failure_type", "llm_summary"), "failure_type", "llm_summary")


@query()
def visible_evidence(spark, d):
    """Tags of what can be seen of a program, and what they say of it."""
    r = Y.analysed(responses(spark, d, "extracted_code", "passed", "failure_type").where("extracted_code is not null"), "extracted_code")
    tags = Y.feature_tags(F.col("audit"), F.col("extracted_code"))
    return r.select("response_id", tags.alias("tags"), R.evidence(tags).alias("evidence"), Y.hard_positive(tags).alias("hard_positive"), Y.visible_negative(tags, F.col("failure_type")).alias("visible_negative"))


@query()
def assert_executions(spark, d):
    """Canonical solutions of function tasks against their cases as assert statements, in a child process each."""
    t = N.unwrapped(F.col("input_output"))
    rows = problems(spark, d, "input_output", "canonical_solution").where("canonical_solution is not null").select("id", "canonical_solution", F.from_json(t, "inputs array<array<string>>, outputs array<string>, fn_name string").alias("c")).where("c.fn_name is not null")
    each = F.transform(F.arrays_zip("c.inputs", "c.outputs"), lambda x: F.concat(F.lit("assert "), F.col("c.fn_name"), F.lit("("), F.array_join(x["inputs"], ", "), F.lit(") == "), x["outputs"]))
    run = E.adapted(rows, {"dataset": F.lit("mbpp"), "code": F.col("canonical_solution"), "asserts": each, "names": F.array("c.fn_name")}, timeout=2.0)
    return run.select("id", "run.passed", "run.failure_type", "run.first_kind", "run.test_count", "run.pass_count")


_FN = "json_extract_string(case when starts_with(trim(t), '{') then t end, '$.fn_name')"


@query(f"""select reason, training, count(*) as rows from (select case when coalesce(r.io_mode, '') <> 'function_call' then 'io_mode_not_function_call' when trim(coalesce({_FN}, '')) = '' then 'missing_fn_name' when trim(coalesce(p.canonical_solution, '')) = '' then 'missing_canonical_solution' when trim(coalesce(r.extracted_code, '')) = '' then 'missing_previous_repair_code' end as reason,
 coalesce(regexp_matches(r.split, '^train$|[/_]train$|/train/'), false) as training from {RESPONSES} r join (select *, case when starts_with(trim(input_output), '"') then input_output::json ->> '$' else input_output end as t from {PROBLEMS}) p on r.id = p.id where {_FAILED}) group by all""")
def fit_for_tests(spark, d):
    """Which failed answers can get generated tests, and which of them are training data."""
    r = responses(spark, d, "id", "split", "passed", "io_mode", "extracted_code").where("not coalesce(passed, false)")
    p = problems(spark, d, "canonical_solution", "input_output").select("id", "canonical_solution", F.get_json_object(N.unwrapped(F.col("input_output")), "$.fn_name").alias("fn"))
    rows = r.join(p, "id")
    reason = W.unfit_for_tests(F.col("io_mode"), F.col("fn"), F.col("canonical_solution"), F.col("extracted_code"))
    return rows.select(reason.alias("reason"), W.from_training(F.col("split")).alias("training")).groupBy("reason", "training").agg(F.count("*").alias("rows"))


@query(f"""select task_type, case when coalesce(eval_split, 'train') = 'train' then task_type in ('critic_repair', 'single_judge') else task_type = 'single_judge' end as allowed, count(*) as rows from {SFT} where task_type is not null group by all""")
def allowed_task_types(spark, d):
    rows = once(spark, d, "sft_records", "id", "eval_split", "task_type").where("task_type is not null")
    allowed = W.task_type_allowed(F.coalesce("eval_split", F.lit("train")), F.col("task_type"), ("critic_repair", "single_judge"), ("single_judge",))
    return rows.groupBy("task_type", allowed.alias("allowed")).agg(F.count("*").alias("rows"))


@query(f"""with known as (select distinct id from problems where eval_split is not null and id is not null), pool as (select r.*, p.prompt from {RESPONSES} r join {PROBLEMS} p on r.id = p.id where {_FAILED} and r.id not in (select id from known)),
 one as (select * from pool qualify row_number() over (partition by id order by response_id) = 1), n as (select greatest(0, (select count(*) from known) + 20 - (select count(*) from known)) as n)
 select id || '__gate' as id, id as problem_id, response_id as rejected_response_id from one qualify row_number() over (order by sha256('gate:' || id), id) <= 20""")
def gate_expansion(spark, d):
    """Twenty more problems for the held-out gate, from failed answers to problems outside it."""
    known = problems(spark, d, "eval_split").where("eval_split is not null").select("id")
    failed = responses(spark, d, "id", "passed", "generated_code", "extracted_code").where("not coalesce(passed, false)").join(problems(spark, d, "prompt"), "id")
    rows = P.gate_rows(failed, known, known.distinct().count() + 20, "gate")
    return rows.select("id", "problem_id", "rejected_response_id")


@query(f"select response_id, map_from_entries(list_filter([('diagnostic_kind', failure_type), ('exception_type', nullif(regexp_extract(coalesce(error, ''), '^(\\w*Error)', 1), '')), ('first_failure_kind', finish_reason)], lambda x: x[2] is not null)) as shown from {RESPONSES} r where {_FAILED}")
def shown_diagnostics(spark, d):
    """What of a verifier's diagnostics may be shown; here the record's own labels stand for them."""
    r = responses(spark, d, "passed", "failure_type", "error", "finish_reason").where("not coalesce(passed, false)")
    fields = {"diagnostic_kind": F.col("failure_type"), "exception_type": F.nullif(F.regexp_extract(F.coalesce("error", F.lit("")), r"^(\w*Error)", 1), F.lit("")), "first_failure_kind": F.col("finish_reason"), "stderr": F.col("error")}
    return r.select("response_id", N.safe_diagnostics(fields).alias("shown"))


@query()
def parsed_suites(spark, d):
    """Suites written out as a model would, some broken off, and read back."""
    t = N.unwrapped(F.col("input_output"))
    case = F.from_json(t, "inputs array<array<string>>, outputs array<string>, fn_name string")
    rows = problems(spark, d, "input_output").where("input_output is not null").select("id", case.alias("c")).where("c.fn_name is not null")
    tests = F.transform(F.arrays_zip("c.inputs", "c.outputs"), lambda x: F.struct(x["inputs"].alias("args"), x["outputs"].alias("expected")))
    text = F.concat(F.lit("Here are tests:\n```json\n"), F.to_json(F.struct(F.col("c.fn_name").alias("fn_name"), tests.alias("tests"))), F.lit("\n```"))
    raw = F.when(F.length("id") % 2 == 0, text).otherwise(F.substring(text, F.lit(1), F.length(text) * 3 / 4))
    return rows.select("id", N.parsed_suite(raw).alias("s")).select("id", "s.fn_name", "s.test_count", "s.status")
