"""Queries over the text, JSON and program functions and the row builders."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from lodestack.functions import jsonfn as N, pyast as Y, stats as X, text as T
from lodestack.operators import documents as D, execute as E, judging as JU, paired, projections as P, rubric as B, taxonomy as L, tokens as K
from lodestack.plans.tables import FAILURES, JUDGMENTS, PROBLEMS, RESPONSES, SFT, derived, judgments, once, problems, responses, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_FENCE = r"(?is)```(?:python)?\s*(.*?)```"
_X = f"case when regexp_matches(coalesce(generated_code, ''), '{_FENCE}') then regexp_extract(coalesce(generated_code, ''), '{_FENCE}', 1) else coalesce(generated_code, '') end"


@query(f"select response_id, md5({_X}) as code_md5, length({_X}) as chars from {RESPONSES}")
def extract_code(spark, d):
    code = T.extract_code(F.col("generated_code"))
    return derived(spark, d, "responses", "response_id", F.md5(code).alias("code_md5"), F.length(code).alias("chars"))


@query(f"select response_id, md5(array_to_string(list_filter(string_split(generated_code, chr(10)), lambda x: not starts_with(ltrim(x), '```')), chr(10))) as text_md5 from {RESPONSES}")
def strip_fence_lines(spark, d):
    return derived(spark, d, "responses", "response_id", F.md5(T.without_fence_lines(F.col("generated_code"))).alias("text_md5"))


@query(f"select response_id, substr(trim(error), 1, 12) || case when length(trim(error)) > 12 then '...' else '' end as error, length(error) as chars from {RESPONSES} where error is not null")
def clipped_errors(spark, d):
    return responses(spark, d, "error").where("error is not null").select("response_id", T.clipped(F.col("error"), 12).alias("error"), F.length("error").alias("chars"))


@query(f"select coalesce(nullif(substr(regexp_replace(regexp_replace(lower(error), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 64), ''), 'item') as slug, count(*) as rows from {RESPONSES} where error is not null group by 1")
def slug_counts(spark, d):
    return responses(spark, d, "error").where("error is not null").groupBy(T.slug(F.col("error")).alias("slug")).agg(F.count("*").alias("rows"))


@query("select doc_id, md5(trim(regexp_replace(text, '[\\s\\p{Z}\\x{0b}\\x{85}]+', ' ', 'g'))) as text_md5 from documents")
def collapsed_blanks(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.collapsed(F.col("text"))).alias("text_md5"))


@query(f"""select id, md5(trim(case when position('Task:' in prompt) > 0 then split_part(split_part(split_part(substr(prompt, position('Task:' in prompt) + 5), 'Python code:', 1), 'Read standard input', 1), 'The evaluator calls:', 1) else prompt end, chr(10) || ' ' || chr(9) || chr(13))) as task_md5 from {PROBLEMS}""")
def task_section(spark, d):
    task = T.section(F.col("prompt"), "Task:", ("Python code:", "Read standard input", "The evaluator calls:"))
    return derived(spark, d, "problems", "id", F.md5(task).alias("task_md5"))


@query(f"""select response_id, len(list_filter(string_split(coalesce(generated_code, ''), chr(10)), lambda x: trim(x) <> '')) as lines,
 case when regexp_matches(coalesce(generated_code, ''), '\\S') then len(regexp_extract_all(generated_code, '\\S+')) else 0 end as tokens from {RESPONSES}""")
def line_token_counts(spark, d):
    return derived(spark, d, "responses", "response_id", T.line_count(F.col("generated_code")).alias("lines"), T.token_count(F.col("generated_code")).alias("tokens"))


#: Words that stand for a kind of cause in a summary.
_LABELS = {"state": ("stale", "initialised", "never refreshes"), "input": ("input", "cases", "element"), "type": ("typeerror", "nameerror", "attributeerror"), "size": ("overflow", "overshoot", "underflow", "excess")}
_HITS = lambda ws: " + ".join(f"contains(lower(coalesce(llm_summary, '')), '{w}')::int" for w in ws)


@query(f"""with s as (select response_id, list_sort([{', '.join(f"{{'n': -({_HITS(w)}), 'label': '{k}'}}" for k, w in _LABELS.items())}]) as s from {FAILURES}) select response_id, case when s[1].n < 0 and s[2].n - s[1].n >= 1 then s[1].label else 'other' end as label from s""")
def keyword_labels(spark, d):
    return once(spark, d, "failures", "response_id", "llm_summary").select("response_id", T.best_label(F.col("llm_summary"), _LABELS, "other").alias("label"))


@query(f"select response_id, regexp_replace(llm_summary, '(?i)root cause|as far as we can tell', '[MASKED]', 'g') as masked from {FAILURES} where llm_summary is not null")
def masked_phrases(spark, d):
    return once(spark, d, "failures", "response_id", "llm_summary").where("llm_summary is not null").select("response_id", T.masked(F.col("llm_summary"), ("root cause", "as far as we can tell")).alias("masked"))


@query(f"select id, upper(coalesce(nullif(regexp_extract(lower(completion), '(?m)^\\s*(?:verdict|label|answer)\\s*[:=]\\s*\\W*(pass|fail)', 1), ''), nullif(regexp_extract(lower(completion), '^\\W*(pass|fail)(?:ed|s)?\\b', 1), ''))) as verdict from {SFT} where task_type = 'single_judge'")
def verdicts(spark, d):
    return once(spark, d, "sft_records", "id", "task_type", "completion").where("task_type = 'single_judge'").select("id", T.verdict(F.col("completion")).alias("verdict"))


@query(f"select response_id, len(list_filter(interface_names, lambda n: not list_contains(regexp_extract_all(coalesce(extracted_code, ''), '(?m)^\\s*(?:async\\s+)?def\\s+(\\w+)\\s*\\(', 1), n))) = 0 as defines_all from {RESPONSES} where interface_names is not null")
def interface_check(spark, d):
    rows = derived(spark, d, "responses", "response_id", F.when(F.col("interface_names").isNotNull(), T.defines_all(F.col("extracted_code"), F.col("interface_names"))).alias("defines_all"))
    return rows.where("defines_all is not null")


_ERR = "lower(coalesce(error, ''))"
_RUN = " ".join(f"when contains({_ERR}, '{n.lower()}') then 'runtime_{n.replace('Error', '').lower()}_error'" for n in T.RUNTIME_ERRORS)


@query(f"""select case failure_type when 'syntax_error' then case when contains({_ERR}, 'unexpected indent') then 'syntax_unexpected_indent' when contains({_ERR}, 'invalid syntax') and regexp_matches(coalesce(nullif(extracted_code, ''), generated_code, ''), '\\)\\s+def\\s+') then 'syntax_duplicate_function_after_return'
 when contains({_ERR}, 'invalid syntax') and contains(coalesce(generated_code, ''), '```') then 'syntax_markdown_or_fence_artifact' when contains({_ERR}, 'was never closed') or contains({_ERR}, 'unexpected eof') then 'syntax_truncated_or_unclosed_block' else 'syntax_malformed_code' end
 when 'runtime_error' then case {_RUN} else 'runtime_other_exception' end when 'logic_error' then 'logic_wrong_output' when 'timeout' then 'timeout_nonterminating_or_too_slow' when 'generation_failure' then 'generation_empty_or_non_code' else 'unknown_failure' end as error_pattern, count(*) as rows
 from {RESPONSES} where not coalesce(passed, false) group by 1""")
def error_patterns(spark, d):
    code = T.or_else(F.col("extracted_code"), F.col("generated_code"))
    pattern = T.error_pattern(F.col("failure_type"), F.col("error"), code, F.col("generated_code"))
    rows = derived(spark, d, "responses", "response_id", F.when(~F.coalesce("passed", F.lit(False)), pattern).alias("error_pattern")).where("error_pattern is not null")
    return rows.groupBy("error_pattern").agg(F.count("*").alias("rows"))


@query(f"select response_id, id, sample_id, dataset, coalesce(nullif(split, ''), nullif(regexp_extract(id, '^[a-z]+/([a-z]+)/', 1), ''), 'unknown') as split, coalesce(failure_type, 'unknown') as failure_type from {RESPONSES} where not coalesce(passed, false)")
def failure_rows(spark, d):
    cols = ("id", "sample_id", "dataset", "split", "passed", "failure_type", "error", "extracted_code", "generated_code")
    return P.failures(responses(spark, d, *cols)).select("response_id", "id", "sample_id", "dataset", "split", "failure_type")


@query(f"""select id, json_extract_string(t, '$.fn_name') as fn_name, json_array_length(t, '$.inputs') as cases from (select id, case when starts_with(trim(input_output), '"') then input_output::json ->> '$' else input_output end as t from {PROBLEMS} where input_output is not null) where starts_with(trim(t), '{{')""")
def input_output_fields(spark, d):
    t = N.unwrapped(F.col("input_output"))
    rows = problems(spark, d, "input_output").where("input_output is not null").select("id", t.alias("t")).where("t is not null")
    return rows.select("id", F.get_json_object("t", "$.fn_name").alias("fn_name"), F.json_array_length(F.get_json_object("t", "$.inputs")).cast("long").alias("cases"))


@query("select event_id, (props::json ->> '$.k')::bigint as k, list_transform(range(0, 5), lambda i: (props::json ->> '$.k')::bigint % 5 = i) as flags from events")
def json_flags(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select("event_id", k.alias("k"), N.flags(F.array((k % 5).cast("int")), F.lit(5)).alias("flags"))


@query(f"select id, regexp_extract(id, '/(\\d+)(?:__.*)?$', 1)::bigint as number, 'd' || lpad((regexp_extract(id, '/(\\d+)(?:__.*)?$', 1)::bigint % 10)::varchar, 2, '0') as decile from {PROBLEMS}")
def problem_deciles(spark, d):
    n = T.problem_number(F.col("id"))
    return problems(spark, d).select("id", n.alias("number"), F.concat(F.lit("d"), F.lpad((n % 10).cast("string"), 2, "0")).alias("decile"))


@query(f"select id, canonical_solution is not null as has_solution, row_number() over (order by id) > 0 as public from {PROBLEMS}")
def public_rows(spark, d):
    rows = problems(spark, d, "canonical_solution", "prompt")
    flags = rows.select("id", F.col("canonical_solution").isNotNull().alias("has_solution"))
    return flags.join(P.public(rows).select("id", F.lit(True).alias("public")), "id")


@query(f"""select id, 'Solve the task in Python.' || chr(10) || chr(10) || 'Task:' || chr(10) || 'T' || case when len(interface_names) > 0 then chr(10) || chr(10) || 'Interface:' || chr(10) || array_to_string(list_transform(interface_names, lambda s: '- ' || s), chr(10)) else '' end
 || case when length(trim(starter_code)) > 0 then chr(10) || chr(10) || 'Starter code:' || chr(10) || starter_code else '' end || case when io_mode = 'stdin_stdout' then chr(10) || chr(10) || 'Read standard input, write standard output.' else '' end as prompt from {PROBLEMS}""")
def prompt_template(spark, d):
    rows = problems(spark, d, "interface_names", "starter_code", "io_mode")
    return rows.select("id", P.prompt(F.lit("T"), F.col("interface_names"), F.col("starter_code"), F.col("io_mode") == "stdin_stdout").alias("prompt"))


@query(f"select id || '__canonical0' as response_id, canonical_solution as generated_code from {PROBLEMS} where canonical_solution is not null")
def canonical_responses(spark, d):
    rows = problems(spark, d, "canonical_solution").where("canonical_solution is not null")
    return P.exploded_solutions(rows, F.array("canonical_solution"), "id", 1).select("response_id", "generated_code")


@query(f"""with f as (select id, list_transform(list_filter(string_split(regexp_replace(regexp_split_to_array(completion, '(?im)^\\s*REVISED_CODE\\s*:')[1], '(?im)^\\s*ERROR_FINDINGS\\s*:', '', 'g'), chr(10)), lambda x: trim(x) <> ''), lambda x: trim(regexp_replace(x, '^\\s*(?:[-*•]|\\d+[.)])\\s*', ''), chr(10) || chr(13) || chr(9) || ' ')) as l from {SFT} where task_type = 'critic_repair')
 select id, list_filter(l, lambda x, i: list_position(l, x) = i)[1:3] as findings from f""")
def findings_of_critics(spark, d):
    rows = once(spark, d, "sft_records", "id", "task_type", "completion").where("task_type = 'critic_repair'")
    return rows.select("id", P.findings(F.col("completion"), 3).alias("findings"))


@query()
def code_audit(spark, d):
    """Each program's audit: whether it parses, what it defines and what it runs by itself."""
    rows = Y.analysed(responses(spark, d, "extracted_code", "interface_names").where("extracted_code is not null"), "extracted_code")
    names = F.coalesce("interface_names", F.array().cast("array<string>"))
    has = (F.size(names) == 0) | F.arrays_overlap(names, F.concat("audit.functions", "audit.solution_methods"))
    return rows.select("response_id", "audit.parseable", "audit.demos", F.col("audit.functions").alias("functions"), (F.col("audit.parseable") & has).alias("interface_present"))


@query()
def static_features(spark, d):
    rows = Y.static_features(responses(spark, d, "extracted_code").where("extracted_code is not null"), "extracted_code")
    return rows.select("response_id", "features")


@query()
def revised_code(spark, d):
    rows = Y.extracted(once(spark, d, "sft_records", "id", "task_type", "completion").where("task_type = 'critic_repair'"), "completion")
    return rows.select("id", "revised.status", "revised.notes", F.length("revised.code").alias("chars"))


@query()
def protected_router(spark, d):
    """Repairs against the answers they repair, by what can be seen of the source; ties keep the original."""
    r = Y.analysed(responses(spark, d, "original_response_id", "extracted_code", "interface_names"), "extracted_code")
    names = F.coalesce("interface_names", F.array().cast("array<string>"))
    has = (F.size(names) == 0) | F.arrays_overlap(names, F.concat("audit.functions", "audit.solution_methods"))
    scored = r.select("response_id", "original_response_id", B.protected_score(F.col("audit.parseable"), has, F.col("audit.demos")).alias("score"))
    base = scored.select(F.col("response_id").alias("original_response_id"), F.col("score").alias("base_score"))
    return scored.where("original_response_id is not null").join(base, "original_response_id").select("original_response_id", "response_id", "base_score", "score", B.routed(F.col("base_score"), F.col("score")).alias("served"))


@query()
def json_recovery(spark, d):
    rows = once(spark, d, "failures", "response_id", "llm_summary").where(F.col("llm_summary").contains("{"))
    return rows.select("response_id", N.object_text("llm_summary").alias("object"))


@query()
def canonical_executions(spark, d):
    """Canonical solutions of tasks with cases, run against them."""
    t = N.unwrapped(F.col("input_output"))
    rows = problems(spark, d, "input_output", "canonical_solution").where("canonical_solution is not null").select("id", "canonical_solution", t.alias("t")).where("t is not null")
    case = F.from_json("t", "inputs array<array<string>>, outputs array<string>, fn_name string")
    tests = F.udf(lambda x, y: N.canonical([{"args": [N.load(v) for v in a], "expected": N.load(b)} for a, b in zip(x or [], y or [])]), "string")
    ready = rows.withColumn("c", case).select("id", "canonical_solution", F.col("c.fn_name").alias("fn"), tests("c.inputs", "c.outputs").alias("tests"))
    run = E.verified(ready, "canonical_solution", "fn", "tests", timeout=2.0)
    return run.select("id", "run.passed", "run.failure_type", "run.test_count", "run.pass_count")


@query()
def failure_clusters(spark, d):
    rows = once(spark, d, "failures", "response_id", "llm_summary", "failure_type", "error")
    return L.clustered(rows.withColumn("text", L.failure_text(F.col("llm_summary"), F.col("failure_type"), F.col("error"))), "text", "response_id")


@query()
def static_critic(spark, d):
    """Pass probabilities of test responses from a classifier of training responses."""
    rows = responses(spark, d, "split", "passed", "extracted_code").where("extracted_code is not null and passed is not null").withColumn("label", F.col("passed").cast("double"))
    rows = L.with_critic_inputs(Y.static_features(rows, "extracted_code"), "extracted_code", "features").drop("features")
    model = L.critic(rows.where("split = 'train'"), "extracted_code", "label", static=True)
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows.where("split <> 'train'")).select("response_id", "passed", F.bround(vector_to_array("probability")[1], 6).alias("pass_probability"))


@query(f"select response_id, 1 / (1 + exp(-(overall_score - 3))) as probability, case when round_even(overall_score, 0) between 1 and 5 then round_even(overall_score, 0)::int end as score from (select response_id, overall_score from judgments where response_id is not null qualify row_number() over (partition by response_id order by judged_at desc, overall_score desc nulls last) = 1) where overall_score is not null and not isnan(overall_score)")
def score_to_probability(spark, d):
    j = judgments(spark, d, "overall_score").where("overall_score is not null and not isnan(overall_score)")
    return j.select("response_id", X.sigmoid(F.col("overall_score") - 3).alias("probability"), X.score_to_int(F.col("overall_score")).alias("score"))


@query(f"select r.response_id, a.name as arm, length(a.rubric) as rubric_chars from {RESPONSES} r, (values ('none', ''), ('short', 'Check the result.'), ('full', 'Check interface, edge cases and result.')) as a(name, rubric) where r.split = 'test'")
def rubric_arms(spark, d):
    arms = {"none": "", "short": "Check the result.", "full": "Check interface, edge cases and result."}
    rows = B.arms(responses(spark, d, "split").where("split = 'test'"), arms)
    return rows.select("response_id", F.col("arm.name").alias("arm"), F.length("arm.rubric").alias("rubric_chars"))


@query(f"""select response_id, dimension_scores['output_shape'].score as before, case when dimension_scores['output_shape'].applicable and dimension_scores['output_shape'].score > 2 and len(critical_errors) > 0 then 2 else dimension_scores['output_shape'].score end as after
 from (select * from judgments where response_id is not null qualify row_number() over (partition by response_id order by judged_at desc, overall_score desc nulls last) = 1)""")
def clamped_dimension(spark, d):
    j = judgments(spark, d, "dimension_scores", "critical_errors")
    after = B.clamp_dimension(F.col("dimension_scores"), "output_shape", 2, "critical error", F.size("critical_errors") > 0)
    get = lambda m: F.try_element_at(m, F.lit("output_shape"))["score"]
    return j.select("response_id", get(F.col("dimension_scores")).alias("before"), get(after).alias("after"))


@query(f"""with t as (select id, case when regexp_matches(coalesce(prompt, ''), '\\S') then len(regexp_extract_all(prompt, '\\S+')) else 0 end as p, case when regexp_matches(coalesce(completion, ''), '\\S') then len(regexp_extract_all(completion, '\\S+')) else 0 end as c from {SFT})
 select id, p as prompt_tokens, c as completion_tokens, case when c < 3 then 'completion_too_short' when p >= 160 then 'prompt_too_long' when p + c > 160 then 'total_too_long' end as reason from t""")
def token_length_gates(spark, d):
    rows = K.with_lengths(once(spark, d, "sft_records", "id", "prompt", "completion"), ["prompt", "completion"])
    p, c = F.col("prompt_tokens"), F.col("completion_tokens")
    return rows.select("id", p.cast("long").alias("prompt_tokens"), c.cast("long").alias("completion_tokens"), K.length_reason(p, c, 160, 3).alias("reason"))


@query()
def vocabulary_lengths(spark, d):
    """Completion lengths with a public vocabulary; its folder is the environment's TOKENIZER_DIR or the usual place."""
    path = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers") + "/byte_bpe_50k.json"
    rows = K.with_lengths(once(spark, d, "sft_records", "id", "completion"), ["completion"], path)
    return rows.select("id", "completion_tokens")


@query(f"select response_id, coalesce(failure_type, 'unknown') || coalesce(': ' || nullif(regexp_extract(coalesce(error, ''), '^(\\w*(?:Error|Exception|Exit|Interrupt))', 1), ''), '') as summary from {RESPONSES} where not coalesce(passed, false)")
def verifier_summaries(spark, d):
    rows = responses(spark, d, "passed", "failure_type", "error").where(~F.coalesce("passed", F.lit(False)))
    return rows.select("response_id", P.verifier_summary(F.col("failure_type"), F.col("error")).alias("summary"))


@query()
def judgment_repair(spark, d):
    """Judgments written out as a judge would and read back: what is missing or out of range is mended."""
    dims = ["edge_case_handling", "output_shape", "string_pattern", "interface_contract", "runtime_api_use", "numeric_formula"]
    rows = judgments(spark, d, "overall_score", "dimension_scores", "critical_errors", "confidence")
    raw = F.concat(F.lit("My verdict:\n```json\n"), F.to_json(F.struct("dimension_scores", "critical_errors", F.when(~F.isnan("overall_score"), F.col("overall_score")).alias("overall_score"), "confidence")), F.lit("\n```"))
    return JU.judged(rows.select("response_id", raw.alias("raw")), "raw", "response_id", dims).select("response_id", F.bround("overall_score", 4).alias("overall_score"), "predicted_pass", "confidence", "repairs")


@query()
def bootstrap_auc(spark, d):
    from lodestack.plans.q_metrics import _judged

    return paired.bootstrap_auc_difference(_judged(spark, d, "semantic_bottleneck_score"), F.col("passed"), F.col("overall_score"), F.col("semantic_bottleneck_score"), 0.0, 5.0)


_CLIP = lambda c, n: f"substr(trim({c}, chr(10) || chr(13) || chr(9) || ' '), 1, {n}) || case when length(trim({c}, chr(10) || chr(13) || chr(9) || ' ')) > {n} then chr(10) || '[TRUNCATED]' else '' end"


@query(f"""select r.response_id, md5('Judge whether the program solves the task.' || chr(10) || 'State PASS or FAIL first, then the reason.' || chr(10) || chr(10) || 'Task:' || chr(10) || {_CLIP("p.prompt", 300)} || chr(10) || chr(10) || 'Program:' || chr(10)
 || {_CLIP("coalesce(r.extracted_code, '')", 400)} || chr(10)) as prompt_md5, 'Verdict: ' || case when coalesce(r.passed, false) then 'PASS' else 'FAIL' end || chr(10) || 'Reason: ' || coalesce(trim(regexp_replace(r.error, '\\s+', ' ', 'g')), 'no reason recorded') as completion
 from {RESPONSES} r join {PROBLEMS} p on r.id = p.id where r.split = 'test'""")
def judge_pairs(spark, d):
    r = responses(spark, d, "id", "split", "passed", "error", "extracted_code").where("split = 'test'").join(problems(spark, d, "prompt"), "id")
    return r.select("response_id", F.md5(P.judge_prompt(F.col("prompt"), F.col("extracted_code"), 300, 400)).alias("prompt_md5"), P.judge_completion(F.col("passed"), F.col("error")).alias("completion"))


#: The reference's limits of the task and of the program, in characters.
TASK_CHARS, CODE_CHARS = 4500, 4500


@query(SQL["judge_pairs"].replace(_CLIP("p.prompt", 300), _CLIP("p.prompt", TASK_CHARS)).replace(_CLIP("coalesce(r.extracted_code, '')", 400), _CLIP("coalesce(r.extracted_code, '')", CODE_CHARS)))
def judge_pairs_full(spark, d):
    """``judge_pairs`` with the reference's limits."""
    r = responses(spark, d, "id", "split", "passed", "error", "extracted_code").where("split = 'test'").join(problems(spark, d, "prompt"), "id")
    return r.select("response_id", F.md5(P.judge_prompt(F.col("prompt"), F.col("extracted_code"), TASK_CHARS, CODE_CHARS)).alias("prompt_md5"), P.judge_completion(F.col("passed"), F.col("error")).alias("completion"))


@query(f"""with j as (select response_id, list_sort(list_transform(list_filter(map_entries(dimension_scores), lambda e: coalesce(e.value.applicable, false) and coalesce(e.value.score < 3, false)), lambda e: e.key)) as low from {JUDGMENTS} where predicted_pass)
 select r.response_id, array_to_string(low, ',') as low from {RESPONSES} r join j on r.response_id = j.response_id where not coalesce(r.passed, false) and len(low) > 0""")
def false_positive_cases(spark, d):
    j = judgments(spark, d, "predicted_pass", "dimension_scores").where("predicted_pass").select("response_id", D.low_dimensions(F.col("dimension_scores"), 3).alias("low"))
    failed = responses(spark, d, "passed").where(~F.coalesce("passed", F.lit(False))).select("response_id")
    return failed.join(j, "response_id").where(F.size("low") > 0).select("response_id", F.array_join("low", ",").alias("low"))


_NAMES = {"off_by_one": "Boundary slip", "empty_input": "Boundary slip", "wrong_formula": "Arithmetic", "missing_return": "Structure"}


@query(f"""with n as (select f.response_id, coalesce(trim(regexp_replace(lower(c.category), '[^a-z0-9]+', '_', 'g'), '_'), 'other') as category from {FAILURES} f left join (values {', '.join(f'({k!r}, {v!r})' for k, v in _NAMES.items())}) as c(pattern, category) on f.error_pattern = c.pattern),
 k as (select category from n where category <> 'other' group by 1 order by count(*) desc, category limit 2) select coalesce(k.category, 'other') as category, count(*) as rows from n left join k on n.category = k.category group by 1""")
def consolidated_categories(spark, d):
    names = spark.createDataFrame(list(_NAMES.items()), "cluster string, category string")
    rows = D.consolidated(once(spark, d, "failures", "response_id", "error_pattern"), "error_pattern", names, "other", 3)
    return rows.groupBy("category").agg(F.count("*").alias("rows"))


@query(f"""with c as (select coalesce(error_pattern, 'unknown') as dimension, count(*) as failures from {FAILURES} group by 1), t as (select sum(failures) as t from c)
 select dimension, round_even(failures / t::double, 4) as weight, failures, round_even(failures / t::double, 4) >= 0.25 as critical from c, t""")
def rubric_document(spark, d):
    """The rubric that the failures' patterns give, a row a dimension."""
    rows = once(spark, d, "failures", "response_id", "id", "error_pattern").groupBy(F.coalesce("error_pattern", F.lit("unknown")).alias("category")).agg(F.count("*").alias("rows"), F.count_distinct("id").alias("tasks"))
    doc = D.rubric(rows)
    critical = set(doc["aggregation"]["critical"])
    return spark.createDataFrame([(x["id"], x["weight"], x["evidence"]["failures"], x["id"] in critical) for x in doc["dimensions"]], "dimension string, weight double, failures long, critical boolean")
