"""Queries that look up, combine, compare and audit tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.operators import audit as A, joins as J
from lodestack.plans.q_metrics import _JUDGED, _judged
from lodestack.plans.tables import FAILURES, JUDGMENTS, PROBLEMS, RESPONSES, SFT, judgments, once, problems, responses, table
from lodestack.streaming import passrates

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query(f"select r.response_id, r.original_response_id, o.response_id is not null as found, o.passed as original_passed, case when o.response_id is null then 'missing_original' when o.id is distinct from r.id then 'other_task' else 'ok' end as status from {RESPONSES} r left join {RESPONSES} o on r.original_response_id = o.response_id where r.original_response_id is not null")
def lookup_original(spark, d):
    r = responses(spark, d, "original_response_id", "id", "passed")
    both = J.lookup(r.where("original_response_id is not null"), r.select("response_id", "id", "passed"), "original_response_id", "o_", "response_id")
    status = F.when(~F.col("o_found"), "missing_original").when(~F.col("o_id").eqNullSafe(F.col("id")), "other_task").otherwise("ok")
    return both.select("response_id", "original_response_id", F.col("o_found").alias("found"), F.col("o_passed").alias("original_passed"), status.alias("status"))


@query(f"select r.response_id, p.id is not null as found, p.io_mode, length(p.canonical_solution) as solution_chars from {RESPONSES} r left join {PROBLEMS} p on r.id = p.id where not coalesce(r.passed, false)")
def lookup_problem(spark, d):
    r = responses(spark, d, "id", "passed").where(~F.coalesce("passed", F.lit(False)))
    both = J.lookup(r, problems(spark, d, "io_mode", "canonical_solution"), "id", "p_")
    return both.select("response_id", F.col("p_found").alias("found"), F.col("p_io_mode").alias("io_mode"), F.length("p_canonical_solution").alias("solution_chars"))


@query(f"select r.response_id, j.predicted_pass, p.dataset from {RESPONSES} r join {JUDGMENTS} j on r.response_id = j.response_id left join {PROBLEMS} p on r.id = p.id where r.passed")
def three_way_join(spark, d):
    r = responses(spark, d, "id", "passed").where("passed").join(judgments(spark, d, "predicted_pass"), "response_id")
    return J.lookup(r, problems(spark, d, "dataset"), "id", "p_").select("response_id", "predicted_pass", F.col("p_dataset").alias("dataset"))


@query(f"select coalesce(p.difficulty, 'unknown') as difficulty, coalesce(p.dataset, 'unknown') as dataset, count(*) as rows from {FAILURES} f left join {PROBLEMS} p on f.id = p.id group by all")
def metadata_enrichment(spark, d):
    both = J.lookup(once(spark, d, "failures", "response_id", "id"), problems(spark, d, "difficulty", "dataset"), "id", "p_")
    return both.groupBy(*(F.coalesce(f"p_{c}", F.lit("unknown")).alias(c) for c in ("difficulty", "dataset"))).agg(F.count("*").alias("rows"))


_MAP = {"off_by_one": "boundary", "empty_input": "boundary", "wrong_formula": "arithmetic", "missing_return": "structure", "type_misuse": "types"}


@query(f"select c.category, count(*) as rows, count(distinct id) as tasks from {FAILURES} f join (values {', '.join(f'({k!r}, {v!r})' for k, v in _MAP.items())}) as c(pattern, category) on f.error_pattern = c.pattern group by 1")
def cluster_category_mapping(spark, d):
    names = spark.createDataFrame(list(_MAP.items()), "error_pattern string, category string")
    rows = once(spark, d, "failures", "response_id", "id", "error_pattern").join(F.broadcast(names), "error_pattern")  # five rows
    return rows.groupBy("category").agg(F.count("*").alias("rows"), F.count_distinct("id").alias("tasks"))


@query(f"select response_id, id from {RESPONSES} where not coalesce(passed, false) and id not in (select id from problems where eval_split is not null and id is not null) and response_id not in (select original_response_id from responses where original_response_id is not null)")
def forbidden_anti_join(spark, d):
    failed = responses(spark, d, "id", "passed").where(~F.coalesce("passed", F.lit(False)) & F.col("id").isNotNull()).select("response_id", "id")
    frozen = table(spark, d, "problems").where("eval_split is not null").select("id")
    repaired = table(spark, d, "responses").select(F.col("original_response_id").alias("response_id")).where("response_id is not null")
    return J.without(J.without(failed, frozen, "id"), repaired, "response_id").select("response_id", "id")


@query(f"select id, dataset from {PROBLEMS} where id in (select id from {RESPONSES} where passed)")
def semi_join_passing(spark, d):
    passing = responses(spark, d, "id", "passed").where("passed")
    return J.restricted(problems(spark, d, "dataset"), passing, "id")


@query(f"select p.id, count(*) as total, count(*) filter (passed) as passed from {PROBLEMS} p join {RESPONSES} r on p.id = r.id group by 1 having count(*) filter (passed) > 0")
def prompts_with_labels(spark, d):
    t = responses(spark, d, "id", "passed").groupBy("id").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed")).where("passed > 0")
    return problems(spark, d).join(t, "id")


@query(f"select s.response_id, s.original_response_id, case when not isnan(j.overall_score) then j.overall_score end as chosen_score, case when not isnan(k.overall_score) then k.overall_score end as rejected_score from {RESPONSES} s left join {JUDGMENTS} j on s.response_id = j.response_id left join {JUDGMENTS} k on s.original_response_id = k.response_id where s.original_response_id is not null")
def pair_score_join(spark, d):
    s = judgments(spark, d, "overall_score").select("response_id", F.nanvl("overall_score", F.lit(None).cast("double")).alias("overall_score"))  # NaN is no score
    pairs = responses(spark, d, "original_response_id").where("original_response_id is not null")
    both = J.lookup(J.lookup(pairs, s, "response_id", "c_"), s, "original_response_id", "r_", "response_id")
    return both.select("response_id", "original_response_id", F.col("c_overall_score").alias("chosen_score"), F.col("r_overall_score").alias("rejected_score"))


@query(f"""with s as (select response_id, min(error_pattern) as l from {FAILURES} where error_pattern is not null and error_pattern <> 'unknown' group by 1), w as (select response_id, failure_type as l from {RESPONSES} where failure_type is not null)
 select r.response_id, coalesce(s.l, w.l) as label, case when s.l is not null then 'strong' when w.l is not null then 'weak' end as label_source from {RESPONSES} r left join s using (response_id) left join w using (response_id) where not coalesce(r.passed, false)""")
def label_override(spark, d):
    failed = responses(spark, d, "passed").where(~F.coalesce("passed", F.lit(False))).select("response_id")
    strong = once(spark, d, "failures", "response_id", "error_pattern").where("error_pattern <> 'unknown'").select("response_id", F.col("error_pattern").alias("label"))
    weak = responses(spark, d, "failure_type").select("response_id", F.col("failure_type").alias("label"))
    return J.overridden(failed, strong, weak, "response_id", "label")


@query(f"""with r as (select id, response_id, generated_at from {RESPONSES} where id is not null) select id, arg_min(response_id, row(generated_at, response_id)) as first_response, arg_max(response_id, row(generated_at, response_id)) as last_response from r group by 1""")
def first_last_wins(spark, d):
    r = responses(spark, d, "id", "generated_at").select("id", "response_id", "generated_at")
    order = [F.col("generated_at"), F.col("response_id")]
    first, last = J.index(r, "id", order), J.index(r, "id", order, "last")
    return first.select("id", F.col("response_id").alias("first_response")).join(last.select("id", F.col("response_id").alias("last_response")), "id")


@query(f"""with r as (select response_id, coalesce(id, chr(0)) as t, coalesce(nullif(extracted_code, ''), generated_code, '') as code from {RESPONSES}), c as (select t, code, count(*) as copies from r group by all)
 select response_id, copies, length(code) as chars from r join c using (t, code)""")
def shared_result_fanback(spark, d):
    r = responses(spark, d, "id", "extracted_code", "generated_code").select("response_id", F.coalesce("id", F.lit("\0")).alias("t"), F.coalesce(T.or_else(F.col("extracted_code"), F.col("generated_code")), F.lit("")).alias("code"))
    copies = r.groupBy("t", "code").agg(F.count("*").alias("copies"))
    out = J.shared_results(r.join(copies, ["t", "code"]), ["t", "code", "copies"], lambda once_: once_.withColumn("chars", F.length("code")))
    return out.select("response_id", "copies", "chars")


@query(f"select src, count(*) as rows, count(original_response_id) as with_original, count(summary) as with_summary from (select 'responses' as src, response_id, original_response_id, null as summary from {RESPONSES} union all by name select 'failures' as src, response_id, null as original_response_id, llm_summary as summary from {FAILURES}) group by 1")
def bag_union(spark, d):
    both = J.union(responses(spark, d, "original_response_id").withColumn("src", F.lit("responses")), once(spark, d, "failures", "response_id", "llm_summary").withColumnRenamed("llm_summary", "summary").withColumn("src", F.lit("failures")))
    return both.groupBy("src").agg(F.count("*").alias("rows"), F.count("original_response_id").alias("with_original"), F.count("summary").alias("with_summary"))


@query("select id from problems where eval_split is not null and id is not null intersect select id from responses where split = 'train'")
def leaked_ids_intersect(spark, d):
    return table(spark, d, "problems").where("eval_split is not null and id is not null").select("id").intersect(table(spark, d, "responses").where("split = 'train'").select("id"))


@query("select id from responses where id is not null except select id from problems")
def unknown_ids_difference(spark, d):
    return table(spark, d, "responses").select("id").where("id is not null").subtract(table(spark, d, "problems").select("id"))


@query("""with j as (select response_id, unnest(critical_errors) as e from judgments where response_id is not null) select response_id, count(distinct e) as errors, string_agg(distinct e, '|' order by e) as merged from j where e is not null group by 1""")
def merged_lists(spark, d):
    e = table(spark, d, "judgments").where("response_id is not null").select("response_id", F.explode("critical_errors").alias("e")).where("e is not null").distinct()
    return e.groupBy("response_id").agg(F.count("*").alias("errors"), F.array_join(F.array_sort(F.collect_list("e")), "|").alias("merged"))  # one response's errors


@query(f"""select 'unique response_id' as "check", count(*) - count(distinct response_id) as violations, count(*) = count(distinct response_id) as ok from responses union all
 select 'filled id', count(*) filter (id is null or trim(id) = ''), count(*) filter (id is null or trim(id) = '') = 0 from responses union all
 select 'disjoint id', count(*), count(*) = 0 from (select id from problems where eval_split is not null and id is not null intersect select id from responses where split = 'train') union all
 select 'contained id', count(*), count(*) = 0 from (select id from responses where id is not null except select id from problems) union all
 select 'row counts split', sum(abs(n - case split when 'train' then 100 when 'test' then 100 else 0 end)), sum(abs(n - case split when 'train' then 100 when 'test' then 100 else 0 end)) = 0 from (select split, count(*) as n from {PROBLEMS} group by 1) union all
 select 'constant', (count(distinct coalesce(model, '')) > 1)::int + (count(distinct coalesce(max_tokens, -1)) > 1)::int, (count(distinct coalesce(model, '')) > 1)::int + (count(distinct coalesce(max_tokens, -1)) > 1)::int = 0 from responses union all
 select 'fences generated_code', count(*) filter ((length(coalesce(generated_code, '')) - length(replace(coalesce(generated_code, ''), '```', ''))) / 3 <> 2), count(*) filter ((length(coalesce(generated_code, '')) - length(replace(coalesce(generated_code, ''), '```', ''))) / 3 <> 2) = 0 from responses union all
 select 'private columns', 0, true""")
def audit_report(spark, d):
    r, p = table(spark, d, "responses"), table(spark, d, "problems")
    frozen = p.where("eval_split is not null and id is not null")
    once_ = problems(spark, d, "split")
    return A.report([
        A.unique(r, "response_id"), A.filled(r, "id"), A.disjoint(frozen, r.where("split = 'train'"), "id"), A.contained(r.where("id is not null"), p, "id"), A.row_counts(once_, "split", {"train": 100, "test": 100}),
        A.constant(r, ["model", "max_tokens"]), A.fences(r, "generated_code", 2), A.column_free(r, {"canonical_solution", "test_list"}),
    ])


@query(f"select date_trunc('day', generated_at) as start, model, count(*) as responses, count(*) filter (passed) as passed from {RESPONSES} group by all")
def stream_pass_rates(spark, d):
    return passrates.replayed(spark, f"{d}/responses.parquet")


@query(f"select task_type, coalesce(lower(trim(eval_split)), 'none') as split, count(*) as rows from {SFT} where source in ('dpo_canary', 'two_stage_repair') and task_type <> 'single_judge' group by all")
def metadata_filter(spark, d):
    rows = once(spark, d, "sft_records", "id", "task_type", "eval_split", "source").where(F.col("source").isin("dpo_canary", "two_stage_repair") & (F.col("task_type") != "single_judge"))
    return rows.groupBy("task_type", F.coalesce(F.lower(F.trim("eval_split")), F.lit("none")).alias("split")).agg(F.count("*").alias("rows"))


@query(f"select confidence, count(*) as rows, avg(case when isnan(overall_score) then null else overall_score end) as mean_score, count(*) filter (gold) as passed from {_JUDGED} group by 1")
def score_by_confidence(spark, d):
    s = F.when(~F.isnan("overall_score"), F.col("overall_score"))
    return _judged(spark, d, "confidence").groupBy("confidence").agg(F.count("*").alias("rows"), F.avg(s).alias("mean_score"), F.count_if("passed").alias("passed"))
