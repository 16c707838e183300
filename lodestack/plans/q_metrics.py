"""Queries over outcomes and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions import stats as X
from lodestack.operators import metrics as M, ordered, paired as P, rubric as B
from lodestack.plans.tables import FAILURES, JUDGMENTS, RESPONSES, judgments, once, responses, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_RATE = lambda a, b: f"case when {b} = 0 then 0.0 else ({a})::double / ({b}) end"
_TASKS = f"""count(*) as tasks, sum(n) as responses, sum(p) as passed_responses, sum(n) - sum(p) as failed_responses, round_even({_RATE('sum(p)', 'sum(n)')}, 6) as response_pass_rate,
 round_even({_RATE('count(*) filter (p > 0)', 'count(*)')}, 6) as task_pass_at_k, count(*) filter (p > 0) as tasks_with_any_pass, count(*) filter (p = n) as tasks_with_all_pass,
 count(*) filter (p > 0) - count(*) filter (p = n) as tasks_with_partial_pass, count(*) filter (p = 0) as tasks_with_all_fail"""


@query(f"with t as (select split, id, count(*) as n, count(*) filter (passed) as p from {RESPONSES} group by all) select split, {_TASKS} from t group by split")
def task_pass_at_k(spark, d):
    return M.task_metrics(responses(spark, d, "id", "split", "passed"), "id", F.col("passed"), ["split"])


@query(f"with t as (select difficulty, id, count(*) as n, count(*) filter (passed) as p from {RESPONSES} group by all) select difficulty, {_TASKS} from t group by difficulty")
def task_success_by_difficulty(spark, d):
    return M.task_metrics(responses(spark, d, "id", "difficulty", "passed"), "id", F.col("passed"), ["difficulty"])


@query(f"""select dataset, split, case when grouping(dataset) = 1 then 3 when grouping(split) = 1 then 1 else 0 end as level, count(*) as total, count(*) filter (passed) as passed, count(*) - count(*) filter (passed) as failed,
 round_even(count(*) filter (passed) / count(*), 6) as pass_rate from {RESPONSES} group by grouping sets ((dataset, split), (dataset), ())""")
def pass_rate_grouping_sets(spark, d):
    return M.pass_rates(responses(spark, d, "dataset", "split", "passed"), F.col("passed"), [["dataset", "split"], ["dataset"], []])


@query(f"select sample_id, count(*) as total, count(*) filter (passed) as passed, count(*) filter (not coalesce(passed, false) and failure_type = 'timeout') as timeouts, round_even(count(*) filter (passed) / count(*), 6) as pass_rate from {RESPONSES} group by 1")
def pass_rate_by_sample(spark, d):
    ok = F.coalesce("passed", F.lit(False))
    rows = responses(spark, d, "sample_id", "passed", "failure_type").groupBy("sample_id")
    return rows.agg(F.count("*").alias("total"), F.count_if(ok).alias("passed"), F.count_if(~ok & (F.col("failure_type") == "timeout")).alias("timeouts"), X.rate(F.count_if(ok), F.count("*"), 6).alias("pass_rate"))


@query(f"select coalesce(failure_type, 'None') as failure_type, count(*) as rows from {RESPONSES} where not coalesce(passed, false) group by 1")
def failure_type_counts(spark, d):
    return M.value_counts(responses(spark, d, "failure_type", "passed").where(~F.coalesce("passed", F.lit(False))), F.col("failure_type"), "failure_type")


@query(f"select coalesce(dataset, 'None') || '/' || coalesce(split, 'None') || '/' || coalesce(difficulty, 'None') as key, count(*) as rows from {RESPONSES} group by 1")
def multi_key_counts(spark, d):
    key = F.concat_ws("/", *(F.coalesce(c, F.lit("None")) for c in ("dataset", "split", "difficulty")))
    return M.value_counts(responses(spark, d, "dataset", "split", "difficulty"), key, "key")


@query(f"with t as (select id, count(*) as samples from {RESPONSES} group by 1) select samples, count(*) as tasks from t group by 1")
def samples_per_task_hist(spark, d):
    return responses(spark, d, "id").groupBy("id").agg(F.count("*").alias("samples")).groupBy("samples").agg(F.count("*").alias("tasks"))


def _judged(spark, d, *columns):
    return responses(spark, d, "id", "split", "passed", "model").join(judgments(spark, d, *dict.fromkeys(("overall_score", *columns))), "response_id")


_JUDGED = f"(select r.response_id, r.id, r.split, r.model, coalesce(r.passed, false) as gold, j.overall_score, j.predicted_pass, j.semantic_bottleneck_score, j.confidence, j.critical_errors, j.dimension_scores from {RESPONSES} r join {JUDGMENTS} j on r.response_id = j.response_id)"
_SCORED = f"(select * from {_JUDGED} where overall_score is not null and not isnan(overall_score))"
_RATES = f"""{_RATE('tp + tn', 'tp + fp + tn + fn')} as accuracy, ({_RATE('tp', 'tp + fn')} + {_RATE('tn', 'tn + fp')}) / 2 as balanced_accuracy,
 case when n = 0 or ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n) = 1 then 0.0 else ((tp + tn) / n - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)) / (1 - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)) end as kappa,
 {_RATE('tp', 'tp + fp')} as precision_pass, {_RATE('tp', 'tp + fn')} as recall_pass, {_RATE('tn', 'tn + fn')} as precision_fail, {_RATE('tn', 'tn + fp')} as specificity,
 {_RATE('fp', 'fp + tn')} as overacceptance_rate, {_RATE('fn', 'fn + tp')} as false_rejection_rate"""


@query(f"""with c as (select split, count(*) as rows, count(*) filter (gold and predicted_pass) as tp, count(*) filter (not gold and predicted_pass) as fp, count(*) filter (not gold and not coalesce(predicted_pass, false)) as tn,
 count(*) filter (gold and not coalesce(predicted_pass, false)) as fn, count(*)::double as n from {_JUDGED} group by split) select split, rows, tp, fp, tn, fn, {_RATES} from c""")
def confusion_metrics(spark, d):
    return M.confusion(_judged(spark, d, "predicted_pass"), F.col("passed"), F.col("predicted_pass"), ["split"])


@query(f"""with c as (select split, model, count(*) as rows, count(*) filter (gold and predicted_pass) as tp, count(*) filter (not gold and predicted_pass) as fp, count(*) filter (not gold and not coalesce(predicted_pass, false)) as tn,
 count(*) filter (gold and not coalesce(predicted_pass, false)) as fn, count(*)::double as n from {_JUDGED} group by all) select model || ':' || split as source, rows, {_RATES} from c""")
def source_metrics(spark, d):
    rows = _judged(spark, d, "predicted_pass").withColumn("source", F.concat_ws(":", "model", "split"))
    return M.confusion(rows, F.col("passed"), F.col("predicted_pass"), ["source"]).drop("tp", "fp", "tn", "fn")


@query(f"""with s as (select gold, rank() over (order by overall_score) + (count(*) over (partition by overall_score) - 1) / 2.0 as r from {_SCORED})
 select count(*) filter (gold) as positives, count(*) filter (not gold) as negatives, (sum(r) filter (gold) - count(*) filter (gold) * (count(*) filter (gold) + 1) / 2.0) / (count(*) filter (gold) * count(*) filter (not gold)) as auc from s""")
def exact_auc(spark, d):
    return M.exact_auc(_judged(spark, d), F.col("passed"), F.col("overall_score"))


@query(f"""with s as (select gold::int as y, (overall_score - 1) / 4 as p from {_SCORED} where overall_score between 1 and 5)
 select count(*) as rows, avg((p - y) ** 2) as brier, -avg(y * ln(least(greatest(p, 1e-12), 1.0)) + (1 - y) * ln(least(greatest(1 - p, 1e-12), 1.0))) as log_loss from s""")
def probability_metrics(spark, d):
    rows = _judged(spark, d).where("overall_score between 1 and 5")
    return M.probability_metrics(rows, F.col("passed"), (F.col("overall_score") - 1) / 4)


_GRID = [round(1 + k / 10, 1) for k in range(41)]
_SWEEP = f"""with c as (select threshold, count(*) filter (gold and overall_score >= threshold) as tp, count(*) filter (not gold and overall_score >= threshold) as fp, count(*) filter (not gold and overall_score < threshold) as tn,
 count(*) filter (gold and overall_score < threshold) as fn, count(*)::double as n from {_SCORED}, (select unnest([{', '.join(map(str, _GRID))}])::double as threshold) group by 1), w as (select threshold, tp, fp, tn, fn, {_RATES} from c) """


@query(_SWEEP + "select * from w")
def threshold_sweep_grid(spark, d):
    return M.sweep_grid(_judged(spark, d), F.col("passed"), F.col("overall_score"), _GRID)


@query(_SWEEP + "select threshold, balanced_accuracy, accuracy from w order by balanced_accuracy desc, accuracy desc, threshold limit 1")
def threshold_sweep_best(spark, d):
    best = M.best_threshold(threshold_sweep_grid(spark, d), [F.col("balanced_accuracy"), F.col("accuracy")])
    return best.select("threshold", "balanced_accuracy", "accuracy")


@query(_SWEEP + "select threshold, balanced_accuracy from w where overacceptance_rate <= 0.6 order by balanced_accuracy desc, threshold limit 1")
def threshold_sweep_constrained(spark, d):
    return M.best_threshold(threshold_sweep_grid(spark, d), [F.col("balanced_accuracy")], F.col("overacceptance_rate") <= 0.6).select("threshold", "balanced_accuracy")


@query(f"""with s as (select gold, overall_score as score from {_SCORED}), g as (select score as threshold, count(*) filter (gold) as pos, count(*) filter (not gold) as neg from s group by 1),
 c as (select threshold, sum(pos) over (order by threshold desc) as tp, sum(neg) over (order by threshold desc) as fp, sum(neg) over () - sum(neg) over (order by threshold desc) as tn, sum(pos) over () - sum(pos) over (order by threshold desc) as fn, (sum(pos + neg) over ())::double as n from g)
 select threshold, tp, fp, tn, fn, {_RATES} from c""")
def threshold_sweep_scores(spark, d):
    return M.sweep_scores(_judged(spark, d), F.col("passed"), F.col("overall_score"))


def _nearest(values: str) -> str:
    pick = lambda f: f"list_sort(list(v))[least(count(*) - 1, round_even((count(*) - 1) * {f}, 0))::int + 1]"
    return f"select g, count(*) as n, min(v) as min, avg(v) as mean, {pick(0.5)} as p50, {pick(0.95)} as p95, {pick(0.99)} as p99, max(v) as max from ({values}) where v is not null group by g"


@query(_nearest(f"select model as g, generated_token_count::double as v from {RESPONSES}"))
def nearest_rank_stats(spark, d):
    rows = responses(spark, d, "model", "generated_token_count").select(F.col("model").alias("g"), F.col("generated_token_count").cast("double").alias("v"))
    return ordered.nearest_rank(rows, "v", ["g"], ordered.QUANTILES | {"p99": 0.99}).select("g", "n", "min", "mean", "p50", "p95", "p99", "max")


@query(f"select model, avg(generated_token_count) as mean, median(generated_token_count) as median from {RESPONSES} group by 1")
def mean_median(spark, d):
    return responses(spark, d, "model", "generated_token_count").groupBy("model").agg(F.avg("generated_token_count").alias("mean"), F.median("generated_token_count").alias("median"))


_DIMS = f"(select gold, unnest(map_entries(dimension_scores)) as e from {_JUDGED})"


@query(f"""with x as (select gold, e.key as dimension, coalesce(e.value.applicable, false) as applies, case when e.value.applicable then e.value.score end as s from {_DIMS})
 select dimension, count(*) as rows, avg(applies::int) as applicable_rate, avg(s) as mean_score, avg(s) filter (gold) as mean_passed, avg(s) filter (not gold) as mean_failed,
 {', '.join(f'count(*) filter (s = {k}) as score_{k}' for k in range(1, 6))} from x group by 1""")
def dimension_stats(spark, d):
    return B.by_dimension(_judged(spark, d, "dimension_scores").withColumn("passed", F.coalesce("passed", F.lit(False))), "dimension_scores", F.col("passed"))


_VALUES = "list_transform(list_filter(map_values(dimension_scores), lambda x: coalesce(x.applicable, false) and x.score is not null), lambda x: x.score::double)"


@query(f"""with t as (select gold, case when isnan(overall_score) then null else overall_score end as v, {_VALUES} as s from {_JUDGED}), u as (select gold, v, coalesce(len(s) > 1 and list_min(s) = list_max(s), false) as flat from t)
 select count(*) as rows, count(*) filter (flat) as flat_rows, count(*) filter (flat and gold) as flat_passed, count(*) filter (flat and not gold) as flat_failed, avg(v) filter (gold) as mean_passed, avg(v) filter (not gold) as mean_failed,
 avg(v) filter (gold) - avg(v) filter (not gold) as mean_gap from u""")
def score_collapse(spark, d):
    return B.collapse_report(_judged(spark, d, "dimension_scores"), "dimension_scores", F.col("passed"), "overall_score")


@query(f"""select case when overall_score is null or isnan(overall_score) then 'missing' when overall_score >= 4 then '>=4' when overall_score >= 3 then '3-4' when overall_score >= 2 then '2-3' when overall_score >= 1 then '1-2' else '<1' end as bucket, count(*) as rows from {_JUDGED} group by 1""")
def score_buckets(spark, d):
    return _judged(spark, d).groupBy(M.score_buckets(F.col("overall_score"), [1, 2, 3, 4]).alias("bucket")).agg(F.count("*").alias("rows"))


@query(f"with t as (select response_id, {_VALUES} as s from {_JUDGED}) select response_id, list_min(s) as least, list_avg(s) as mean, len(s) > 0 and list_min(s) >= 3 as all_high from t")
def applicable_dimensions(spark, d):
    s = F.col("dimension_scores")
    return _judged(spark, d, "dimension_scores").select("response_id", B.least_score(s).alias("least"), B.mean_score(s).alias("mean"), B.all_at_least(s, 3).alias("all_high"))


_W = {"edge_case_handling": 2.0, "output_shape": 1.0, "string_pattern": 1.0, "interface_contract": 3.0, "runtime_api_use": 1.0, "numeric_formula": 2.0}
_wd = lambda k: f"dimension_scores['{k}']"
_ok = lambda k: f"coalesce({_wd(k)}.applicable, false) and {_wd(k)}.score is not null"


@query(f"""with t as (select response_id, critical_errors, {' + '.join(f"case when {_ok(k)} then {_wd(k)}.score * {w} else 0 end" for k, w in _W.items())} as num, {' + '.join(f"case when {_ok(k)} then {w} else 0 end" for k, w in _W.items())} as den from {_JUDGED})
 select response_id, round_even(case when den > 0 then case when coalesce(len(critical_errors), 0) > 0 then least(num / den, 2.0) else num / den end end, 4) as score from t""")
def weighted_rubric_score(spark, d):
    score = B.weighted_mean(F.col("dimension_scores"), _W)
    capped = B.capped(score, [(F.size("critical_errors") > 0, 2.0)])
    return _judged(spark, d, "dimension_scores", "critical_errors").select("response_id", F.bround(F.when(score.isNotNull(), capped), 4).alias("score"))


@query(f"""with t as (select {_VALUES} as s, coalesce(len(critical_errors), 0) as c from {_JUDGED}), u as (select coalesce(list_avg(s) >= 3.5, false) as plain, coalesce(list_min(s) >= 3, true) as low, c from t)
 select plain, plain and low as calibrated, plain and low and c = 0 as strict, count(*) as rows from u group by all""")
def pass_decisions(spark, d):
    rules = B.decisions(F.col("dimension_scores"), 3.5, (), F.col("critical_errors"))
    return _judged(spark, d, "dimension_scores", "critical_errors").groupBy(*(c.alias(k) for k, c in rules.items())).agg(F.count("*").alias("rows"))


@query(f"""with f as {FAILURES}, p as (select failure_type, coalesce(error_pattern, 'unknown') as p, count(*) as n from f group by all), m as (select failure_type, map_from_entries(list_sort(list({{'k': p, 'v': n}}))) as m from p group by 1),
 c as (select failure_type, count(*) as rows, count(distinct id) as tasks from f group by 1) select failure_type, rows, tasks, round_even(rows / (select count(*) from f), 6) as share, array_to_string(list_transform(map_entries(m), lambda e: e.key || '=' || e.value), ',') as patterns from c join m using (failure_type)""")
def category_stats(spark, d):
    from lodestack.operators.taxonomy import category_stats as stats

    rows = once(spark, d, "failures", "response_id", "id", "failure_type", "error_pattern")
    shown = F.array_join(F.transform(F.map_entries("patterns"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return stats(rows, "failure_type", "id", "error_pattern").withColumn("patterns", shown)


@query(f"""with s as (select id, response_id, gold, case when overall_score is null or isnan(overall_score) then '-Infinity'::double else overall_score end as v from {_JUDGED}),
 p as (select id, arg_min(gold, row(-v, response_id)) as a, arg_min(gold, response_id) as b, bool_or(gold) as o, count(*) as n from s group by 1),
 t as (select count(*) as problems, sum(n) as candidates, count(*) filter (a) as selected_passed, count(*) filter (b) as first_passed, count(*) filter (o) as oracle_passed, count(*) filter (a and b) as both_pass, count(*) filter (a and not b) as selected_only,
 count(*) filter (b and not a) as first_only, count(*) filter (not a and not b) as neither from p),
 q as (select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) as c from (select selected_only + first_only as n, unnest(range(0, least(selected_only, first_only) + 1)) as i from t))
 select t.*, case when selected_only + first_only = 0 then null else round(least(1.0, 2 * c), 8) end as sign_test_p from t, q""")
def selection_report(spark, d):
    return M.selection_report(_judged(spark, d), "id", "response_id", F.col("overall_score"), F.col("passed")).withColumn("sign_test_p", F.round("sign_test_p", 8))


@query(f"""select model, count(*) as judged, count(*) filter (overall_score is null) as null_scores, count(*) filter (isnan(overall_score)) as nan_scores, count(*) filter (predicted_pass is null) as no_decision,
 count(*) filter (len(critical_errors) > 0) as with_critical, count(*) filter (overall_score is null) + count(*) filter (isnan(overall_score)) = 0 as valid from {_JUDGED} group by 1""")
def run_audit(spark, d):
    s = F.col("overall_score")
    rows = _judged(spark, d, "predicted_pass", "critical_errors").groupBy("model")
    bad = F.count_if(s.isNull()) + F.count_if(F.isnan(s))
    return rows.agg(F.count("*").alias("judged"), F.count_if(s.isNull()).alias("null_scores"), F.count_if(F.isnan(s)).alias("nan_scores"), F.count_if(F.col("predicted_pass").isNull()).alias("no_decision"), F.count_if(F.size("critical_errors") > 0).alias("with_critical"), (bad == 0).alias("valid"))


def _runs(spark, d):
    """Two runs over every order line, both read from the line: open lines, and lines not returned."""
    return table(spark, d, "lineitem").select((F.col("l_linestatus") == "O").alias("base_passed"), (F.col("l_returnflag") != "R").alias("candidate_passed"), F.col("l_linestatus").alias("g"))


_Z = X.Z
_WILSON = lambda p: (f"greatest(0.0, ({p}/rows + {_Z}**2/(2*rows))/(1+{_Z}**2/rows) - ({_Z}/(1+{_Z}**2/rows))*sqrt({p}/rows*(1-{p}/rows)/rows + {_Z}**2/(4*rows*rows)))", f"least(1.0, ({p}/rows + {_Z}**2/(2*rows))/(1+{_Z}**2/rows) + ({_Z}/(1+{_Z}**2/rows))*sqrt({p}/rows*(1-{p}/rows)/rows + {_Z}**2/(4*rows*rows)))")
_TRANS = f"""t as (select count(*) as rows, count(*) filter (a) as base_passed, count(*) filter (b) as candidate_passed, count(*) filter (not a and b) as gained, count(*) filter (a and not b) as lost, count(*) filter (a and b) as kept,
 count(*) filter (not a and not b) as failed_both from r), u as (select rows::double as rows, * exclude (rows) from t) select rows::bigint as rows, base_passed, candidate_passed, gained, lost, kept, failed_both, candidate_passed - base_passed as net_delta,
 round({_WILSON('base_passed')[0]}, 8) as base_low, round({_WILSON('base_passed')[1]}, 8) as base_high, round({_WILSON('candidate_passed')[0]}, 8) as candidate_low, round({_WILSON('candidate_passed')[1]}, 8) as candidate_high,
 round(case when gained + lost = 0 then 1.0 else least(1.0, 2 * (select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) from (select gained + lost as n, unnest(range(0, least(gained, lost) + 1)) as i from t))) end, 8) as mcnemar_p from u"""


def _rounded(df):
    return df.select(*(F.round(c, 8).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query("with r as (select l_linestatus = 'O' as a, l_returnflag <> 'R' as b from lineitem), " + _TRANS)
def paired_transitions_large(spark, d):
    return _rounded(P.transitions(_runs(spark, d), F.col("base_passed"), F.col("candidate_passed")))


def _two_runs(spark, d):
    rows = responses(spark, d, "id", "sample_id", "passed", "failure_type").where("id is not null")
    pick = lambda k: rows.where(F.col("sample_id") == k).groupBy("id").agg(F.min_by("passed", "response_id").alias("passed"), F.min_by("failure_type", "response_id").alias("failure_type"))
    return pick(0), pick(1)


_TWO = f"x as (select id, sample_id, (list(passed order by response_id))[1] as passed from {RESPONSES} where sample_id in (0, 1) and id is not null group by all), "


@query(f"with {_TWO} r as (select coalesce(p.passed, false) as a, coalesce(q.passed, false) as b from x p join x q on p.id = q.id and p.sample_id = 0 and q.sample_id = 1), " + _TRANS)
def paired_transitions_mcnemar(spark, d):
    base, candidate = _two_runs(spark, d)
    both = P.paired(base, candidate, "id", ["passed"]).where("in_base and in_candidate")
    return _rounded(P.transitions(both, F.col("base_passed"), F.col("candidate_passed")))


@query(f"with {_TWO} y as (select id, bool_or(sample_id = 0) as a, bool_or(sample_id = 1) as b from x group by 1) select count(*) filter (a and b) as common, count(*) filter (a and not b) as only_base, count(*) filter (b and not a) as only_candidate from y")
def run_overlap(spark, d):
    return P.overlap(P.paired(*_two_runs(spark, d), "id", ["passed"]))


@query()
def paired_bootstrap(spark, d):
    return P.bootstrap_difference(_runs(spark, d), F.col("base_passed"), F.col("candidate_passed"))


@query("select count(*) as rows, 20000 as iterations, true as covers, true as near_normal from lineitem")
def paired_bootstrap_bounds(spark, d):
    """Whether the bootstrap's interval covers the difference seen, and is within a tenth as wide as the normal one."""
    runs = _runs(spark, d)
    gain = F.col("candidate_passed").cast("int") - F.col("base_passed").cast("int")
    seen = runs.agg(F.avg(gain).alias("gain"), (F.stddev_pop(gain) / F.sqrt(F.count("*"))).alias("error"))
    both = P.bootstrap_difference(runs, F.col("base_passed"), F.col("candidate_passed")).crossJoin(seen)  # a row each
    width = F.col("high") - F.col("low")
    return both.select("rows", "iterations", ((F.col("low") <= F.col("gain")) & (F.col("gain") <= F.col("high"))).alias("covers"), (F.abs(width / (2 * 1.959964 * F.col("error")) - 1) < 0.1).alias("near_normal"))


@query(f"""with t as (select model, count(*)::double as rows, count(*) filter (passed) as p from {RESPONSES} group by 1) select model, rows::bigint as rows, p as passed, round({_WILSON('p')[0]}, 8) as low, round({_WILSON('p')[1]}, 8) as high,
 ceil({_Z}**2 * (p / rows) * (1 - p / rows) / 0.0025)::bigint as rows_for_5_percent from t""")
def wilson_ci(spark, d):
    t = responses(spark, d, "model", "passed").groupBy("model").agg(F.count("*").alias("rows"), F.count_if("passed").alias("passed"))
    low, high = X.wilson(F.col("passed"), F.col("rows"))
    return t.select("model", "rows", "passed", F.round(low, 8).alias("low"), F.round(high, 8).alias("high"), X.sample_size(F.col("passed") / F.col("rows"), 0.05).alias("rows_for_5_percent"))


@query(f"with r as (select l_linestatus = 'O' as a, l_returnflag <> 'R' as b from lineitem) select count(*) as rows, count(*) filter (a) / count(*) as base_rate, count(*) filter (b) / count(*) as candidate_rate, count(*) filter (b) > count(*) filter (a) as improves, count(*) filter (b) / count(*) >= 0.5 as half, count(*) filter (b) > count(*) filter (a) and count(*) filter (b) / count(*) >= 0.5 as go from r")
def repair_gate_summary(spark, d):
    t = _runs(spark, d).agg(F.count("*").alias("rows"), F.avg(F.col("base_passed").cast("int")).alias("base_rate"), F.avg(F.col("candidate_passed").cast("int")).alias("candidate_rate"))
    from lodestack.operators.audit import gates

    g = {"improves": F.col("candidate_rate") > F.col("base_rate"), "half": F.col("candidate_rate") >= 0.5}
    both = t.join(gates(t, g))  # one row each
    return both.select("rows", "base_rate", "candidate_rate", *(F.col("gates")[k].alias(k) for k in g), "go")
