"""Queries that split, rank, deduplicate, gate and pair rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions import hashing as H, pyast, text as T
from lodestack.operators import contrast, gates as G, selection as S
from lodestack.operators.ordered import ranked
from lodestack.plans.q_metrics import _SCORED, _judged
from lodestack.plans.tables import FAILURES, PROBLEMS, RESPONSES, SFT, once, problems, responses, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_HEX = lambda e, n: f"('0x' || substr({e}, 1, {n}))::UBIGINT"
_SPLIT = lambda b, t, v: f"case when {b} < {t} then 'train' when {b} < {t + v} then 'validation' else 'test' end"


@query(f"select id, {_SPLIT(_HEX('sha1(id)', 8) + ' % 100', 80, 10)} as split from {PROBLEMS}")
def stable_split_sha1(spark, d):
    return problems(spark, d).select("id", H.split_by_bucket(H.bucket_sha1(F.col("id")), 80, 10).alias("split"))


@query(f"select id, ({_HEX('sha256(id)', 16)} % 100)::bigint as bucket, {_SPLIT(_HEX('sha256(id)', 16) + ' % 100', 90, 10)} as split from {PROBLEMS}")
def stable_split_sha256_16(spark, d):
    b = H.bucket_sha256(F.col("id"))
    return problems(spark, d).select("id", b.alias("bucket"), H.split_by_bucket(b, 90, 10).alias("split"))


@query(f"select id, ({_HEX('sha256(id)', 8)} % 7)::bigint as bucket from {PROBLEMS}")
def stable_bucket_sha256_8(spark, d):
    return problems(spark, d).select("id", H.bucket_sha256(F.col("id"), 7, 8).alias("bucket"))


@query(f"with t as (select id, row_number() over (order by sha256('v1:' || id), id) - 1 as r, count(*) over () as n from {PROBLEMS}) select id as key, case when r < round_even(n * 0.7, 0) then 'train' when r < round_even(n * 0.7, 0) + round_even(n * 0.15, 0) then 'validation' else 'test' end as split from t")
def salted_rank_split(spark, d):
    return S.proportion_split(problems(spark, d), "id", "v1", {"train": 0.7, "validation": 0.15, "test": 0.15})


@query(f"select id, sha256('42:' || id) as order_hash from {PROBLEMS} where split = 'train' order by 2, 1 limit 160")
def salted_order_freeze(spark, d):
    return problems(spark, d, "split").where("split = 'train'").select("id", H.salted_order(F.col("id"), "42").alias("order_hash")).orderBy("order_hash", "id").limit(160)


@query(f"select response_id, substr(sha256(coalesce(nullif(extracted_code, ''), generated_code)), 1, 12) as code_sha from {RESPONSES}")
def code_hash(spark, d):
    return responses(spark, d, "extracted_code", "generated_code").select("response_id", H.short_hash(T.or_else(F.col("extracted_code"), F.col("generated_code"))).alias("code_sha"))


@query(f"select id, ('0x' || substr(sha256(id), 64, 1))::int % 2 = 0 as side, {_HEX('sha256(id)', 16)}::double / 18446744073709551616.0 as unit from {PROBLEMS}")
def stable_side_unit(spark, d):
    return problems(spark, d).select("id", H.side(F.col("id")).alias("side"), H.unit_interval(F.col("id")).alias("unit"))


@query(f"select id, unnest(range(0, 1 + (({_HEX('sha256(id)', 16)}::double / 18446744073709551616.0) < 0.35)::int)) as copy from {SFT}")
def fractional_repeat(spark, d):
    rows = once(spark, d, "sft_records", "id").withColumn("n", H.repeats(1.35, F.col("id")))
    return rows.select("id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy")).withColumn("copy", F.col("copy").cast("long"))


@query(f"select distinct on (id, code) id, code, response_id from (select id, response_id, coalesce(nullif(extracted_code, ''), generated_code) as code from {RESPONSES} where id is not null) where code is not null order by id, code, response_id")
def dedup_keep_first(spark, d):
    rows = responses(spark, d, "id", "extracted_code", "generated_code").select("id", T.or_else(F.col("extracted_code"), F.col("generated_code")).alias("code"), "response_id")
    return S.keep_first(rows.where("id is not null and code is not null"), ["id", "code"], [F.col("response_id")])


@query(f"select id, response_id, overall_score from {_SCORED} where id is not null qualify row_number() over (partition by id order by overall_score desc, response_id) = 1")
def top1_per_group(spark, d):
    rows = _judged(spark, d).where("id is not null and overall_score is not null and not isnan(overall_score)")
    return S.top_k(rows.select("id", "response_id", "overall_score"), ["id"], [F.desc("overall_score"), F.col("response_id")], 1)


@query(f"select model, response_id, generated_token_count from {RESPONSES} where passed qualify row_number() over (partition by model order by generated_token_count nulls last, response_id) <= 5")
def topk_per_group(spark, d):
    rows = responses(spark, d, "model", "generated_token_count", "passed").where("passed").drop("passed")
    return S.top_k(rows.select("model", "response_id", "generated_token_count"), ["model"], [F.asc_nulls_last("generated_token_count"), F.col("response_id")], 5)


@query(f"with t as (select coalesce(failure_type, 'unknown') as bucket, response_id, row_number() over (partition by coalesce(failure_type, 'unknown') order by sha256('rr:' || response_id), response_id) as turn from {FAILURES}) select bucket, response_id, turn from t order by turn, bucket limit 120")
def round_robin_balance(spark, d):
    rows = once(spark, d, "failures", "response_id", "failure_type").select(F.coalesce("failure_type", F.lit("unknown")).alias("bucket"), "response_id")
    return S.round_robin(rows, "bucket", [H.salted_order(F.col("response_id"), "rr"), F.col("response_id")], 120).select("bucket", "response_id", F.col("turn").cast("long").alias("turn"))


@query(f"select response_id, overall_score from {_SCORED} where not gold order by overall_score desc, response_id limit 100")
def priority_order_limit(spark, d):
    rows = _judged(spark, d).where(~F.coalesce("passed", F.lit(False)) & F.col("overall_score").isNotNull() & ~F.isnan("overall_score"))
    return rows.select("response_id", "overall_score").orderBy(F.desc("overall_score"), "response_id").limit(100)


@query(f"select id, row_number() over (order by sha256('p:' || id), id) - 1 as rank from {PROBLEMS}")
def global_rank(spark, d):
    return ranked(problems(spark, d).withColumn("o", H.salted_order(F.col("id"), "p")), ["o", "id"]).select("id", "rank")


@query(f"select error_pattern, count(*) as rows from {FAILURES} group by 1 order by 2 desc, 1 nulls first limit 4")
def most_common_topn(spark, d):
    return S.most_common(once(spark, d, "failures", "response_id", "error_pattern"), "error_pattern", 4)


@query(f"""with f as (select failure_type, error_pattern, response_id, row_number() over (partition by failure_type, error_pattern order by response_id) as nth, count(*) over (partition by failure_type, error_pattern) as freq from {FAILURES})
 select failure_type, error_pattern, response_id, place from (select *, row_number() over (partition by failure_type order by nth, freq desc, error_pattern nulls first, response_id) as place from f where nth <= 8) where place <= 8""")
def diverse_examples(spark, d):
    rows = once(spark, d, "failures", "response_id", "failure_type", "error_pattern")
    return S.diverse_examples(rows, "failure_type", "error_pattern", "response_id", 8).select("failure_type", "error_pattern", "response_id", F.col("place").cast("long").alias("place"))


@query(f"select failure_type, response_id from {FAILURES} qualify row_number() over (partition by failure_type order by sha256('s:' || response_id), response_id) <= 10")
def stratified_sample(spark, d):
    return S.stratified(once(spark, d, "failures", "response_id", "failure_type"), "failure_type", "response_id", "s", 10).select("failure_type", "response_id")


@query(f"""with recursive r as (select response_id, id, failure_type, row_number() over (order by sha256('g:' || response_id), response_id) as n from {FAILURES} where id is not null and failure_type is not null),
 g as (select 0::bigint as n, null::varchar as response_id, null::varchar as id, null::varchar as failure_type, false as taken, []::varchar[] as ids, []::varchar[] as kinds union all
 select n, response_id, id, failure_type, ok, case when ok then list_append(ids, id) else ids end, case when ok then list_append(kinds, failure_type) else kinds end from (select r.n, r.response_id, r.id, r.failure_type, g.ids, g.kinds,
 len(list_filter(g.ids, lambda x: x = r.id)) < 2 and len(list_filter(g.kinds, lambda x: x = r.failure_type)) < 50 as ok from g join r on r.n = g.n + 1))
 select response_id, id, failure_type from g where taken""")
def greedy_multi_cap(spark, d):
    """Failures in a salted order, two of a task and fifty of a type at most."""
    rows = once(spark, d, "failures", "response_id", "id", "failure_type").withColumn("o", H.salted_order(F.col("response_id"), "g"))
    return S.greedy_capped(rows, ["o", "response_id"], {"id": 2, "failure_type": 50}).select("response_id", "id", "failure_type")


_FAILED = f"(select id, response_id, overall_score as s from {_SCORED} where not gold and id is not null)"


@query(f"select id, arg_min(response_id, row(s, response_id)) as low_key, arg_min(response_id, row(-s, response_id)) as high_key, max(s) - min(s) as margin from {_FAILED} group by id having max(s) - min(s) >= 1")
def weak_margin_pairs(spark, d):
    rows = _judged(spark, d).where(~F.coalesce("passed", F.lit(False)) & F.col("id").isNotNull())
    return S.margin_pairs(rows, "id", "response_id", "overall_score", 1.0)


@query(f"""with r as (select id, response_id, greatest(1, length(coalesce(nullif(extracted_code, ''), generated_code))) as n, coalesce(passed, false) as ok from {RESPONSES} where id is not null)
 select c.id, c.response_id as chosen, min(b.response_id) as rejected from r c join r b on c.id = b.id and c.ok and not b.ok and greatest(c.n, b.n) <= 8 * least(c.n, b.n) group by all""")
def pass_fail_contrast_pairs(spark, d):
    code = T.or_else(F.col("extracted_code"), F.col("generated_code"))
    rows = responses(spark, d, "id", "passed", "extracted_code", "generated_code").select("id", "response_id", F.length(code).alias("n"), "passed")
    return contrast.first_compatible(rows, "id", "response_id", "n", "passed")


def _repairs(spark, d):
    """Repairs beside the answers they repair, with the frozen tasks that mustn't be used marked."""
    cols = ("original_response_id", "id", "split", "passed", "model", "finish_reason", "prompt_mode", "io_mode", "interface_names", "failure_type")
    code = T.normalize_code(T.or_else(F.col("extracted_code"), F.coalesce("generated_code", F.lit(""))))
    r = responses(spark, d, *cols, "extracted_code", "generated_code").withColumn("code", code).drop("extracted_code", "generated_code")
    repairs = r.where("original_response_id is not null")
    original = r.select(*(F.col(c).alias(f"o_{c}") for c in ("response_id", "id", "split", "passed", "model", "failure_type", "code")))
    frozen = table(spark, d, "problems").where("eval_split is not null and id is not null").select(F.col("id").alias("f_id")).distinct()
    both = repairs.join(original, F.col("original_response_id") == F.col("o_response_id"), "left").join(frozen, F.col("id") == F.col("f_id"), "left")
    return both.withColumn("chars", F.length("code")).withColumn("o_chars", F.length("o_code"))


#: The reasons' names and their order.  The gates are expressions that Spark and the SQL both read; the cap comes between the two lists.
EARLY = [("repair_failed_verifier", "not coalesce(passed, false)"), ("missing_problem_id", "id is null or id = ''"), ("forbidden_problem_id", "f_id is not null")]
LATE = [
    ("missing_original", "o_response_id is null"), ("original_problem_mismatch", "o_id is null or o_id <> id"), ("non_train_split", "coalesce(o_split, '') <> 'train' or coalesce(split, '') <> 'train'"),
    ("original_not_failed", "coalesce(o_passed, false)"), ("model_mismatch", "coalesce(model, '') <> '' and coalesce(o_model, '') <> '' and model <> o_model"), ("chosen_length_finish", "finish_reason = 'length'"),
    ("normalized_fence_remains", "code like '%```%' or o_code like '%```%'"), ("empty_normalized_code", "code = '' or o_code = ''"), ("identical_normalized_code", "code = o_code"),
]
RATIO = [("length_ratio_too_large", "greatest(length(code), length(o_code)) > 8 * greatest(1, least(length(code), length(o_code)))")]


def _exprs(gates):
    return [(k, F.expr(e)) for k, e in gates]


def _order():
    return [F.when(F.col("prompt_mode").contains("two_stage"), 0).otherwise(1), F.col("response_id")]


_NORMAL = lambda c: f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(case when regexp_matches({c}, '(?is)```(?:python)?\\s*(.*?)```') then regexp_extract({c}, '(?is)```(?:python)?\\s*(.*?)```', 1) else {c} end, '\\r\\n?', chr(10), 'g'), chr(10) || chr(9) || chr(12) || chr(11) || ' '), '[ \\t\\f\\v]+\\n', chr(10), 'g'), '(?i)^\\s*```(?:python)?\\s*\\n', ''), '\\n\\s*```\\s*$', ''), '(?i)^```(?:python)?$', ''), chr(10) || chr(9) || chr(12) || chr(11) || ' ')"
_CASE = lambda g: "case " + " ".join(f"when {e} then '{k}'" for k, e in g) + " end"
_GATED = f"""with r as (select *, {_NORMAL("coalesce(nullif(extracted_code, ''), generated_code, '')")} as code from {RESPONSES}), f as (select distinct id as f_id from problems where eval_split is not null and id is not null),
 b as (select r.*, o.response_id as o_response_id, o.id as o_id, o.split as o_split, o.passed as o_passed, o.model as o_model, o.code as o_code, f_id from r left join r o on r.original_response_id = o.response_id left join f on r.id = f.f_id where r.original_response_id is not null),
 g as (select *, {_CASE(EARLY)} as early, {_CASE(LATE + RATIO)} as late from b),
 c as (select *, coalesce(sum((early is null and late is null)::int) over (partition by id order by case when prompt_mode like '%two_stage%' then 0 else 1 end, response_id rows between unbounded preceding and 1 preceding), 0) as before from g),
 z as (select id, response_id, original_response_id, coalesce(early, case when before >= 1 then 'max_pairs_per_problem' end, late) as reason from c) """


def _gated(spark, d, late, df=None):
    return G.gate_chain(_repairs(spark, d) if df is None else df, _exprs(EARLY), late, "id", _order(), 1, "max_pairs_per_problem", ["id", "response_id", "original_response_id"])


@query(_GATED + "select coalesce(reason, 'accepted') as reason, count(*) as rows from z group by 1")
def gate_chain_reasons(spark, d):
    return G.reason_counts(_gated(spark, d, _exprs(LATE + RATIO)))


@query(_GATED + "select id, response_id as chosen, original_response_id as rejected from z where reason is null")
def running_cap_pairs(spark, d):
    return _gated(spark, d, _exprs(LATE + RATIO)).where("reason is null").select("id", F.col("response_id").alias("chosen"), F.col("original_response_id").alias("rejected"))


@query()
def verified_repair_pairs(spark, d):
    """As running_cap_pairs, with the gates that need a parser between the cheap ones; only distinct programs that pass those are parsed."""
    rows = _repairs(spark, d).withColumn("cheap", G.first_reason(_exprs(EARLY + LATE)))
    parsed = pyast.analysed(rows.withColumn("to_parse", F.when(F.col("cheap").isNull(), F.col("code"))), "to_parse")
    call = F.col("io_mode") == "function_call"
    names = F.coalesce("interface_names", F.array().cast("array<string>"))
    has = (F.size(names) == 0) | F.arrays_overlap(names, F.concat("audit.functions", "audit.solution_methods"))
    late = [*_exprs(LATE), ("chosen_not_parseable", ~F.col("audit.parseable")), ("chosen_interface_missing", call & ~has), ("chosen_top_level_demo", call & (F.col("audit.demos") > 0)), *_exprs(RATIO)]
    return _gated(spark, d, late, parsed).select("id", "response_id", "original_response_id", F.coalesce("reason", F.lit("accepted")).alias("reason"))
