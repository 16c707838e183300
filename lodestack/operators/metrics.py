"""Classification, ranking and task metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestack.functions import stats as X
from lodestack.operators.ordered import cumulative


def value_counts(df: DataFrame, value: Column, name: str, null: str = "None") -> DataFrame:
    """How often each value comes; nulls under ``null``."""
    return df.groupBy(F.coalesce(value.cast("string"), F.lit(null)).alias(name)).agg(F.count("*").alias("rows"))


def task_metrics(df: DataFrame, task: str, passed: Column, groups: list[str] | None = None) -> DataFrame:
    """Samples and tasks by outcome: any, all, some and no sample passed.  A null outcome is a failure."""
    groups = groups or []
    ok = F.coalesce(passed, F.lit(False))
    per = df.groupBy(*groups, task).agg(F.count("*").alias("n"), F.count_if(ok).alias("p"))
    any_, all_ = F.count_if(F.expr("p > 0")), F.count_if(F.expr("p = n"))
    return per.groupBy(*groups).agg(
        F.count("*").alias("tasks"), F.sum("n").alias("responses"), F.sum("p").alias("passed_responses"), (F.sum("n") - F.sum("p")).alias("failed_responses"),
        X.rate(F.sum("p"), F.sum("n"), 6).alias("response_pass_rate"), X.rate(any_, F.count("*"), 6).alias("task_pass_at_k"),
        any_.alias("tasks_with_any_pass"), all_.alias("tasks_with_all_pass"), (any_ - all_).alias("tasks_with_partial_pass"), F.count_if(F.expr("p = 0")).alias("tasks_with_all_fail"),
    )


def pass_rates(df: DataFrame, passed: Column, sets: list[list[str]]) -> DataFrame:
    """Totals and pass rates at several levels in one pass (grouping sets); a level's missing columns are null."""
    cols = list(dict.fromkeys(c for s in sets for c in s))
    ok = F.coalesce(passed, F.lit(False))
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(F.grouping_id().alias("level"), F.count("*").alias("total"), F.count_if(ok).alias("passed"))
    return out.withColumn("failed", F.col("total") - F.col("passed")).withColumn("pass_rate", X.rate(F.col("passed"), F.col("total"), 6))


def confusion(df: DataFrame, gold: Column, predicted: Column, groups: list[str] | None = None) -> DataFrame:
    """The 2x2 table and its rates, 0 for empty denominators; null gold or prediction counts as negative."""
    g, p = F.coalesce(gold, F.lit(False)), F.coalesce(predicted, F.lit(False))
    t = df.groupBy(*(groups or [])).agg(F.count("*").alias("rows"), F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(~g & ~p).alias("tn"), F.count_if(g & ~p).alias("fn"))
    return with_rates(t)


def with_rates(t: DataFrame) -> DataFrame:
    """Rates from counts tp, fp, tn, fn."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    recall, spec = X.rate(tp, tp + fn), X.rate(tn, tn + fp)
    return t.select(
        "*", X.rate(tp + tn, tp + fp + tn + fn).alias("accuracy"), ((recall + spec) / 2).alias("balanced_accuracy"), X.kappa(tp, tn, fp, fn).alias("kappa"),
        X.rate(tp, tp + fp).alias("precision_pass"), recall.alias("recall_pass"), X.rate(tn, tn + fn).alias("precision_fail"), spec.alias("specificity"),
        X.rate(fp, fp + tn).alias("overacceptance_rate"), X.rate(fn, fn + tp).alias("false_rejection_rate"),
    )


def _scored(df: DataFrame, gold: Column, score: Column, groups: list[str]) -> DataFrame:
    """Positives and negatives of each distinct score; null and NaN scores take no part."""
    s = score.cast("double")
    ok = F.coalesce(gold, F.lit(False))
    return df.where(s.isNotNull() & ~F.isnan(s)).groupBy(*groups, s.alias("score")).agg(F.count_if(ok).alias("pos"), F.count_if(~ok).alias("neg"))


def exact_auc(df: DataFrame, gold: Column, score: Column) -> DataFrame:
    """The area under the ROC curve with ties at a half; null for one class.

    Rows are counted by distinct score, and pairs follow from cumulative
    counts over range partitions, so no task sees all scores.
    """
    counts = cumulative(_scored(df, gold, score, []), ["score"], neg=F.col("neg"))
    won = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2))
    pos, neg = F.sum("pos"), F.sum("neg")
    return counts.agg(pos.alias("positives"), neg.alias("negatives"), F.when(F.coalesce(pos, F.lit(0)) * F.coalesce(neg, F.lit(0)) > 0, won / (pos.cast("double") * neg)).alias("auc"))


def probability_metrics(df: DataFrame, gold: Column, probability: Column, eps: float = 1e-12) -> DataFrame:
    """Brier score and log loss; null probabilities take no part."""
    p, y = probability.cast("double"), F.coalesce(gold, F.lit(False)).cast("int")
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1.0))
    r = F.least(F.greatest(1 - p, F.lit(eps)), F.lit(1.0))
    rows = df.where(p.isNotNull() & ~F.isnan(p))
    return rows.agg(F.count("*").alias("rows"), F.avg((p - y) ** 2).alias("brier"), (-F.avg(y * F.log(q) + (1 - y) * F.log(r))).alias("log_loss"))


def sweep_grid(df: DataFrame, gold: Column, score: Column, grid: list[float]) -> DataFrame:
    """Rates at every threshold of a grid (score >= threshold passes).

    Every row falls into one interval of the grid, the counts of at most
    len(grid) + 1 intervals are added up, and no row meets every threshold.
    """
    spark = df.sparkSession
    at = F.lit(0)
    for k, g in enumerate(grid):
        at = F.when(F.col("score") >= g, k + 1).otherwise(at)
    bins = _scored(df, gold, score, []).groupBy(at.alias("bin")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    steps = spark.createDataFrame([(k + 1, float(g)) for k, g in enumerate(grid)], "step int, threshold double")
    is_in = F.col("bin") >= F.col("step")
    met = F.broadcast(steps).crossJoin(bins)  # len(grid) x (len(grid) + 1) rows
    z = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    t = met.groupBy("threshold").agg(z(F.when(is_in, F.col("pos"))).alias("tp"), z(F.when(is_in, F.col("neg"))).alias("fp"), z(F.when(~is_in, F.col("neg"))).alias("tn"), z(F.when(~is_in, F.col("pos"))).alias("fn"))
    return with_rates(t)


def sweep_scores(df: DataFrame, gold: Column, score: Column) -> DataFrame:
    """Rates at every distinct score as the threshold, by cumulative counts."""
    counts = _scored(df, gold, score, [])
    total = counts.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    c = cumulative(counts, ["score"], pos=F.col("pos"), neg=F.col("neg")).crossJoin(F.broadcast(total))  # one row
    tn, fn = F.col("before_neg").cast("long"), F.col("before_pos").cast("long")
    return with_rates(c.select(F.col("score").alias("threshold"), (F.col("P") - fn).alias("tp"), (F.col("N") - tn).alias("fp"), tn.alias("tn"), fn.alias("fn")))


def best_threshold(sweep: DataFrame, by: list[Column], where: Column | None = None) -> DataFrame:
    """The row of a sweep with the greatest ``by``; of equal ones the smallest threshold."""
    rows = sweep if where is None else sweep.where(where)
    return rows.orderBy(*(c.desc() for c in by), "threshold").limit(1)


def score_buckets(score: Column, edges: list[float]) -> Column:
    """A label for the interval that a score lies in; 'missing' for null and NaN."""
    out = F.lit(f"<{edges[0]:g}")
    for low, high in zip(edges, [*edges[1:], None]):
        out = F.when(score >= low, f"{low:g}-{high:g}" if high is not None else f">={low:g}").otherwise(out)
    return F.when(score.isNull() | F.isnan(score), "missing").otherwise(out)


def selection_report(df: DataFrame, task: str, key: str, score: Column, gold: Column) -> DataFrame:
    """Picking by score against picking the first and against any: one row.

    A task's picks are minima over its rows (map-side), not a sort of its rows.
    """
    ok = F.coalesce(gold, F.lit(False))
    s = F.when(score.isNull() | F.isnan(score), F.lit(float("-inf"))).otherwise(score.cast("double"))
    picks = df.groupBy(task).agg(
        F.min(F.struct((-s).alias("s"), F.col(key).alias("k"), ok.alias("ok"))).alias("best"), F.min(F.struct(F.col(key).alias("k"), ok.alias("ok"))).alias("first"), F.bool_or(ok).alias("any"), F.count("*").alias("n")
    )
    a, b = F.col("best.ok"), F.col("first.ok")
    t = picks.agg(
        F.count("*").alias("problems"), F.sum("n").alias("candidates"), F.count_if(a).alias("selected_passed"), F.count_if(b).alias("first_passed"), F.count_if("any").alias("oracle_passed"),
        F.count_if(a & b).alias("both_pass"), F.count_if(a & ~b).alias("selected_only"), F.count_if(b & ~a).alias("first_only"), F.count_if(~a & ~b).alias("neither"),
    )
    return t.withColumn("sign_test_p", X.exact_sign_p(F.col("selected_only"), F.col("first_only"), None))
