"""Rubric scores: maps of dimension to (applicable, score, rationale)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F



def applicable_scores(scores: Column) -> Column:
    """Scores of the applicable dimensions."""
    values = F.filter(F.map_values(scores), lambda d: F.coalesce(d["applicable"], F.lit(False)) & d["score"].isNotNull())
    return F.transform(values, lambda d: d["score"].cast("double"))


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(values) > 0, total / F.nullif(F.size(values), F.lit(0)))


def mean_score(scores: Column) -> Column:
    """The mean of the applicable scores; null without any."""
    return _mean(applicable_scores(scores))


def least_score(scores: Column, dimensions: tuple[str, ...] | None = None) -> Column:
    """The lowest applicable score, of all dimensions or the named ones."""
    if dimensions:
        scores = F.map_filter(scores, lambda k, _: k.isin(list(dimensions)))
    return F.array_min(applicable_scores(scores))


def all_at_least(scores: Column, least: float) -> Column:
    """Whether there are applicable scores and all reach ``least``."""
    s = applicable_scores(scores)
    return (F.size(s) > 0) & F.forall(s, lambda x: x >= least)


def weighted_mean(scores: Column, weights: dict[str, float]) -> Column:
    """The weighted mean over applicable dimensions with a weight; null without any."""
    part = lambda k: F.coalesce(F.try_element_at(scores, F.lit(k))["applicable"], F.lit(False)) & F.try_element_at(scores, F.lit(k))["score"].isNotNull()
    num = sum((F.when(part(k), F.try_element_at(scores, F.lit(k))["score"] * w).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    den = sum((F.when(part(k), F.lit(float(w))).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    return F.when(den > 0, num / F.nullif(den, F.lit(0.0)))


def capped(score: Column, caps: list[tuple[Column, float]]) -> Column:
    """A score no higher than each cap whose condition holds."""
    for condition, cap in caps:
        score = F.when(F.coalesce(condition, F.lit(False)), F.least(score, F.lit(cap))).otherwise(score)
    return score


def clamp_dimension(scores: Column, dimension: str, cap: int, reason: str, when: Column) -> Column:
    """The map with a dimension's score lowered to ``cap`` and the reason added to its rationale, where ``when`` holds and the score is higher."""
    def lower(k: Column, d: Column) -> Column:
        hit = (k == dimension) & F.coalesce(when, F.lit(False)) & F.coalesce(d["applicable"], F.lit(False)) & (d["score"] > cap)
        return F.when(hit, d.withField("score", F.lit(cap)).withField("rationale", F.concat_ws(" ", d["rationale"], F.lit(reason)))).otherwise(d)

    return F.transform_values(scores, lower)


def decisions(scores: Column, threshold: float, semantic: tuple[str, ...], critical: Column) -> dict[str, Column]:
    """Pass decisions: by the mean, by the mean and the semantic bottleneck, and strictly, without critical errors."""
    mean = mean_score(scores)
    low = least_score(scores, semantic)
    plain = F.coalesce(mean >= threshold, F.lit(False))
    calibrated = plain & F.coalesce(low >= 3, F.lit(True))
    return {"plain": plain, "calibrated": calibrated, "strict": calibrated & (F.coalesce(F.size(critical), F.lit(0)) == 0)}


def by_dimension(df: DataFrame, scores: str, passed: Column) -> DataFrame:
    """For each dimension: rows, how often it applies, the mean score of all, passed and failed rows, and the counts of scores 1 to 5."""
    rows = df.select(passed.alias("passed"), F.explode(F.map_entries(F.col(scores))).alias("e")).select("passed", F.col("e.key").alias("dimension"), F.coalesce("e.value.applicable", F.lit(False)).alias("applies"), F.col("e.value.score").alias("score"))
    s = F.when(F.col("applies"), F.col("score"))
    return rows.groupBy("dimension").agg(
        F.count("*").alias("rows"), F.avg(F.col("applies").cast("int")).alias("applicable_rate"), F.avg(s).alias("mean_score"), F.avg(F.when(F.col("passed"), s)).alias("mean_passed"),
        F.avg(F.when(~F.coalesce("passed", F.lit(False)), s)).alias("mean_failed"), *(F.count_if(s == k).alias(f"score_{k}") for k in range(1, 6)),
    )


def collapse_report(df: DataFrame, scores: str, passed: Column, score: str) -> DataFrame:
    """Whether scores still tell passed rows from failed ones: how many rows have one score throughout, and the gap of the means."""
    ok = F.coalesce(passed, F.lit(False))
    s = applicable_scores(F.col(scores))
    flat = (F.size(s) > 1) & (F.array_min(s) == F.array_max(s))
    v = F.when(~F.isnan(score), F.col(score))
    return df.agg(F.count("*").alias("rows"), F.count_if(flat).alias("flat_rows"), F.count_if(flat & ok).alias("flat_passed"), F.count_if(flat & ~ok).alias("flat_failed"), F.avg(F.when(ok, v)).alias("mean_passed"), F.avg(F.when(~ok, v)).alias("mean_failed"), (F.avg(F.when(ok, v)) - F.avg(F.when(~ok, v))).alias("mean_gap"))


def probe_problems(kinds: Column, required: tuple[str, ...]) -> Column:
    """Required probe kinds that don't come exactly once."""
    return F.filter(F.array(*(F.lit(k) for k in required)), lambda k: F.size(F.filter(kinds, lambda x: x == k)) != 1)


def routed(base: Column, candidate: Column) -> Column:
    """Which of two answers to serve by their protected scores; ties and nulls keep the base."""
    return F.when(F.coalesce(candidate, F.lit(float("-inf"))) > F.coalesce(base, F.lit(float("-inf"))), "candidate").otherwise("base")


def protected_score(parseable: Column, interface: Column, demos: Column) -> Column:
    """5 for a parseable program that defines what is asked and runs nothing by itself, 2 for any other parseable one, 1 else."""
    return F.when(~F.coalesce(parseable, F.lit(False)), 1).when(F.coalesce(interface, F.lit(False)) & (F.coalesce(demos, F.lit(0)) == 0), 5).otherwise(2)


def arms(df: DataFrame, rubrics: dict[str, str]) -> DataFrame:
    """Every row under every rubric: an array of the arms, exploded."""
    return df.withColumn("arm", F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.lit(v).alias("rubric")) for k, v in rubrics.items()))))


def judged(text: Column) -> Column:
    """A forced choice from two log-probabilities is ``stats.sigmoid`` of their difference; this maps a verdict to a boolean."""
    return F.when(text == "PASS", True).when(text == "FAIL", False)


