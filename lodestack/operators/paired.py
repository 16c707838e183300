"""Comparing two runs over the same tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lodestack.functions import stats as X


class PairingError(ValueError):
    """Two runs don't cover the same tasks."""


def paired(base: DataFrame, candidate: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, in_base, in_candidate, base_<c>, candidate_<c>): both runs side by side, a full join."""
    a = base.select(F.col(key).alias("key"), F.lit(True).alias("in_base"), *(F.col(c).alias(f"base_{c}") for c in columns))
    b = candidate.select(F.col(key).alias("key"), F.lit(True).alias("in_candidate"), *(F.col(c).alias(f"candidate_{c}") for c in columns))
    return a.join(b, "key", "full").withColumn("in_base", F.coalesce("in_base", F.lit(False))).withColumn("in_candidate", F.coalesce("in_candidate", F.lit(False)))


def strictly_paired(base: DataFrame, candidate: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """As ``paired``; raises unless both runs have the same keys, once each."""
    both = paired(base, candidate, key, columns)
    bad = both.agg(F.count_if(~F.col("in_base")).alias("a"), F.count_if(~F.col("in_candidate")).alias("b"), (F.count("*") - F.countDistinct("key")).alias("c")).first()
    if any(bad):
        raise PairingError(f"only candidate: {bad['a']}, only base: {bad['b']}, repeated keys: {bad['c']}")
    return both


def overlap(both: DataFrame) -> DataFrame:
    """How many keys both runs have, and either alone."""
    a, b = F.col("in_base"), F.col("in_candidate")
    return both.agg(F.count_if(a & b).alias("common"), F.count_if(a & ~b).alias("only_base"), F.count_if(b & ~a).alias("only_candidate"))


def transitions(both: DataFrame, base: Column, candidate: Column, groups: list[str] | None = None) -> DataFrame:
    """Outcomes of both runs against each other, Wilson intervals and the exact McNemar test; null outcomes are failures."""
    a, b = F.coalesce(base, F.lit(False)), F.coalesce(candidate, F.lit(False))
    t = both.groupBy(*(groups or [])).agg(
        F.count("*").alias("rows"), F.count_if(a).alias("base_passed"), F.count_if(b).alias("candidate_passed"), F.count_if(~a & b).alias("gained"),
        F.count_if(a & ~b).alias("lost"), F.count_if(a & b).alias("kept"), F.count_if(~a & ~b).alias("failed_both"),
    )
    (bl, bh), (cl, ch) = X.wilson(F.col("base_passed"), F.col("rows")), X.wilson(F.col("candidate_passed"), F.col("rows"))
    return t.select("*", (F.col("candidate_passed") - F.col("base_passed")).alias("net_delta"), bl.alias("base_low"), bh.alias("base_high"), cl.alias("candidate_low"), ch.alias("candidate_high"), X.exact_sign_p(F.col("gained"), F.col("lost")).alias("mcnemar_p"))


def timeout_sensitivity(both: DataFrame, same_code: Column) -> DataFrame:
    """Lost rows whose code is unchanged and whose candidate timed out, and the delta with those scored as passed.  Needs passed and failure_type."""
    a, b = F.coalesce("base_passed", F.lit(False)), F.coalesce("candidate_passed", F.lit(False))
    flake = a & ~b & same_code & (F.col("candidate_failure_type") == "timeout")
    return both.agg(F.count_if(a & ~b).alias("lost"), F.count_if(flake).alias("timeout_flakes"), (F.count_if(b) - F.count_if(a)).alias("net_delta"), (F.count_if(b | flake) - F.count_if(a)).alias("net_delta_without_flakes"))


def bootstrap_difference(both: DataFrame, base: Column, candidate: Column, iterations: int = 20_000, seed: int = 7) -> DataFrame:
    """The paired bootstrap of the difference in pass rates: one row.

    A resample is a draw of n rows; only how many fall into each of the four
    outcome pairs matters, so rows are counted once and every resample is one
    multinomial draw.  The cost doesn't grow with the rows; resamples are
    drawn in fixed blocks with seeds of their own, on all workers.
    """
    spark = both.sparkSession
    a, b = F.coalesce(base, F.lit(False)), F.coalesce(candidate, F.lit(False))
    c = both.agg(F.count_if(a & b), F.count_if(a & ~b), F.count_if(~a & b), F.count_if(~a & ~b)).first()
    n, block = sum(c), 1000
    if n == 0:
        return spark.createDataFrame([], "rows long, iterations int, low double, high double, not_better double")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in pdf["id"]:
                m = min(block, iterations - int(k) * block)
                got = np.random.default_rng([seed, int(k)]).multinomial(n, np.array(c) / n, size=m)
                yield pd.DataFrame({"diff": (got[:, 2] - got[:, 1]) / n})

    diffs = spark.range(-(-iterations // block)).mapInPandas(draw, "diff double")
    ordered = diffs.agg(F.array_sort(F.collect_list("diff")).alias("d"), F.avg((F.col("diff") <= 0).cast("int")).alias("not_better"))  # ``iterations`` numbers
    low, high = int(0.025 * iterations), min(iterations - 1, int(0.975 * iterations))
    return ordered.select(F.lit(n).cast("long").alias("rows"), F.lit(iterations).alias("iterations"), F.element_at("d", low + 1).alias("low"), F.element_at("d", high + 1).alias("high"), F.bround("not_better", 4).alias("not_better"))


#: Bins of each score in the bootstrap of AUC differences: the cells are bounded whatever the rows.
AUC_BINS = 256


def bootstrap_auc_difference(df: DataFrame, gold: Column, first: Column, second: Column, low: float, high: float, iterations: int = 2000, seed: int = 7) -> DataFrame:
    """The paired bootstrap of AUC(second) - AUC(first): one row.

    Scores are put into AUC_BINS equal bins between ``low`` and ``high``; scores
    of one bin count as tied, so the AUCs are exact to the share of pairs within
    a bin.  Rows are counted by label and both bins once, every resample is one
    multinomial draw over those cells, and resamples of one class are skipped.
    Null and NaN scores take no part.
    """
    spark = df.sparkSession
    place = lambda s: F.least(F.lit(AUC_BINS - 1), F.greatest(F.lit(0), F.floor((s - low) / (high - low) * AUC_BINS))).cast("int")
    ok = first.isNotNull() & second.isNotNull() & ~F.isnan(first) & ~F.isnan(second)
    cells = df.where(ok).groupBy(F.coalesce(gold, F.lit(False)).alias("y"), place(first).alias("a"), place(second).alias("b")).count().collect()  # at most 2 x AUC_BINS^2
    y, a, b, c = (np.array([r[i] for r in cells]) for i in range(4)) if cells else (np.zeros(0),) * 4
    n, block = int(c.sum()), 100
    if not n or len(set(y.tolist())) < 2:
        return spark.createDataFrame([], "rows long, iterations int, low double, high double, not_better double")
    shared = spark.sparkContext.broadcast((y.astype(bool), a.astype(int), b.astype(int), c / n))

    def auc(w: np.ndarray, at: np.ndarray, pos: np.ndarray) -> float:
        p, q = np.bincount(at[pos], w[pos], AUC_BINS), np.bincount(at[~pos], w[~pos], AUC_BINS)
        return float((p * (np.cumsum(q) - q / 2)).sum() / (p.sum() * q.sum()))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pos, x, z, share = shared.value
        for pdf in batches:
            for k in pdf["id"]:
                got = np.random.default_rng([seed, int(k)]).multinomial(n, share, size=min(block, iterations - int(k) * block))
                yield pd.DataFrame({"diff": [auc(w, z, pos) - auc(w, x, pos) for w in got if 0 < w[pos].sum() < n]}, dtype="float64")

    diffs = spark.range(-(-iterations // block)).mapInPandas(draw, "diff double")
    out = diffs.agg(F.count("*").cast("int").alias("iterations"), F.array_sort(F.collect_list("diff")).alias("d"), F.avg((F.col("diff") <= 0).cast("int")).alias("not_better"))
    at = lambda f: F.element_at("d", F.least(F.col("iterations") - 1, F.floor(F.col("iterations") * f).cast("int")) + 1)
    return out.select(F.lit(n).cast("long").alias("rows"), "iterations", at(0.025).alias("low"), at(0.975).alias("high"), F.bround("not_better", 4).alias("not_better"))
