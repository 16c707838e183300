"""Ranking, deduplication and capped selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestack.durable import durable
from lodestack.functions import hashing
from lodestack.operators.ordered import ranked


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows of each group.  The planner keeps only ``k`` rows a group before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def keep_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in ``order``, with map-side minima instead of a sort of whole groups."""
    sort = F.struct(*(F.struct(c.isNull().alias("n"), c.alias("v")).alias(f"o{i}") for i, c in enumerate(order)))
    best = df.groupBy(*key).agg(F.min_by(F.struct(*df.columns), sort).alias("_row"))
    return best.select("_row.*")


def proportion_split(df: DataFrame, key: str, salt: str, shares: dict[str, float]) -> DataFrame:
    """(key, split): distinct keys in salted order, cut at the rounded shares of their number; the last split takes the rest."""
    keys = df.select(F.col(key).alias("key")).where("key is not null").distinct()
    n = keys.count()
    placed = ranked(keys.withColumn("order", hashing.salted_order(F.col("key"), salt)), ["order", "key"])
    names = list(shares)
    split, end = F.lit(names[-1]), 0
    bounds = []
    for k in names[:-1]:
        end += round(n * shares[k])
        bounds.append((k, end))
    for k, e in reversed(bounds):
        split = F.when(F.col("rank") < e, k).otherwise(split)
    return placed.select("key", split.alias("split"))


def round_robin(df: DataFrame, bucket: str, order: list[Column], total: int) -> DataFrame:
    """``df`` with ``position``: one row of each bucket in turn, buckets by name, rows by ``order``, the first ``total``."""
    placed = df.withColumn("turn", F.row_number().over(Window.partitionBy(bucket).orderBy(*order)))
    return placed.where(F.col("turn") <= total).orderBy("turn", bucket).limit(total)


def greedy_capped(df: DataFrame, order: list[str], caps: dict[str, int]) -> DataFrame:
    """Rows of a greedy run in ``order`` that takes a row unless one of its keys is full; exact, in rounds.

    In each round a row is taken for sure if it fits even when every undecided
    row before it in its groups is taken, and refused once a group is full.
    The first undecided row is always decided, so the rounds end.  Only the
    first rows of each group up to its cap can be taken for sure; no more are
    ranked, whatever a group's size.  ``order`` must name columns that tell all
    rows apart; rows with a null key are refused.
    """
    keys = list(caps)
    left = durable(df.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))), "undecided")
    taken: list[DataFrame] = []
    used: dict[str, DataFrame] = {}
    while not left.isEmpty():
        now = left
        for k in keys:
            place = F.row_number().over(Window.partitionBy(k).orderBy(*order))
            first = left.select(k, *[c for c in order if c != k]).withColumn("_place", place).where(F.col("_place") <= caps[k])
            if k in used:
                first = first.join(used[k], k, "left").where(F.col("_place") + F.coalesce("_c", F.lit(0)) <= caps[k]).drop("_c")
            now = now.join(first.select(*order), order, "left_semi")
        now = durable(now, "taken")
        taken.append(now)
        rest = left.join(now.select(*order), order, "left_anti")
        for k in keys:
            count = now.groupBy(k).agg(F.count("*").alias("_c"))
            if k in used:
                count = used[k].unionAll(count).groupBy(k).agg(F.sum("_c").alias("_c"))
            used[k] = durable(count, "used")
            rest = rest.join(used[k].where(F.col("_c") >= caps[k]).select(k), k, "left_anti")
        left = durable(rest.select(*df.columns), "undecided")
    return reduce(DataFrame.unionAll, taken) if taken else df.limit(0)


def most_common(df: DataFrame, value: str, n: int) -> DataFrame:
    """The ``n`` most frequent values; ties by value."""
    return df.groupBy(value).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), value).limit(n)


def diverse_examples(df: DataFrame, group: str, pattern: str, key: str, n: int) -> DataFrame:
    """``n`` examples of each group: first one of each pattern, most frequent patterns first, then further ones."""
    counts = df.groupBy(group, pattern).agg(F.count("*").alias("_freq"))
    nth = F.row_number().over(Window.partitionBy(group, pattern).orderBy(key))
    # more than n rows of one pattern can't be chosen
    few = df.withColumn("_nth", nth).where(F.col("_nth") <= n).join(counts.withColumnsRenamed({group: "_g", pattern: "_p"}), F.col(group).eqNullSafe(F.col("_g")) & F.col(pattern).eqNullSafe(F.col("_p"))).drop("_g", "_p")
    place = F.row_number().over(Window.partitionBy(group).orderBy("_nth", F.desc("_freq"), F.col(pattern).asc_nulls_first(), key))
    return few.withColumn("place", place).where(F.col("place") <= n).drop("_nth", "_freq")


def stratified(df: DataFrame, stratum: str, key: str, salt: str, n: int) -> DataFrame:
    """``n`` rows of each stratum in salted order."""
    return top_k(df.withColumn("_o", hashing.salted_order(F.col(key), salt)), [stratum], [F.col("_o"), F.col(key)], n).drop("_o")


def margin_pairs(df: DataFrame, group: str, key: str, score: str, least: float) -> DataFrame:
    """(group, low_key, high_key, margin): each group's lowest and highest score, if they differ by ``least``; ties by key."""
    ends = df.where(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(group).agg(
        F.min(F.struct(F.col(score).alias("s"), F.col(key).alias("k"))).alias("low"), F.min(F.struct((-F.col(score)).alias("s"), F.col(key).alias("k"))).alias("high")
    )
    return ends.select(group, F.col("low.k").alias("low_key"), F.col("high.k").alias("high_key"), (-F.col("high.s") - F.col("low.s")).alias("margin")).where(F.col("margin") >= least)
