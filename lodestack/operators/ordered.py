"""Global order without a global task: cumulative sums, ranks and quantiles over range partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestack.durable import durable


def cumulative(df: DataFrame, order: list[str | Column], **sums: Column) -> DataFrame:
    """``df`` with, for each name, ``before_<name>``: the sum over all rows earlier in ``order``.

    Rows are range-partitioned by the order, every partition adds up on its
    own, and one total a partition goes through the driver; rows equal in the
    order must be made distinct by a key in it.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = durable(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ordered")
    totals = sorted(parts.groupBy("_part").agg(*(F.sum(c).alias(k) for k, c in sums.items())).collect())
    start, offsets = [0] * len(sums), []
    for row in totals:  # one row a partition
        offsets.append((row[0], *map(float, start)))
        start = [a + (b or 0) for a, b in zip(start, row[1:])]
    at = df.sparkSession.createDataFrame(offsets, ", ".join(["_part int", *(f"_start_{k} double" for k in sums)]))
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = parts.join(F.broadcast(at), "_part")  # as many rows as shuffle partitions
    for k, c in sums.items():
        joined = joined.withColumn(f"before_{k}", (F.coalesce(F.sum(c).over(w), F.lit(0)) + F.col(f"_start_{k}")))
    return joined.drop("_part", *(f"_start_{k}" for k in sums))


def ranked(df: DataFrame, order: list[str | Column], name: str = "rank") -> DataFrame:
    """``df`` with its 0-based place in a total order."""
    return cumulative(df, order, rows=F.lit(1)).withColumn(name, F.col("before_rows").cast("long")).drop("before_rows")


#: The shares of the rows whose values a summary reports.
QUANTILES = {"p50": 0.50, "p95": 0.95}


def nearest_rank(df: DataFrame, value: str, groups: list[str] | None = None, quantiles: dict[str, float] = QUANTILES) -> DataFrame:
    """min, mean, max and nearest-rank quantiles (index round((n-1)f), half-even) of a group's values; nulls don't count.

    Values are counted first, so a group costs its distinct values, in any number of partitions.
    """
    groups = groups or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    total = counts.groupBy(*groups).agg(F.sum("_n").alias("n"), F.min("_v").alias("min"), (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("mean"), F.max("_v").alias("max"))
    placed = cumulative(counts, [*groups, "_v"], n=F.col("_n"))
    if groups:
        first = placed.groupBy(*groups).agg(F.min("before_n").alias("_first"))
        placed = _null_safe(placed, first, groups)
        joined = _null_safe(placed, total, groups)
    else:
        joined = placed.withColumn("_first", F.lit(0.0)).crossJoin(F.broadcast(total))  # one row
    low = F.col("before_n") - F.col("_first")
    picks = [F.max(F.when((F.bround((F.col("n") - 1) * f) >= low) & (F.bround((F.col("n") - 1) * f) < low + F.col("_n")), F.col("_v"))).alias(k) for k, f in quantiles.items()]
    return joined.groupBy(*groups).agg(*(F.first(c).alias(c) for c in ("n", "min", "mean")), *picks, F.first("max").alias("max"))


def _null_safe(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join in which null keys meet."""
    b = b.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return a.join(b, cond).drop(*(f"_k_{k}" for k in keys))
