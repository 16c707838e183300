"""Ordered gates with the reason of the first reject, and caps on accepted rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestack.durable import durable
from lodestack.operators.joins import hot_joined


def first_reason(gates: list[tuple[str, Column]]) -> Column:
    """The name of the first gate that rejects a row (a null condition rejects nothing); null if none does."""
    out = F.lit(None).cast("string")
    for name, rejects in reversed(gates):
        out = F.when(F.coalesce(rejects, F.lit(False)), name).otherwise(out)
    return out


def gate_chain(df: DataFrame, early: list[tuple[str, Column]], late: list[tuple[str, Column]], cap_by: str, order: list[Column], cap: int, cap_reason: str, keep: list[str] | None = None) -> DataFrame:
    """``df``, or its columns ``keep``, with ``reason``: null for accepted rows, of which each ``cap_by`` has ``cap`` at most.

    The cap is tested between the early and the late gates, against the rows
    accepted before in ``order``, which must be total within a key: once it is
    reached, later rows that the early gates let through get ``cap_reason``,
    whatever the late gates would say.  What the gates say is written once,
    without the texts they read.  Only the first ``cap`` passing rows of each
    key are ranked (Spark keeps no more before the shuffle), and their last
    one's place in the order decides for the others, so a hot key is neither
    sorted nor joined in one task.  Null keys form one group.
    """
    keep = keep or df.columns
    place = F.struct(*(F.struct(c.isNotNull().alias("n"), c.alias("v")).alias(f"o{i}") for i, c in enumerate(order)))
    key = F.coalesce(F.concat(F.lit("="), F.col(cap_by).cast("string")), F.lit("null"))
    marked = durable(df.select(*keep, first_reason(early).alias("_early"), first_reason(late).alias("_late"), place.alias("_o"), key.alias("_k")), "gates")
    passing = marked.where(F.col("_early").isNull() & F.col("_late").isNull()).select("_k", "_o")
    first = passing.withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy("_o"))).where(F.col("_r") <= cap)
    last = first.groupBy("_k").agg(F.count("*").alias("_n"), F.max("_o").alias("_last")).where(F.col("_n") >= cap).drop("_n")
    joined = hot_joined(marked, last, "_k", F.to_json("_o"))
    full = F.coalesce(F.col("_o") > F.col("_last"), F.lit(False))
    reason = F.coalesce(F.col("_early"), F.when(full, cap_reason), F.col("_late"))
    return joined.select(*keep, reason.alias("reason"))


def reason_counts(df: DataFrame, accepted: str = "accepted") -> DataFrame:
    return df.groupBy(F.coalesce("reason", F.lit(accepted)).alias("reason")).agg(F.count("*").alias("rows"))
