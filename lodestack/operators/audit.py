"""Constraints on tables: each check is a one-row frame, and ``enforce`` raises on what doesn't hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


class AuditError(AssertionError):
    """A table breaks a contract."""


def _row(df: DataFrame, name: str, bad: Column) -> DataFrame:
    return df.agg(F.lit(name).alias("check"), F.coalesce(bad, F.lit(0)).cast("long").alias("violations"))


def unique(df: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first of each key."""
    return _row(df.groupBy(key).agg(F.count("*").alias("n")), f"unique {key}", F.sum(F.col("n") - 1))


def filled(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key is null or blank."""
    return _row(df, f"filled {key}", F.count_if(F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "")))


def disjoint(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that both tables have."""
    return _row(a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi"), f"disjoint {key}", F.count("*"))


def contained(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of ``a`` that ``b`` lacks."""
    return _row(a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti"), f"contained {key}", F.count("*"))


def row_counts(df: DataFrame, column: str, expected: dict[str, int]) -> DataFrame:
    """How far the rows of each value are from the number agreed; values not named count fully."""
    want = F.lit(0)
    for k, n in expected.items():
        want = F.when(F.col(column) == k, n).otherwise(want)
    got = df.groupBy(column).agg(F.count("*").alias("n"))
    missing = F.lit(sum(expected.values())) - F.coalesce(F.sum(F.when(F.col(column).isin(list(expected)), want)), F.lit(0))
    return _row(got, f"row counts {column}", F.coalesce(F.sum(F.abs(F.col("n") - want)), F.lit(0)) + missing)


def constant(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns with more than one value, null being one."""
    each = [F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))) > 1 for c in columns]
    return _row(df, "constant", reduce(lambda a, b: a + b, (F.coalesce(e, F.lit(False)).cast("int") for e in each)))


def column_free(df: DataFrame, private: set[str]) -> DataFrame:
    """Columns that mustn't leave, by the schema alone."""
    leaked = len(private & set(df.columns))
    return df.sparkSession.createDataFrame([("private columns", leaked)], "check string, violations long")


def fences(df: DataFrame, column: str, expected: int) -> DataFrame:
    """Rows whose number of fences differs from ``expected``."""
    return _row(df, f"fences {column}", F.count_if(F.regexp_count(F.coalesce(F.col(column), F.lit("")), F.lit("```")) != expected))


def report(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, checks).withColumn("ok", F.col("violations") == 0)


def enforce(checks: list[DataFrame]) -> None:
    """Raise with the names of the checks that don't hold."""
    bad = report(checks).where("not ok").collect()  # one row a check
    if bad:
        raise AuditError("; ".join(f"{r['check']}: {r['violations']}" for r in bad))


def gates(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """A one-row table's go/no-go map and whether all hold; a null condition doesn't."""
    held = {k: F.coalesce(c, F.lit(False)) for k, c in conditions.items()}
    return df.select(F.create_map(*(x for k, c in held.items() for x in (F.lit(k), c))).alias("gates"), reduce(lambda a, b: a & b, held.values()).alias("go"))
