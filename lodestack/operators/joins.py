"""Lookups with the meaning that record pipelines give them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


class MissingRows(ValueError):
    """A lookup that must find every row didn't."""


def index(df: DataFrame, key: str, order: list[Column], keep: str = "first") -> DataFrame:
    """One row a key: the first or last in ``order``, by map-side minima or maxima."""
    pick = F.min_by if keep == "first" else F.max_by
    sort = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(pick(F.struct(*df.columns), sort).alias("_r")).select("_r.*")


def lookup(df: DataFrame, other: DataFrame, key: str, prefix: str, other_key: str | None = None) -> DataFrame:
    """A left join; the other side's columns get a prefix, so no names clash, and ``<prefix>found`` says whether it has the key."""
    renamed = other.select(*(F.col(c).alias(prefix + c) for c in other.columns)).withColumn(f"{prefix}found", F.lit(True))
    joined = df.join(renamed, F.col(key) == F.col(prefix + (other_key or key)), "left")
    return joined.withColumn(f"{prefix}found", F.coalesce(f"{prefix}found", F.lit(False)))


def without(df: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """Rows that have none of the keys in common with the other table, one anti-join a key; null keys match nothing."""
    for k in keys:
        df = df.join(other.select(k).distinct(), k, "left_anti")
    return df


def restricted(df: DataFrame, allowed: DataFrame, key: str, expected: int | None = None) -> DataFrame:
    """Rows with an allowed key; raises if their number isn't the expected one."""
    out = df.join(allowed.select(key).distinct(), key, "left_semi")
    if expected is not None and (n := out.count()) != expected:
        raise MissingRows(f"{n} rows, expected {expected}")
    return out


def overridden(df: DataFrame, strong: DataFrame, weak: DataFrame, key: str, label: str) -> DataFrame:
    """``df`` with ``label`` from the strong table where it has one, else from the weak one, and where it comes from."""
    s, w = (x.where(F.col(label).isNotNull()).groupBy(key).agg(F.min(label).alias(n)) for x, n in ((strong, "_s"), (weak, "_w")))
    joined = df.join(s, key, "left").join(w, key, "left")
    return joined.withColumn(label, F.coalesce("_s", "_w")).withColumn(f"{label}_source", F.when(F.col("_s").isNotNull(), "strong").when(F.col("_w").isNotNull(), "weak")).drop("_s", "_w")


def shared_results(df: DataFrame, key: list[str], compute) -> DataFrame:
    """``df`` with the columns that ``compute`` adds to each distinct key, computed once; null keys count as one value."""
    digest = F.sha2(F.to_json(F.struct(*(F.coalesce(F.col(k).cast("string"), F.lit("\0")).alias(f"k{i}") for i, k in enumerate(key)))), 256)
    keyed = df.withColumn("_key", digest)
    once = compute(keyed.select("_key", *key).dropDuplicates(["_key"])).drop(*key)
    return keyed.join(once, "_key").drop("_key")


def union(*tables: DataFrame) -> DataFrame:
    """All rows of tables with different columns; missing ones are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def dealt(rows: DataFrame, key: str, hot: list, spread: Column, parts: int = 16) -> DataFrame:
    """``rows`` with ``_part``: for hot keys one of ``parts`` numbers by the hash of ``spread``, 0 for all others."""
    return rows.withColumn("_part", F.when(F.col(key).isin(hot), F.pmod(F.xxhash64(spread), F.lit(parts)).cast("int")).otherwise(F.lit(0)))


def repeated(lookup: DataFrame, key: str, hot: list, parts: int = 16) -> DataFrame:
    """``lookup`` with ``_part``: rows of hot keys once for each of ``parts`` numbers, all others once."""
    return lookup.withColumn("_part", F.explode(F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))))


def hot_keys(counts: DataFrame, key: str, count: str, total: int, share: float = 1 / 64) -> list:
    """Keys of (key, count) that hold more than ``share`` of the total; fewer than 1 / share."""
    return [r[0] for r in counts.where(F.col(key).isNotNull() & (F.col(count) > share * max(total, 1))).select(key).collect()]


def hot_joined(rows: DataFrame, lookup: DataFrame, key: str, spread: Column, how: str = "left") -> DataFrame:
    """``rows`` joined to ``lookup`` on ``key``, with hot keys dealt over several tasks; null keys meet nothing."""
    hot = hot_keys(rows.groupBy(key).count(), key, "count", rows.count())
    return dealt(rows, key, hot, spread).join(repeated(lookup, key, hot), [key, "_part"], how).drop("_part") if hot else rows.join(lookup, key, how)
