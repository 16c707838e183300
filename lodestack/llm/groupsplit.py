"""Problem 5: splits that keep related records together.

Distributed union-find: every partition joins its own relations in a local
forest and hands on only the forest's edges; forests are merged level by level,
a few partitions into one, while the edges fit MERGE_ROWS a task.  Should more
edges remain, large-star/small-star rounds contract them first, so no task ever
holds more than its share; the components are the same either way.  Groups are then given to the splits largest first, each
to the split furthest below its target; groups of equal size are interchangeable,
so the greedy run needs only the number of groups of each size, of which there
are at most sqrt(2 x records).

Defined results: a record that names no key forms a group of its own; null
keys relate nothing; repeated rows count once; without records both results
are empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestack.durable import durable

MERGE_ROWS, FAN_IN = 1_000_000, 8


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict = {}

    def find(x):
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for pdf in batches:
        for a, b in zip(pdf["a"], pdf["b"]):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if find(x) != x]
    for k in range(0, len(nodes), 50_000):
        part = nodes[k : k + 50_000]
        yield pd.DataFrame({"a": part, "b": [find(x) for x in part]})


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node linked to the node's smallest neighbour; with map-side minima."""
    both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    return down.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionAll(low.select("a", F.col("low").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge, from edges (a, b) of strings; ``root`` is the component's smallest node."""
    schema = "a string, b string"
    e = durable(edges.select(F.col("a").cast("string"), F.col("b").cast("string")).where("a <> b").mapInPandas(_forest, schema), "forest")
    n = e.count()
    while n > MERGE_ROWS:  # contract until one merge fits a task
        star = durable(_small_star(_large_star(e)), "stars")
        m = star.count()
        if m == n and star.exceptAll(e).isEmpty():
            return _rooted(star)
        e, n = star, m
    parts = e.rdd.getNumPartitions()
    while parts > 1:
        parts = max(1, parts // FAN_IN)
        e = durable(e.coalesce(parts).mapInPandas(_forest, schema), "forest")
    return _rooted(e)


def _rooted(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def related(df: DataFrame, record: str, keys: Column) -> DataFrame:
    """(record, root): each record's group, as the smallest key of its component; records share a group if they name one key, and relations chain.

    ``keys`` is an array of strings per row.  Rows that name nothing get the root ``record:<id>``.
    """
    rec = F.col(record).cast("string").alias("record")
    named = durable(df.select(rec, F.array_sort(F.array_distinct(F.filter(keys, lambda k: k.isNotNull()))).alias("names")).where("record is not null").distinct(), "names")
    first = named.groupBy("record").agg(F.min(F.try_element_at("names", F.lit(1))).alias("first"))
    # every key of a record is linked to the record's smallest one
    links = named.join(first, "record").select(F.explode("names").alias("a"), F.col("first").alias("b")).where("a <> b").distinct()
    roots = components(links)
    first = first.withColumn("first", F.coalesce("first", F.concat(F.lit("record:"), "record")))
    return first.join(roots, first["first"] == roots["node"], "left").select("record", F.coalesce("root", "first").alias("root"))


def plan_splits(sizes: list[tuple[int, int]], shares: dict[str, float]) -> dict[int, list[tuple[str, int]]]:
    """From (group size, number of such groups), largest first, how many groups of each size each split takes, in order.

    A split that lacks L takes groups of size s at lacks of L, L - s, L - 2 s and
    so on, and the greedy run serves the highest lacks first.  So all above a
    common level are served at once, and only the last few one by one.
    """
    total = sum(s * c for s, c in sizes)
    lack = {k: v * total for k, v in shares.items()}
    out: dict[int, list[tuple[str, int]]] = {}
    for size, count in sorted(sizes, reverse=True):
        above = lambda level: {k: max(0, math.floor((v - level) / size)) for k, v in lack.items()}  # noqa: E731, B023
        low, high = min(lack.values()) - size * (count + 1), max(lack.values())
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (low, mid) if sum(above(mid).values()) <= count else (mid, high)
        taken = above(high)
        for k in lack:
            lack[k] -= taken[k] * size
        for _ in range(count - sum(taken.values())):
            k = max(lack, key=lambda x: lack[x])
            taken[k] += 1
            lack[k] -= size
        out[size] = [(k, c) for k, c in taken.items() if c]
    return out


def assign_splits(groups: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(record, root, split) from (record, root): whole groups, by greedy largest-first assignment."""
    spark = groups.sparkSession
    sized = durable(groups.groupBy("root").agg(F.count("*").alias("size")).withColumn("slot", F.pmod(F.xxhash64("root"), F.lit(4096))), "sizes")
    counts = sized.groupBy("size").count().collect()  # at most sqrt(2 x records) rows
    plan = plan_splits([(r[0], r[1]) for r in counts], shares)
    bounds = [(size, split, sum(c for _, c in take[:i]), sum(c for _, c in take[: i + 1])) for size, take in plan.items() for i, (split, _) in enumerate(take)]
    ranges = spark.createDataFrame(bounds, "size long, split string, low long, high long")
    slots = sized.groupBy("size", "slot").count()
    start = F.sum("count").over(Window.partitionBy("size").orderBy("slot")) - F.col("count")
    ranked = sized.join(slots.select("size", "slot", start.alias("start")), ["size", "slot"]).withColumn("rank", F.col("start") + F.row_number().over(Window.partitionBy("size", "slot").orderBy("root")) - 1)
    placed = ranked.join(ranges, "size").where("rank >= low and rank < high").select("root", "split")
    return groups.join(placed, "root").select("record", "root", "split")


def base_problem(name: Column) -> Column:
    """The base problem that an identifier names, in one spelling, or null: ``APPS-Train-007__sample2`` is ``apps/train/7``."""
    stem = F.regexp_replace(F.split(F.lower(F.trim(name)), "__")[0], r"[-/\s]+", "/")
    stem = F.regexp_replace(stem, r"(^|/)0+(?=\d)", "$1")
    return F.when(stem.rlike(r"^(?!mix/)[a-z].*/\d+$"), stem)


def sft_groups(sft: DataFrame) -> DataFrame:
    """(record, root) of sft_records."""
    keys = F.array(*(base_problem(F.col(c)) for c in ("id", "problem_id", "metadata.original_response_id", "metadata.chosen_response_id")))
    return related(sft, "id", keys)


def torn_groups(sft: DataFrame) -> DataFrame:
    """(id, group_id): all records of groups whose present eval_splits differ, ignoring case, outer blanks and nulls."""
    of = durable(sft_groups(sft), "groups")
    split = F.nullif(F.lower(F.trim("eval_split")), F.lit(""))
    have = sft.select(F.col("id").alias("record"), split.alias("split")).where("record is not null").join(of, "record")
    torn = have.groupBy("root").agg(F.min("record").alias("group_id"), F.min("split").alias("lo"), F.max("split").alias("hi")).where("lo <> hi").select("root", "group_id")
    return of.join(torn, "root").select(F.col("record").alias("id"), "group_id")
