"""Hot keys: one key with a third or more of all rows mustn't change results."""

import random

from pyspark.sql import functions as F

from lodestack.operators import contrast, gates as G, metrics as M, ordered, selection as S


def _hot(rng, n):
    return [("hot" if rng.random() < 0.5 else f"k{rng.randrange(50)}", i, rng.random() < 0.3) for i in range(n)]


def test_hot_key_in_gates_and_caps(spark):
    rows = _hot(random.Random(1), 3000)
    df = spark.createDataFrame(rows, "k string, i int, ok boolean")
    out = G.gate_chain(df, [], [("bad", ~F.col("ok"))], "k", [F.col("i")], 3, "cap")
    taken = out.where("reason is null").groupBy("k").count().collect()
    assert max(r["count"] for r in taken) <= 3
    first = {}
    for k, i, ok in rows:
        if ok and len(first.setdefault(k, [])) < 3:
            first[k].append(i)
    assert {r.i for r in out.where("reason is null").collect()} == {i for v in first.values() for i in v}
    assert S.greedy_capped(df, ["i"], {"k": 2}).count() == 2 * len({k for k, _, _ in rows})


def test_hot_key_in_pairs_and_metrics(spark):
    rows = [(k, f"r{i:05d}", 10 + i % 7, ok) for k, i, ok in _hot(random.Random(2), 3000)]
    df = spark.createDataFrame(rows, "t string, r string, n int, ok boolean")
    pairs = contrast.first_compatible(df, "t", "r", "n", "ok")
    assert pairs.count() == sum(ok for *_, ok in rows if True) - sum(ok for t, _, _, ok in rows if not any(t2 == t and not o2 for t2, _, _, o2 in rows))
    assert M.task_metrics(df, "t", F.col("ok")).first().responses == 3000
    assert ordered.nearest_rank(df, "n", ["t"]).count() == len({t for t, *_ in rows})


def test_order_is_total_across_partitions(spark):
    df = spark.range(5000).select((F.pmod(F.xxhash64("id"), F.lit(97))).alias("v"), "id")
    got = [r.id for r in ordered.ranked(df, ["v", "id"]).orderBy("rank").collect()]
    assert got == [r.id for r in df.orderBy("v", "id").collect()]
