"""Preference pairs inside a task: a passing answer over a failing one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from lodestack.durable import durable

#: Rejects that are tried one by one before the few answers left meet all of theirs.
ROUNDS = 4


def first_compatible(rows: DataFrame, task: str, key: str, length: str, passed: str, ratio: float = 8.0) -> DataFrame:
    """(task, chosen, rejected): each passing answer with the task's first failing one whose length is within ``ratio``.

    Pairs of a task are never all formed: every round joins the answers still
    without a partner to one more reject of their task, by its place, and most
    find theirs in the first.  What is left after ROUNDS looks only at rejects
    whose lengths fall into neighbouring powers of ``ratio``.
    Null tasks, keys and lengths take no part; a null outcome is a failure.
    """
    r = rows.where(F.col(task).isNotNull() & F.col(key).isNotNull() & F.col(length).isNotNull()).select(F.col(task).alias("t"), F.col(key).alias("k"), F.greatest(F.lit(1), F.col(length)).alias("n"), F.coalesce(passed, F.lit(False)).alias("ok"))
    r = durable(r, "answers")
    bad = r.where("not ok").select("t", F.col("k").alias("rk"), F.col("n").alias("rn"))
    # only the first of each task are ranked
    tried = durable(bad.withColumn("place", F.row_number().over(Window.partitionBy("t").orderBy("rk"))).where(F.col("place") <= ROUNDS), "rejects")
    fits = F.greatest("n", "rn") <= F.least("n", "rn") * ratio
    left, done = r.where("ok").select("t", "k", "n"), []
    for i in range(1, ROUNDS + 1):
        met = durable(left.join(tried.where(F.col("place") == i).drop("place"), "t").withColumn("fits", fits), "round")
        done.append(met.where("fits").select("t", "k", "rk"))
        left = met.where("not fits").select("t", "k", "n")
        if left.isEmpty():
            break
    else:
        power = lambda c: F.floor(F.log(float(ratio), c) + 1e-9)
        near = left.withColumn("p", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda x: x + power(F.col("n")))))
        late = bad.withColumn("p", power(F.col("rn")))
        done.append(near.join(late, ["t", "p"]).where(fits).groupBy("t", "k").agg(F.min("rk").alias("rk")))
    return reduce(DataFrame.unionAll, done).select(F.col("t").alias(task), F.col("k").alias("chosen"), F.col("rk").alias("rejected"))
