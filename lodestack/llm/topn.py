"""Problem 2: the N best rows of every group, by simultaneous per-group bisection.

Every row has an order-preserving code: its score, then its identifier.  In
each pass every open group's interval is cut into PARTS equal parts, the rows
of each part are counted (with map-side partial counts), the parts that fit
into what the group still needs are accepted, the part that doesn't fit becomes
the next interval, and the rest leaves.  Once a part holds one score only, the
code goes on with the next bytes of the identifiers, behind the prefix that the
part's identifiers share.  No group is ever sorted or gathered, whatever its
size, and the rows left shrink with every pass.  Rows meet the state of their
group by shuffles, never by broadcasts, and groups of a great share of all rows
are dealt over several tasks.

Defined results: rows whose group, score or identifier is null, or whose score
is NaN, take no part; a group of fewer than N rows is kept whole; equal scores
go by identifier, smaller first by code point; 0.0 equals -0.0; repeated rows
of one identifier must be removed before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestack.durable import durable
from lodestack.operators.joins import dealt, hot_keys, repeated

PARTS = 64
_BYTES = 6


def _id_code(key: Column, skip: Column) -> Column:
    """The bytes of ``key`` behind the first ``skip`` as a number below 2**52: six bytes, then how many of them there are."""
    part = F.substring(F.encode(key, "utf-8"), skip + 1, F.lit(_BYTES))
    return F.conv(F.rpad(F.hex(part), 2 * _BYTES, "0"), 16, 10).cast("long").cast("double") * 8 + F.octet_length(part)


def _shared_bytes(a: Column, b: Column) -> Column:
    """Length in bytes of the longest common prefix of two different strings."""
    x, y = F.hex(F.encode(a, "utf-8")), F.hex(F.encode(b, "utf-8"))
    n = F.least(F.octet_length(a), F.octet_length(b))
    differ = F.transform(F.sequence(F.lit(1), n + 1), lambda i: (i > n) | (F.substring(x, i * 2 - 1, F.lit(2)) != F.substring(y, i * 2 - 1, F.lit(2))))
    return (F.array_position(differ, True) - 1).cast("int")


def top_n(df: DataFrame, group: str, key: str, score: str, n: int = 3) -> DataFrame:
    """(grp, key, score): the ``n`` rows of each group with the highest score."""
    rows = df.select(F.col(group).alias("grp"), F.col(key).cast("string").alias("key"), F.col(score).cast("double").alias("score"))
    rows = rows.where(F.col("grp").isNotNull() & F.col("key").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    limit = F.lit(1.7e308)
    rows = durable(rows.withColumn("code", F.greatest(F.least(-F.col("score"), limit), -limit) + F.lit(0.0)), "scores")
    state = rows.groupBy("grp").agg(F.count("*").alias("c"), F.min("code").alias("lo"), F.max("code").alias("hi"), F.min("key").alias("klo"), F.max("key").alias("khi"))
    state = durable(_aim(state.withColumn("need", F.lit(n)), F.lit(-1)), "groups")
    # groups of a great share of all rows are dealt over several tasks wherever rows meet their group's state
    hot = hot_keys(state, "grp", "c", rows.count())
    rows = dealt(rows, "grp", hot, F.col("key")).withColumn("skip", F.lit(-1))

    def of(side: DataFrame) -> DataFrame:  # it grows with the groups, so it is never sent to all
        return repeated(side, "grp", hot).hint("merge")

    done: list[DataFrame] = []
    while True:
        whole = state.where("c <= need").select("grp")
        open_ = state.where("c > need")
        done.append(rows.join(of(whole), ["grp", "_part"], "left_semi").select("grp", "key", "score"))
        if open_.isEmpty():
            break
        span = F.col("hi") / PARTS - F.col("lo") / PARTS
        part = F.least(F.lit(PARTS - 1), F.floor((F.col("code") - F.col("lo")) / span)).cast("int")
        rows = (
            rows.drop("skip").join(of(open_.select("grp", "lo", "hi", "skip")), ["grp", "_part"])
            .withColumn("code", F.when(F.col("skip") >= 0, _id_code(F.col("key"), F.col("skip"))).otherwise(F.col("code")))
            .withColumn("part", part).drop("lo", "hi")
        )
        counts = rows.groupBy("grp", "part").agg(F.count("*").alias("c"), F.min("code").alias("lo"), F.max("code").alias("hi"), F.min("key").alias("klo"), F.max("key").alias("khi"))
        before = F.coalesce(F.sum("c").over(Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        parts = counts.join(open_.select("grp", "need", "skip").hint("merge"), "grp").withColumn("before", before).where("before < need")
        parts = durable(_aim(parts.withColumn("need", (F.col("need") - F.col("before")).cast("int")), F.col("skip")), "parts")
        rows = durable(rows.join(of(parts.select("grp", "part", "c", "need")), ["grp", "_part", "part"]).drop("part"), "left")
        done.append(rows.where("c <= need").select("grp", "key", "score"))
        rows = rows.where("c > need").drop("c", "need")
        state = parts.where("c > need").drop("part", "before")
        if state.isEmpty():
            break
    return reduce(DataFrame.unionAll, done)


def _aim(state: DataFrame, skip: Column) -> DataFrame:
    """The next interval of each group: of the same code where it still has two values, else of the identifiers' next bytes."""
    flat = F.col("lo") >= F.col("hi")
    next_ = F.when(F.col("klo") < F.col("khi"), _shared_bytes(F.col("klo"), F.col("khi"))).otherwise(F.lit(0))
    state = state.withColumn("skip", F.when(flat, next_).otherwise(skip).cast("int")).withColumn("flat", flat)
    return (
        state.withColumn("lo", F.when(F.col("flat"), _id_code(F.col("klo"), F.col("skip"))).otherwise(F.col("lo")))
        .withColumn("hi", F.when(F.col("flat"), _id_code(F.col("khi"), F.col("skip"))).otherwise(F.col("hi")))
        .drop("flat", "klo", "khi")
    )


def latest_scores(judgments: DataFrame) -> DataFrame:
    """(response_id, overall_score) of each response's row with the latest judged_at; of rows with the same time the higher score."""
    last = F.max(F.struct("judged_at", "overall_score")).alias("last")
    return judgments.where(F.col("response_id").isNotNull()).groupBy("response_id").agg(last).select("response_id", "last.overall_score")
