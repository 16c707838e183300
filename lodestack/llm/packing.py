"""Problem 8: filling fixed-capacity containers, by harmonic packing.

A document of more than CAPACITY tokens becomes full pieces and a rest; no other
one is split.  Lengths are put into classes by the reciprocal of the capacity:
class k holds lengths in (CAPACITY/(k+1), CAPACITY/k], of which k fit a container
whatever they are.  Pieces are dealt into stripes by a hash of their key and
number, so the packing is the same however the files lie, and every stripe is
packed on its own: the classes one after the other, from the longest, a fixed
count of k to a container, the remaining space of which is topped up with the
longest pieces of later classes that fit.  Stripes have a bounded number of
rows, also where one key is repeated, so no task grows with the data.

Defined results: a null text counts as empty, which still has its end token;
repeated keys are packed once each row; an empty table packs to nothing.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

CAPACITY = 4096
#: Rows of a stripe, about; every stripe leaves a few containers part-filled.
STRIPE_ROWS = 20_000


def byte_tokens(text: Column) -> Column:
    """Tokens of the public byte-level tokenizer: one per UTF-8 byte and an end token."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def pieces(df: DataFrame, key: str, text: str, capacity: int = CAPACITY) -> DataFrame:
    """(key, copy, piece, pieces, start, tokens): what is packed; all but the last piece of a document are full, and repeated rows are numbered."""
    n = df.select(F.col(key).alias("key"), byte_tokens(F.col(text)).alias("total")).groupBy("key", "total").agg(F.count("*").alias("rows"))
    n = n.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).withColumn("pieces", F.ceil(F.col("total") / capacity).cast("long"))
    whole = n.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    start = F.col("piece") * capacity
    return whole.select("key", "copy", "piece", "pieces", start.alias("start"), F.least(F.lit(capacity), F.col("total") - start).alias("tokens"), "total")


def containers(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The number of each piece's container; lengths are at least 1 and at most ``capacity``."""
    order = np.argsort(lengths, kind="stable")
    sizes = lengths[order].tolist()
    free = list(range(-1, len(sizes)))  # free[i + 1] leads to the longest piece up to place i that isn't packed

    def longest(i: int) -> int:
        root = i + 1
        while free[root] != root - 1:
            root = free[root] + 1
        while free[i + 1] != root - 1:
            free[i + 1], i = root - 1, free[i + 1]
        return root - 1

    out, n, at = np.empty(len(sizes), dtype=np.int64), 0, longest(len(sizes) - 1)
    while at >= 0:
        count, left = capacity // sizes[at], capacity
        low = capacity // (count + 1)  # this class ends here
        while at >= 0 and count and sizes[at] > low:
            out[order[at]] = n
            left -= sizes[at]
            free[at + 1] = at - 1
            at, count = longest(at), count - 1
        while left > 0 and (i := longest(bisect_right(sizes, left) - 1)) >= 0:
            out[order[i]] = n
            left -= sizes[i]
            free[i + 1] = i - 1
        n, at = n + 1, longest(len(sizes) - 1)
    return out


def pack(df: DataFrame, key: str, text: str, capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, pieces, start, tokens, context): each piece's container."""
    stripes = max(1, df.count() // STRIPE_ROWS)
    item = pieces(df, key, text, capacity).withColumn("stripe", F.pmod(F.xxhash64("key", "copy", "piece", "total"), F.lit(stripes)).cast("long"))
    kind = dict(item.dtypes)["key"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "key", "copy", "piece"], na_position="first").reset_index(drop=True)
        n = containers(pdf["tokens"].to_numpy(), capacity)
        names = [f"{s}-{i}" for s, i in zip(pdf["stripe"], n)]
        return pdf.assign(context=names)[["key", "piece", "pieces", "start", "tokens", "context"]]

    return item.groupBy("stripe").applyInPandas(one, f"key {kind}, piece long, pieces long, start long, tokens long, context string")


def split_documents(df: DataFrame, key: str, text: str, capacity: int = CAPACITY) -> DataFrame:
    """(key): documents whose pieces the packing puts into more than one container."""
    packed = pack(df, key, text, capacity)
    return packed.groupBy("key").agg(F.min("context").alias("lo"), F.max("context").alias("hi")).where("lo < hi").select("key")
