"""Problem 3: text cut off by field limits, by a structural completeness check.

Each answer, to its last part, runs through a stack automaton: unclosed quotes,
brackets, fences and elements, broken escapes and characters, and a last word
that is only the beginning of others show that it breaks off.  Where every
structure is closed but the answer doesn't get to an end (a program without
return or call of its main function, prose without the end of a sentence), the
source decides: of each source the share of answers that have such an end is
counted over all rows, of programs those that were closed explicitly, of prose
all, and where that is usual its absence is a cut.  finish_reason and token
counts take no part.

Defined results: null, blank and placeholder answers are no cut; a source
without such answers counts as one that ends them; repeated rows
count once; rows without key take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lodestack.durable import durable
from lodestack.llm import structure as S

#: From this share of a source's closed answers on, a missing end counts as a cut.
USUAL = 0.9


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for t in pdf["text"]:
            state, closed = S.answer_end(t) if t else ("complete", False)
            kind = S.answer_kind(t) if t else "other"
            ended = None
            if closed and kind == "code":
                ended = S.code_end(S.fenced(t)[0]) == "complete"
            elif kind == "prose":
                ended = state == "complete"
            rows.append((state, kind, ended))
        state, kind, ended = zip(*rows) if rows else ((), (), ())
        yield pd.DataFrame({"key": pdf["key"], "source": pdf["source"], "state": list(state), "kind": list(kind), "terminated": pd.array(list(ended), dtype="boolean")})


def answer_ends(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(key, source, cut) of every row, once a key."""
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(source).cast("string").alias("source"), F.col(text).alias("text")).where("key is not null")
    states = durable(rows.mapInPandas(_ends, "key string, source string, state string, kind string, terminated boolean").dropDuplicates(["key"]), "ends")
    usual = states.where("terminated is not null").groupBy("source", "kind").agg(F.avg(F.col("terminated").cast("int")).alias("share"))
    joined = states.alias("s").join(usual.alias("u"), F.col("s.source").eqNullSafe(F.col("u.source")) & (F.col("s.kind") == F.col("u.kind")), "left")
    cut = (F.col("state") == "open") | ((F.col("state") == "unterminated") & (F.coalesce("share", F.lit(1.0)) >= USUAL))
    return joined.select("key", F.col("s.source").alias("source"), cut.alias("cut"))
