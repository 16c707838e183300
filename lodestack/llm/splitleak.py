"""Problem 4: the same or near-same records across splits, by a prefix join on runs of words.

Two texts agree to the threshold t only if they share t of the distinct runs of
WIDTH words that either has.  All runs have one order, by the number of pairs
of texts that their bucket of runs would bring together (BUCKETS counters a
side, whatever the data): runs that one side lacks come first.  Of
a text's n runs the first n - ceil(t n) + 1 are kept, and two texts that agree
have a kept run in common, wherever their words are changed, moved, added or
dropped and however short they are.  Bitmaps of their runs bound from above what
two texts can have in common and drop most candidates.  Candidates are verified
by the exact agreement of word runs, as defined for the result.  Links get their
edit distance by a banded dynamic programme over words: the band is the share of
the longer text that the threshold leaves open, and links beyond it, whose
sentences were moved, have none.

Defined results: texts without WIDTH words match nothing; equal texts are
joined once and expanded to their rows in the end; repeated rows count once;
rows without key take no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestack.durable import durable
from lodestack.llm import grams as G

WIDTH = 3
#: Bits of a text's bitmap of runs; counters of the runs' order.
BITS, BUCKETS = 512, 1 << 20
#: Lines of the prompt templates around a task; {} stands for anything.
TEMPLATE_LINES = (
    r"You are an expert Python developer\. Work through the problem below\.",
    r"Reply with plain Python source only; leave out fences and commentary\.",
    r"Task:",
    r"Python code:",
    r"Read standard input, write standard output\.",
    r"The evaluator calls:",
    r'"""',
    r"# complete program",
    r"# implement \w+",
    r"### Problem",
    r"### Solution in Python 3(?: \(define \w+\))?",
)
_TEMPLATE = re.compile("(?im)^[ \t]*(?:" + "|".join(TEMPLATE_LINES) + ")[ \t]*\r?$")
_CALLS = re.compile(r"(?im)^[ \t]*The evaluator calls:[ \t]*\r?\n[ \t]*\w+(?:[ \t]*,[ \t]*\w+)*[ \t]*\r?$")


def task_text(prompt: str | None) -> str:
    """A prompt without the template lines around its task."""
    return _TEMPLATE.sub("", _CALLS.sub("", prompt)) if prompt else ""


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ids, counts = G.token_ids([task_text(t).lower() for t in pdf["text"]], G.WORD)
        parts = np.split(ids.view(np.int64), np.cumsum(counts)[:-1]) if len(pdf) else []
        at = np.concatenate([np.arange(c) for c in counts]) if len(pdf) else np.zeros(0)
        h = G.mix(ids * (np.uint64(2) * at.astype(np.uint64) + np.uint64(1)))
        total = np.concatenate([[np.uint64(0)], np.cumsum(h, dtype=np.uint64)])
        ends = np.cumsum(counts)
        hashes = G.mix(total[ends] - total[ends - counts] + counts.astype(np.uint64)).view(np.int64)
        runs, own, _ = G.grams(ids, counts, WIDTH)
        key = np.unique((own.astype(np.uint64) << np.uint64(44)) | (runs >> np.uint64(20)))
        own, bit = (key >> np.uint64(44)).astype(np.int64), (key % np.uint64(BITS)).astype(np.int64)
        maps = np.zeros((len(pdf), BITS // 64), dtype=np.uint64)
        np.bitwise_or.at(maps, (own, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
        n = np.bincount(own, minlength=len(pdf))
        flat = (key & np.uint64((1 << 44) - 1)).view(np.int64)
        yield pd.DataFrame({"key": pdf["key"], "text_id": hashes, "words": parts, "runs": np.split(flat, np.cumsum(n)[:-1]) if len(pdf) else [], "bits": list(maps.view(np.int64))})


def banded_distances(texts: list[tuple[np.ndarray, np.ndarray]], bands: np.ndarray) -> np.ndarray:
    """Edit distances of pairs of word sequences within each pair's band of the diagonal, a row of all pairs at a time; band + 1 if it is more."""
    n, m = np.array([len(a) for a, _ in texts]), np.array([len(b) for _, b in texts])
    a, b = np.zeros((len(texts), n.max()), dtype=np.int64), np.full((len(texts), m.max()), -1, dtype=np.int64)
    for i, (x, y) in enumerate(texts):
        a[i, : len(x)], b[i, : len(y)] = x, y
    big = np.int32(n.max() + m.max() + 1)
    columns = np.arange(m.max() + 1, dtype=np.int32)
    row = np.where(columns <= bands[:, None], columns, big).astype(np.int32)
    out = np.where(n == 0, m, big)
    for i in range(1, n.max() + 1):
        new = np.empty_like(row)
        new[:, 0] = i
        np.minimum(row[:, 1:] + 1, row[:, :-1] + (b != a[:, i - 1, None]), out=new[:, 1:])
        off = np.abs(columns - i) > bands[:, None]
        new[off] = big
        # insertions: the running minimum of new[j] - j, plus j
        row = np.minimum(np.minimum.accumulate(new - columns, axis=1) + columns, big)
        row[off] = big
        done = n == i
        out[done] = row[done, m[done]]
    return np.minimum(out, bands + 1)


def agreement(a: np.ndarray, b: np.ndarray, width: int = WIDTH) -> float:
    """Distinct runs of ``width`` words that both have, divided by those that either has."""
    x, y = (np.unique(G.grams(w.view(np.uint64), np.array([len(w)]), width)[0]) for w in (a, b))
    common = len(np.intersect1d(x, y, assume_unique=True))
    either = len(x) + len(y) - common
    return common / either if either else 0.0


def _verify(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for e, t, a, b in zip(pdf["e"], pdf["t"], pdf["ew"], pdf["tw"]):
                a, b = np.asarray(a, dtype=np.int64), np.asarray(b, dtype=np.int64)
                if (s := agreement(a, b)) >= threshold - 1e-9:
                    rows.append((e, t, s, a, b))
            rows.sort(key=lambda r: len(r[3]))  # pairs of one length go together
            for k in range(0, len(rows), 256):
                part = rows[k : k + 256]
                bands = np.array([int(np.ceil((1 - threshold) * max(len(a), len(b)))) for *_, a, b in part])
                edits = banded_distances([(a, b) for *_, a, b in part], bands)
                out = [(e, t, int(d) if d <= w else None, s) for (e, t, s, _, _), d, w in zip(part, edits, bands)]
                yield pd.DataFrame(out, columns=["e", "t", "edits", "similarity"]).astype({"edits": "Int32"})

    return run


def _counts(texts: DataFrame) -> np.ndarray:
    """How many runs of the texts fall into each of BUCKETS."""
    n = np.zeros(BUCKETS, dtype=np.int64)
    rows = texts.select(F.explode("runs").alias("r")).groupBy(F.col("r").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("b")).agg(F.count("*").alias("n")).toArrow()  # at most BUCKETS rows
    n[rows["b"].to_numpy()] = rows["n"].to_numpy()
    return n


def _kept(texts: DataFrame, pairs, threshold: float) -> DataFrame:
    """(text_id, n, run) of the runs that are first in the order; those whose bucket one side lacks come before all others and meet nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = pairs.value
        for batch in batches:
            lists = batch.column(1)
            flat, n = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
            own = np.repeat(np.arange(len(n)), n)
            f = often[flat & (BUCKETS - 1)]
            order = np.lexsort((flat, f, own))
            place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            first = n - np.ceil(n * threshold - 1e-6).astype(np.int64) + 1
            keep = order[(place < first[own]) & (f[order] > 0)]
            yield pa.record_batch([batch.column(0).take(pa.array(own[keep])), pa.array(n[own[keep]].astype(np.int32)), pa.array(flat[keep])], names=["text_id", "n", "run"])

    return texts.select("text_id", "runs").mapInArrow(run, "text_id long, n int, run long")


def _possible(met: DataFrame, et: DataFrame, tt: DataFrame, threshold: float) -> DataFrame:
    """Candidates whose bitmaps allow the threshold: common runs are at most the common bits and the runs that share a bit with others."""
    bits = lambda df, k: df.select(F.col("text_id").alias(k), F.size("runs").alias(f"{k}n"), F.col("bits").alias(f"{k}b"), (F.size("runs") - sum((F.bit_count(F.col("bits")[i]) for i in range(BITS // 64)), F.lit(0))).alias(f"{k}c"))
    both = met.join(bits(et, "e"), "e").join(bits(tt, "t"), "t")
    common = sum((F.bit_count(F.col("eb")[i].bitwiseAND(F.col("tb")[i])) for i in range(BITS // 64)), F.lit(0)) + F.least("ec", "tc")
    return durable(both.where(common >= (F.col("en") + F.col("tn")) * (threshold / (1 + threshold)) - 1e-9).select("e", "t"), "candidates")


def cross_split(evaluation: DataFrame, training: DataFrame, key: str, text: str, threshold: float = 0.65) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(evaluation members, training members, links): members are (key, text_id), links (e, t, edits, similarity) between texts; ``edits`` is null for texts with moved parts."""
    schema = "key string, text_id long, words array<long>, runs array<long>, bits array<long>"
    pick = lambda df: durable(df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where("key is not null").mapInPandas(_words, schema).where(F.size("words") >= WIDTH), "words")
    ev, tr = pick(evaluation), pick(training)
    texts = lambda df: df.dropDuplicates(["text_id"]).select("text_id", "words", "runs", "bits")
    et, tt = durable(texts(ev), "texts"), durable(texts(tr), "texts")

    pairs = ev.sparkSession.sparkContext.broadcast(_counts(et) * _counts(tt))  # BUCKETS numbers
    a, b = _kept(et, pairs, threshold).alias("a"), _kept(tt, pairs, threshold).alias("b")
    near = (F.col("a.n") >= F.col("b.n") * threshold - 1e-6) & (F.col("b.n") >= F.col("a.n") * threshold - 1e-6)
    met = a.join(b, F.col("a.run") == F.col("b.run")).where(near).select(F.col("a.text_id").alias("e"), F.col("b.text_id").alias("t")).distinct()
    met = _possible(met, et, tt, threshold)
    both = met.join(et.select(F.col("text_id").alias("e"), F.col("words").alias("ew")), "e").join(tt.select(F.col("text_id").alias("t"), F.col("words").alias("tw")), "t")
    links = both.mapInPandas(_verify(threshold), "e long, t long, edits int, similarity double")
    return ev.select("key", "text_id").distinct(), tr.select("key", "text_id").distinct(), durable(links, "links")


def cross_split_pairs(evaluation: DataFrame, training: DataFrame, key: str, text: str, threshold: float = 0.65) -> DataFrame:
    """(e_key, t_key, edits, similarity) of all pairs of rows."""
    ev, tr, links = cross_split(evaluation, training, key, text, threshold)
    left, right = ev.select(F.col("key").alias("e_key"), F.col("text_id").alias("e")), tr.select(F.col("key").alias("t_key"), F.col("text_id").alias("t"))
    return links.join(left, "e").join(right, "t").select("e_key", "t_key", "edits", "similarity")
