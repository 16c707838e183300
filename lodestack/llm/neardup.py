"""Problem 1: near-duplicate records with small edits, by a prefix join that loses no pair.

Each text becomes its set of runs of three code tokens; equal sets are one
class.  Two sets that agree to t have at least t / (1 + t) of the sum of their
sizes in common.  With one order of all runs, the rarest first, the first
common run of such a pair leaves at least that many behind it in both sets, so
every pair meets on a run of the two prefixes.  A pair that meets must leave
enough runs behind the meeting place on both sides, and the bits in which the
sets' parity sketches differ must not outnumber the runs that may differ.
Both bounds hold for every pair, whatever the texts.  What is left is verified
on the exact sets.

Runs are joined by 32-bit codes.  Two runs with one code can only make more
pairs meet, as sets keep equal codes of different runs apart.

Defined results: null or blank texts and texts of fewer than three tokens
have no runs and join nothing; identical texts agree to 1; repeated rows of
one key count once; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestack.durable import discard, durable
from lodestack.llm import grams as G

#: Counters of the frequency order, whatever the number of texts: 2 MB, summed in SLICES pieces.
BUCKETS, SLICES = 1 << 18, 16
#: Bits of a parity sketch; too few for sets of many runs only cost time.
SKETCH = 512
#: Sets a part of the join stands for, the turns its codes are taken in, and pairs looked at in one go.
SETS, TURNS, CHUNK = 128_000, 8, 1_000_000
#: Bits of the filter that spares texts without a candidate, whatever the number of texts: 2 MB.
FILTER = 1 << 24


def _batches(batch: pa.RecordBatch, rows: int = 4000) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def _lists(flat: np.ndarray, counts: np.ndarray, kind) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind)))


def _shingles(texts) -> tuple:
    ids, counts = G.token_ids(texts)
    h, own, _ = G.grams(ids, counts, 3)
    flat, n = G.distinct(h, own, len(texts))
    return ids, counts, flat, n


def _fold(flat: np.ndarray, counts: np.ndarray, seed: int) -> np.ndarray:
    """One 64-bit hash per text of its sorted set."""
    h = G.mix(flat * np.uint64(2 * seed + 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    ends = np.cumsum(counts)
    total = np.concatenate([[np.uint64(0)], np.cumsum(h, dtype=np.uint64)])
    return G.mix(total[ends] - total[ends - counts] + counts.astype(np.uint64) * np.uint64(seed))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in _batches(whole):
            _, _, flat, n = _shingles(batch.column(1).to_pylist())
            out = pa.record_batch(
                [batch.column(0), pa.array(_fold(flat, n, 7).view(np.int64)), pa.array(n.astype(np.int32)), _lists((flat >> np.uint64(16)).astype(np.uint32).view(np.int32), n, np.int32)],
                names=["key", "full", "n", "codes"],
            )
            yield out.filter(pa.array(n > 0))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    often = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        often += np.bincount(batch.column(0).flatten().to_numpy() & (BUCKETS - 1), minlength=BUCKETS)
    for k, part in enumerate(np.split(often, SLICES)):
        yield pa.record_batch([pa.array([k], type=pa.int32()), pa.array([part.tobytes()], type=pa.binary())], names=["slice", "counts"])


def _summed(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b.as_buffer(), dtype=np.int64) for b in table.column("counts"))
    return pa.table({"slice": table.column("slice")[:1], "counts": pa.array([total.tobytes()], type=pa.binary())})


def _often(sig: DataFrame) -> np.ndarray:
    """How often each bucket of codes occurs: SLICES rows come to the driver."""
    rows = sig.select("codes").mapInArrow(_counts, "slice int, counts binary").groupBy("slice").applyInArrow(_summed, "slice int, counts binary")
    often = np.zeros(BUCKETS, dtype=np.int64)
    for k, counts in rows.toLocalIterator():
        often[k * (BUCKETS // SLICES) : (k + 1) * (BUCKETS // SLICES)] = np.frombuffer(counts, dtype=np.int64)
    return often


def _sketches(codes: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """For each set, bits that tell whether an odd number of its codes falls on them; they differ in no more bits than the sets in codes."""
    bit = G.mix(codes.astype(np.uint64)) >> np.uint64(32) & np.uint64(SKETCH - 1)
    odd = np.bincount(own * SKETCH + bit.astype(np.int64), minlength=n * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, SKETCH), axis=1)


def _prefixes(often_b, threshold: float, parts: int):
    """The codes of every set's prefix with their places, packed for each part: a row has the columns of many sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        often = often_b.value
        for whole in batches:
            for batch in _batches(whole):
                full = batch.column("full").to_numpy()
                first = np.unique(full, return_index=True)[1]
                new = [i for i in first.tolist() if full[i] not in seen]
                seen.update(full[new].tolist())
                if len(seen) > 1_000_000:
                    seen.clear()
                batch = batch.take(pa.array(sorted(new), type=pa.int64()))
                full, n = batch.column("full").to_numpy(), batch.column("n").to_numpy()
                codes = batch.column("codes").flatten().to_numpy().view(np.uint32)
                own = np.repeat(np.arange(len(n)), n)
                sketches = _sketches(codes, own, len(n))
                order = np.lexsort((codes, often[codes & np.uint32(BUCKETS - 1)], own))
                place = np.arange(len(codes)) - np.repeat(np.cumsum(n) - n, n)
                # a partner may be as small as the threshold lets it be
                keep = place <= (n - np.ceil(n * threshold - 1e-6).astype(np.int64))[own]
                codes, place, own = codes[order[keep]], place[keep].astype(np.int32), own[keep]
                part = (G.mix(codes.astype(np.uint64)) % np.uint64(parts)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                ends = np.searchsorted(part[order], np.arange(parts + 1))
                columns: list[list] = [[] for _ in range(7)]
                for k in np.flatnonzero(np.diff(ends)).tolist():
                    at = order[ends[k] : ends[k + 1]]
                    sets, m = np.unique(own[at], return_counts=True)
                    for c, v in zip(columns, (k, full[sets], n[sets], sketches[sets], m.astype(np.int32), codes[at], place[at]), strict=True):
                        c.append(v if isinstance(v, int) else v.tobytes())
                types = [pa.int32(), *[pa.binary()] * 6]
                yield pa.record_batch([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=["part", "full", "n", "sketch", "m", "codes", "place"])

    return run


def _pairs(codes: np.ndarray, place: np.ndarray, own: np.ndarray, n: np.ndarray, sketch: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sets that have a code in common and pass both bounds, CHUNK pairs after CHUNK pairs."""
    order = np.lexsort((own, n[own], codes))
    codes, place, own = codes[order].astype(np.int64), place[order], own[order]
    size = n[own]
    behind = size - place
    # the partners of an entry come after it: as large or larger, as far as the threshold lets them
    most = int(size.max(initial=0)) + 1
    ends = np.searchsorted(codes * most + size, codes * most + np.minimum(np.floor(size / threshold + 1e-6).astype(np.int64), most - 1), side="right")
    low = behind >= np.ceil(2 * threshold / (1 + threshold) * size - 1e-6)
    total = np.concatenate([[0], np.cumsum(np.where(low, ends - np.arange(len(own)) - 1, 0))])
    for start in range(0, int(total[-1]), CHUNK):
        end = min(start + CHUNK, int(total[-1]))
        rows = np.arange(np.searchsorted(total, start, side="right") - 1, np.searchsorted(total, end, side="left"))
        i = np.repeat(rows, np.minimum(total[rows + 1], end) - np.maximum(total[rows], start))
        j = i + 1 + np.arange(start, end) - total[i]
        both = size[i] + size[j]
        need = np.ceil(threshold / (1 + threshold) * both - 1e-6).astype(np.int64)
        ok = np.minimum(behind[i], behind[j]) >= need
        x, y, differ = own[i[ok]], own[j[ok]], (both - 2 * need)[ok]
        apart = np.where(x == y, differ + 1, 0)
        for words in np.split(np.arange(SKETCH // 64), 2):  # half a sketch settles most
            apart += np.bitwise_count(sketch[np.ix_(x, words)] ^ sketch[np.ix_(y, words)]).sum(axis=1, dtype=np.int64)
            ok = apart <= differ
            x, y, differ, apart = x[ok], y[ok], differ[ok], apart[ok]
        yield x, y


def _meetings(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of sets that meet on a code and pass both bounds; a partition has whole parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = list(batches)

        def whole(name: str, kind) -> np.ndarray:
            return np.frombuffer(b"".join(x.as_buffer() for b in packed for x in b.column(name)), dtype=kind)

        full, n, m = whole("full", np.int64), whole("n", np.int32).astype(np.int64), whole("m", np.int32)
        sketch = whole("sketch", np.uint64).reshape(len(full), SKETCH // 64)
        codes, place = whole("codes", np.uint32), whole("place", np.int32)
        packed.clear()
        own = np.repeat(np.arange(len(full), dtype=np.int32), m)
        once = np.zeros(len(full), dtype=bool)
        once[np.unique(full, return_index=True)[1]] = True  # copies from other partitions
        for k in range(TURNS):
            at = np.flatnonzero((codes >> np.uint32(16)) % np.uint32(TURNS) == k)
            at = at[once[own[at]]]
            for x, y in _pairs(codes[at], place[at].astype(np.int64), own[at], n, sketch, threshold):
                pair = np.unique(np.sort(np.stack([full[x], full[y]], axis=1), axis=1), axis=0)
                yield pa.record_batch([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["fa", "fb"])

    return run


def _needed_words(keys: DataFrame) -> np.ndarray:
    """The filter's 64-bit words: a bit for each key's hash.  At most FILTER / 64 rows come to the driver."""
    words = np.zeros(FILTER // 64, dtype=np.uint64)
    at = F.pmod(F.xxhash64("key"), F.lit(FILTER))
    bits = keys.select(F.floor(at / 64).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("b"))
    for w, b in bits.groupBy("w").agg(F.bit_or("b")).toLocalIterator():
        words[w] = np.int64(b).view(np.uint64)
    return words


def _sets(needed):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = needed.value
        for whole in batches:
            at = whole.column(2).to_numpy()
            hit = (words[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)
            for batch in _batches(whole.filter(pa.array(hit.astype(bool)))):
                _, _, flat, n = _shingles(batch.column(1).to_pylist())
                yield pa.record_batch([pa.array(_fold(flat, n, 7).view(np.int64)), _lists(flat, n, np.int64)], names=["full", "runs"])

    return run


def similar_texts(df: DataFrame, key: str, text: str, threshold: float = 0.65) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): every text's class of exact copies (key, rep), and pairs of representatives that agree to ``threshold``.

    ``rep`` is the smallest key with the same set of runs.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where(F.col("key").isNotNull() & (F.trim("text") != ""))
    sig = durable(rows.mapInArrow(_signatures, "key string, full long, n int, codes array<int>"), "signatures")
    often = spark.sparkContext.broadcast(_often(sig))
    keys = durable(sig.select("key", "full"), "keys")
    reps = durable(keys.groupBy("full").agg(F.min("key").alias("rep")), "reps")
    parts = max(2 * spark.sparkContext.defaultParallelism, reps.count() // SETS)
    entries = sig.select("full", "n", "codes").mapInArrow(_prefixes(often, threshold, parts), "part int, full binary, n binary, sketch binary, m binary, codes binary, place binary")
    met = entries.repartitionById(parts, "part").mapInArrow(_meetings(threshold), "fa long, fb long").distinct()
    ra, rb = reps.select(F.col("full").alias("fa"), F.col("rep").alias("ra")), reps.select(F.col("full").alias("fb"), F.col("rep").alias("rb"))
    pairs = durable(met.join(ra, "fa").join(rb, "fb"), "candidates")
    discard(sig)

    needed = pairs.select(F.explode(F.array(F.struct("fa", F.col("ra").alias("key")), F.struct(F.col("fb").alias("fa"), F.col("rb").alias("key")))).alias("p"))
    needed = durable(needed.select(F.col("p.fa").alias("full"), "p.key").distinct(), "needed")
    wanted = spark.sparkContext.broadcast(_needed_words(needed))
    hashed = rows.select("key", "text", F.pmod(F.xxhash64("key"), F.lit(FILTER)).alias("at"))
    sets = durable(hashed.mapInArrow(_sets(wanted), "full long, runs array<long>").join(needed, "full", "left_semi").dropDuplicates(["full"]), "sets")
    both = pairs.join(sets.select(F.col("full").alias("fa"), F.col("runs").alias("sa")), "fa").join(sets.select(F.col("full").alias("fb"), F.col("runs").alias("sb")), "fb")
    common = F.size(F.array_intersect("sa", "sb"))
    agree = common / (F.size("sa") + F.size("sb") - common)
    links = both.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), agree.alias("similarity")).where(F.col("similarity") >= threshold - 1e-9)
    members = keys.join(reps, "full").select("key", "rep").distinct()
    return members, links


def similar_pairs(df: DataFrame, key: str, text: str, threshold: float = 0.65) -> DataFrame:
    """All pairs of keys (a < b) that agree to ``threshold``, copies included."""
    members, links = similar_texts(df, key, text, threshold)
    members = durable(members, "members")
    links = durable(links, "links")
    left, right = members.select(F.col("key").alias("ka"), F.col("rep").alias("a")), members.select(F.col("key").alias("kb"), F.col("rep").alias("b"))
    across = links.join(left, "a").join(right, "b").select("ka", "kb")
    copies = members.groupBy("rep").count().where("count > 1").select("rep")
    own = members.join(copies, "rep", "left_semi")
    inside = own.alias("x").join(own.alias("y"), (F.col("x.rep") == F.col("y.rep")) & (F.col("x.key") < F.col("y.key"))).select(F.col("x.key").alias("ka"), F.col("y.key").alias("kb"))
    return across.unionAll(inside).select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b")).distinct()
