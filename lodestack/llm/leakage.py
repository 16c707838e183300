"""Problem 9: evaluation texts leaking into training text, by greedy string tiling.

Lines that many items share say nothing about one item and are left out; items
with equal words are one entry.  Entries go to the workers in blocks of
BLOCK_WORDS words, one block after the other, so what is sent never grows with
the items, and no result depends on the other items of a block.  Documents meet
entries on shared seeds of SEED words; seeds that follow one another on a
diagonal form a run, and RUN words are a leak at once.  An entry also counts as
leaked by ORDERED successive words of it in which any words but never two in
succession are changed, dropped or added, however many: a bitmap of all words
of the documents of a batch rules out the entries that have no ORDERED words
without two missing ones in succession, and the rest is aligned in those bands of
diagonals that hold CORE successive common words.  (A chain without any, which
takes 16 changes or more in ORDERED words, isn't met.)  Leaked pairs are tiled: running Karp-Rabin hashes of
shrinking width find the longest unmarked common runs, which are marked,
longest first, until none of MIN_TILE words is left.  The tiles' coverage of the
entry also finds passages in another order: with ``coverage`` given, pairs whose
tiles of PIECE words and more cover that share of the entry are leaks, too.

Defined results: null and empty texts match nothing; items shorter than RUN
words match nothing; items with equal texts all match; repeated keys give one
row a pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestack.durable import durable
from lodestack.llm import grams as G

SEED, CORE, MIN_TILE, RUN, ORDERED, PIECE = 16, 3, 3, 20, 50, 5
BLOCK_WORDS = 250_000
#: Diagonals of a band, by how many a chain may leave it on either side; pairs aligned at a time.
BAND, DRIFT, PAIRS = 48, 16, 256
#: Items that share a line (as a share of all, and at least so many) make it an instruction line.
LINE_SHARE, LINE_ITEMS = 0.02, 4
_MARKUP = re.compile(r"</?[A-Za-z][^<>\n]{0,80}>|\\(?=[_*])")
_WORD = re.compile(r"[^\W_]+(?:_+[^\W_]+)*")


def plain(text: str | None) -> str:
    return _MARKUP.sub("", text).lower() if text else ""


def entries(items: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(item, entry) of all items and (entry, text): each entry's text without instruction lines; items with equal words are one entry."""
    rows = items.select(F.col(key).alias("item"), F.col(text).alias("whole")).where("whole is not null").distinct()
    texts = rows.select("whole").distinct()
    lines = texts.select("whole", F.posexplode(F.split("whole", "\n")).alias("i", "line")).withColumn("bare", F.trim("line")).where("bare <> ''")
    least = F.greatest(F.lit(LINE_ITEMS), F.lit(LINE_SHARE * texts.count()))
    shared = lines.select("whole", "bare").distinct().groupBy("bare").count().where(F.col("count") >= least).select("bare")
    kept = lines.join(shared, "bare", "left_anti").groupBy("whole").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("text"))  # one item's lines
    words = F.regexp_extract_all(F.lower(F.regexp_replace("text", _MARKUP.pattern, "")), F.lit("(?U)" + _WORD.pattern), F.lit(0))
    named = durable(kept.withColumn("entry", F.xxhash64(words)), "entries")
    return rows.join(named.select("whole", "entry"), "whole").select("item", "entry"), named.groupBy("entry").agg(F.min("text").alias("text"))


class ItemIndex:
    """Words and seeds of a block of items, given as (key, text)."""

    def __init__(self, items: list[tuple]):
        self.keys = [k for k, _ in items]
        ids, counts = G.token_ids([plain(t) for _, t in items], _WORD)
        self.ids, self.counts, self.starts = ids, counts, np.cumsum(counts) - counts
        self.vocabulary, codes = np.unique(ids, return_inverse=True)
        self.codes = codes.astype(np.int16 if len(self.vocabulary) < 1 << 15 else np.int32)
        own = np.repeat(np.arange(len(counts)), counts)
        self.last = np.append(own[1:] != own[:-1], True)[: len(own)]
        self.seeds = {w: self._seeds(w) for w in (SEED, PIECE)}

    def _seeds(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        h, own, pos = G.grams(self.ids, self.counts, width)
        order = np.argsort(h, kind="stable")
        bitmap = np.zeros(1 << 20, dtype=bool)
        bitmap[(h >> np.uint64(44)).astype(np.int64)] = True
        return h[order], own[order], pos[order], bitmap

    def meet(self, ids: np.ndarray, counts: np.ndarray, width: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, place in the item, length in words) of every run of shared seeds."""
        width = width or SEED
        seeds, owners, places, bitmap = self.seeds[width]
        h, own, pos = G.grams(ids, counts, width)
        hit = bitmap[(h >> np.uint64(44)).astype(np.int64)]
        h, own, pos = h[hit], own[hit], pos[hit]
        lo, hi = np.searchsorted(seeds, h, "left"), np.searchsorted(seeds, h, "right")
        n = hi - lo
        at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        doc, item, place = np.repeat(own, n), owners[at], places[at]
        diagonal = np.repeat(pos, n) - place
        order = np.lexsort((place, diagonal, item, doc))
        doc, item, diagonal, place = doc[order], item[order], diagonal[order], place[order]
        first = np.ones(len(doc), dtype=bool)
        first[1:] = (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(diagonal) != 0) | (np.diff(place) != 1)
        begin = np.flatnonzero(first)
        return doc[begin], item[begin], place[begin], np.diff(np.append(begin, len(doc))) + width - 1

    def coded(self, ids: np.ndarray) -> np.ndarray:
        """The numbers of words in the items' vocabulary; -3 for others."""
        at = np.minimum(np.searchsorted(self.vocabulary, ids), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == ids, at, -3).astype(self.codes.dtype)

    def possible(self, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, item) of the pairs in which ORDERED successive words of the item have no two in succession that the text lacks; a bit a text."""
        hit = codes >= 0
        present = np.zeros((len(self.vocabulary), len(counts)), dtype=bool)
        present[codes[hit], np.repeat(np.arange(len(counts)), counts)[hit]] = True
        missing = ~np.packbits(present, axis=1)[self.codes]
        broken = np.empty_like(missing)  # before the next word
        broken[:-1] = missing[1:] & missing[:-1]
        broken[self.last] = 0xFF
        width = 1
        while width < ORDERED - 1:
            step = min(width, ORDERED - 1 - width)
            wider = broken.copy()
            wider[:-step] |= broken[step:]
            wider[-step:] = 0xFF
            broken, width = wider, width + step
        some = np.flatnonzero(self.counts)
        blocked = np.bitwise_and.reduceat(broken, self.starts[some], axis=0)
        item, doc = np.nonzero(~np.unpackbits(blocked, axis=1)[:, : len(counts)].astype(bool))
        return doc, some[item]


def _runs(ids: np.ndarray, free: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin hashes of all runs of ``width`` unmarked words, and where they start."""
    if len(ids) < width:
        return ids[:0], np.zeros(0, dtype=np.int64)
    h, _, pos = G.grams(ids, np.array([len(ids)]), width)
    blocked = np.concatenate([[0], np.cumsum(~free)])
    ok = blocked[pos + width] == blocked[pos]
    return h[ok], pos[ok]


def tiles(a: np.ndarray, b: np.ndarray, least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in a, start in b, length) of non-overlapping common runs, longest first."""
    free_a, free_b = np.ones(len(a), dtype=bool), np.ones(len(b), dtype=bool)
    out: list[tuple[int, int, int]] = []
    width = min(len(a), len(b), 64)
    while width >= least:
        ha, pa_ = _runs(a, free_a, width)
        hb, pb = _runs(b, free_b, width)
        order = np.argsort(hb, kind="stable")
        hb, pb = hb[order], pb[order]
        lo, hi = np.searchsorted(hb, ha, "left"), np.searchsorted(hb, ha, "right")
        found = []
        for i in np.flatnonzero(hi > lo).tolist():
            for j in pb[lo[i] : hi[i]].tolist():
                x, y = int(pa_[i]), j
                if x and y and free_a[x - 1] and free_b[y - 1] and a[x - 1] == b[y - 1]:
                    continue  # the run that starts earlier covers it
                k = width
                while x + k < len(a) and y + k < len(b) and free_a[x + k] and free_b[y + k] and a[x + k] == b[y + k]:
                    k += 1
                found.append((k, x, y))
        found.sort(key=lambda f: (-f[0], f[1], f[2]))
        for k, x, y in found:
            if free_a[x : x + k].all() and free_b[y : y + k].all():
                free_a[x : x + k] = False
                free_b[y : y + k] = False
                out.append((x, y, k))
        width = width // 2 if width > 2 * least else width - 1
    return out


def chained(found: list[tuple[int, int, int]]) -> int:
    """The most words of ``a`` under successive tiles with single changed, dropped or added words between them."""
    best, at = 0, {}
    for x, y, k in sorted(found):
        length = k
        for dx in (0, 1):
            for dy in (0, 1):
                if dx + dy and (before := at.get((x - dx, y - dy))):
                    length = max(length, before + k + dx)
        at[x + k, y + k] = max(at.get((x + k, y + k), 0), length)
        best = max(best, length)
    return best


def aligned(a: list[np.ndarray], b: list[np.ndarray], low: np.ndarray, width: int) -> np.ndarray:
    """For many pairs at once, the most successive words of ``a`` in order in ``b`` with isolated changes, over the diagonals from ``low`` on; 0 if two successive words without a partner on these diagonals rule ORDERED out."""
    n = max(map(len, a))
    left, right = np.full((len(a), n), -1, dtype=a[0].dtype), np.full((len(a), n + width), -2, dtype=a[0].dtype)
    for i, (x, y, d) in enumerate(zip(a, b, low.tolist())):
        left[i, : len(x)] = x
        part, at = y[max(0, d) : max(0, d + n + width)], max(0, -d)
        part = part[: n + width - at]
        right[i, at : at + len(part)] = part
    same = left[:, :, None] == np.lib.stride_tricks.sliding_window_view(right, width, axis=1)[:, :n]
    missing = ~same.any(axis=2)
    twice = np.zeros((len(a), n), dtype=bool)
    twice[:, 1:] = missing[:, 1:] & missing[:, :-1]
    places = np.arange(n)
    last = np.maximum.accumulate(np.where(twice, places, -1), axis=1)  # a chain may begin and end beside a changed word
    some = np.flatnonzero((places - last + 1).max(axis=1) >= ORDERED)
    out = np.zeros(len(a), dtype=np.int16)
    if not len(some):
        return out
    same = same[some]
    best, one = np.zeros(len(some), dtype=np.int16), np.zeros((len(some), width + 2), dtype=np.int16)  # a column at each side that stays 0
    two = one
    for x in range(n):
        # after the word before or a word that b adds; after a word that is changed or that b drops
        changed = np.maximum(two[:, 1:-1], two[:, 2:])
        longest = np.maximum(np.maximum(one[:, 1:-1], one[:, :-2]) + 1, np.where(changed > 0, changed + 2, 0))
        new = np.zeros_like(one)
        new[:, 1:-1] = longest * same[:, x]
        np.maximum(best, new.max(axis=1), out=best)
        one, two = new, one
    out[some] = best
    return out


def find_leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, coverage: float | None = None) -> DataFrame:
    """(key, item, longest, ordered, coverage) of every document that contains an item's passage."""
    spark = docs.sparkSession
    kind = dict(docs.select(F.col(key).alias("key")).dtypes)["key"]
    schema = f"key {kind}, entry long, longest int, ordered int, coverage double"
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.length("text") > 0)
    members, texts = entries(items, item_key, item_text)
    out, block, size = None, [], 0

    def search() -> DataFrame:
        part = source.mapInArrow(_search(spark.sparkContext.broadcast(ItemIndex(block)), coverage), schema)  # BLOCK_WORDS, about
        return part if out is None else out.unionAll(part)

    for entry, body in texts.orderBy("entry").toLocalIterator():  # the query set, block by block
        block.append((entry, body))
        size += len(body.split())
        if size >= BLOCK_WORDS:
            out, block, size = search(), [], 0
    if block or out is None:
        out = search()
    return out.dropDuplicates(["key", "entry"]).join(members, "entry").select("key", "item", "longest", "ordered", "coverage")


def _bands(index: ItemIndex, ids: np.ndarray, counts: np.ndarray, doc: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, band) of the pairs' bands of diagonals that hold CORE successive common words."""
    h, own, at = G.grams(ids, counts, CORE)
    keys = G.mix(h + own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # a text's own grams
    order = np.argsort(keys, kind="stable")
    keys, at = keys[order], at[order]
    h, owner, place = G.grams(index.ids, index.counts, CORE)
    first = np.searchsorted(owner, np.arange(len(index.counts) + 1))
    n = (first[1:] - first[:-1])[item]
    pair = np.repeat(np.arange(len(item)), n)
    gram = np.repeat(first[item], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    wanted = G.mix(h[gram] + doc[pair].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    seen = np.zeros(1 << 22, dtype=bool)
    seen[(keys >> np.uint64(42)).astype(np.int64)] = True
    some = seen[(wanted >> np.uint64(42)).astype(np.int64)]
    pair, gram, wanted = pair[some], gram[some], wanted[some]
    lo, hi = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
    n = hi - lo
    hit = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    band = (at[hit] - np.repeat(place[gram], n)) // BAND
    both = np.unique((np.repeat(pair, n) << 32) + (band + (1 << 31)))
    pair, band = both >> 32, (both & 0xFFFFFFFF) - (1 << 31)
    return doc[pair], item[pair], band


def _leaked(index: ItemIndex, ids: np.ndarray, counts: np.ndarray, coverage: float | None = None) -> dict[tuple[int, int], int]:
    """The pairs (text, item) that are leaks or, by their seeds, may have the coverage, with their words in order by alignment."""
    starts = np.cumsum(counts) - counts
    doc, item, _, length = index.meet(ids, counts)
    long = length >= RUN
    out = {(d, i): 0 for d, i in zip(doc[long].tolist(), item[long].tolist())}
    if coverage is not None:
        doc, item, _, length = index.meet(ids, counts, PIECE)
        pairs, at = np.unique(np.stack([doc, item]), axis=1, return_inverse=True)
        if len(doc):
            enough = np.bincount(at.ravel(), weights=length) >= coverage * index.counts[pairs[1]]
            out |= {(d, i): out.get((d, i), 0) for d, i in pairs[:, enough].T.tolist()}
    if not len(index.ids) or not len(ids):
        return out
    codes = index.coded(ids)
    doc, item, band = _bands(index, ids, counts, *index.possible(codes, counts))
    order = np.argsort(index.counts[item], kind="stable")  # items of one length go together
    for k in range(0, len(order), PAIRS):
        at = order[k : k + PAIRS]
        a = [index.codes[index.starts[j] : index.starts[j] + index.counts[j]] for j in item[at].tolist()]
        b = [codes[starts[j] : starts[j] + counts[j]] for j in doc[at].tolist()]
        for pair, words in zip(zip(doc[at].tolist(), item[at].tolist()), aligned(a, b, band[at] * BAND - DRIFT, BAND + 2 * DRIFT).tolist()):
            if words >= ORDERED or pair in out:
                out[pair] = max(out.get(pair, 0), words)
    return out


def _search(shared, coverage: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = shared.value
        step = max(8, min(1000, 30_000_000 // max(1, len(index.ids))))
        for whole in batches:
            for k in range(0, whole.num_rows, step):
                batch = whole.slice(k, step)
                keys, texts = batch.column(0), [plain(t) for t in batch.column(1).to_pylist()]
                ids, counts = G.token_ids(texts, _WORD)
                starts = np.cumsum(counts) - counts
                rows = []
                for (d, i), ordered in sorted(_leaked(index, ids, counts, coverage).items()):
                    a, b = index.ids[index.starts[i] : index.starts[i] + index.counts[i]], ids[starts[d] : starts[d] + counts[d]]
                    found = tiles(a, b)
                    longest, ordered = max(t[2] for t in found), max(ordered, chained(found))
                    covered = sum(t[2] for t in found if t[2] >= PIECE) / len(a)
                    if longest >= RUN or ordered >= ORDERED or (coverage is not None and covered >= coverage):
                        rows.append((d, index.keys[i], longest, ordered, covered))
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array([r[0] for r in rows], type=pa.int64())), pa.array([r[1] for r in rows], type=pa.int64()), pa.array([r[2] for r in rows], type=pa.int32()), pa.array([r[3] for r in rows], type=pa.int32()), pa.array([r[4] for r in rows], type=pa.float64())],
                    names=["key", "entry", "longest", "ordered", "coverage"],
                )

    return run
