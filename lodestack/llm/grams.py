"""Vectorised token n-gram hashing over whole Arrow batches."""

from __future__ import annotations

import re

import numpy as np
import xxhash

CODE_TOKEN = re.compile(r"\w+|[^\w\s]")
WORD = re.compile(r"\w+")
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_ids: dict[str, int] = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


def token_ids(texts, pattern=CODE_TOKEN) -> tuple[np.ndarray, np.ndarray]:
    """Stable 64-bit ids of all tokens, one text after the other, and each text's token count."""
    if len(_ids) > 2_000_000:
        _ids.clear()
    flat: list[int] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    known = _ids
    for k, text in enumerate(texts):
        tokens = pattern.findall(text) if text else []
        counts[k] = len(tokens)
        for t in set(tokens).difference(known):
            known[t] = xxhash.xxh64_intdigest(t)
        flat.extend(map(known.__getitem__, tokens))
    return np.array(flat, dtype=np.uint64), counts


def grams(ids: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text index, position) of every run of ``width`` successive tokens."""
    total = len(ids)
    if total < width:
        none = np.zeros(0, dtype=np.uint64)
        return none, none.astype(np.int64), none.astype(np.int64)
    h = np.zeros(total - width + 1, dtype=np.uint64)
    for i in range(width):
        h = h * _MULT + ids[i : total - width + 1 + i]
    owner = np.repeat(np.arange(len(counts)), counts)
    keep = owner[: total - width + 1] == owner[width - 1 :]
    starts = np.cumsum(counts) - counts
    at = np.flatnonzero(keep)
    own = owner[at]
    return mix(h[at]), own, at - starts[own]


def distinct(h: np.ndarray, own: np.ndarray, n: int, bits: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ``bits``-bit hashes per text, flat, and their counts; ``n`` < 2**(64-bits)."""
    key = (own.astype(np.uint64) << np.uint64(bits)) | (h >> np.uint64(64 - bits))
    key = np.unique(key)
    counts = np.bincount((key >> np.uint64(bits)).astype(np.int64), minlength=n)
    return key & np.uint64((1 << bits) - 1), counts


def winnow(h: np.ndarray, own: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest hash of every ``span`` neighbouring grams of a text (all of them if it has fewer).

    Two texts with a common run of ``span`` grams share at least one kept hash.
    """
    if not len(h):
        return h, own
    low = h.copy()
    last = own.copy()
    n = len(h)
    for i in range(1, min(span, n)):
        same = np.zeros(n, dtype=bool)
        same[: n - i] = own[i:] == own[: n - i]
        nxt = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
        nxt[: n - i] = h[i:]
        low = np.where(same, np.minimum(low, nxt), low)
    full = np.zeros(n, dtype=bool)
    if n >= span:
        full[: n - span + 1] = own[span - 1 :] == own[: n - span + 1]
    size = np.bincount(own, minlength=int(own.max()) + 1)
    keep = full | (size[own] < span)
    return low[keep], last[keep]
