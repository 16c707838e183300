"""Token lengths with a public tokenizer, and gates over them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lodestack.functions import text as T

_loaded: dict = {}


def _tokenizer(path: str):
    """One tokenizer a worker process and file."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _loaded[path] = t
    return _loaded[path]


def with_lengths(df: DataFrame, columns: list[str], path: str | None = None) -> DataFrame:
    """``df`` with ``<column>_tokens``; by blanks where no vocabulary file is named.  Null counts as no tokens.

    The file must be at the same path on every executor.
    """
    if path is None:
        return df.select("*", *(T.token_count(F.col(c)).alias(f"{c}_tokens") for c in columns))

    @F.pandas_udf("int")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = _tokenizer(path)
        for part in texts:
            yield pd.Series([len(e.ids) for e in t.encode_batch([x or "" for x in part], add_special_tokens=False)], dtype="int32")

    return df.select("*", *(count(F.col(c)).alias(f"{c}_tokens") for c in columns))


def length_reason(prompt: Column, completion: Column, most: int, least_completion: int = 1) -> Column:
    """Why a pair doesn't fit a window: completion_too_short, prompt_too_long, total_too_long; null if it does."""
    return F.when(completion < least_completion, "completion_too_short").when(prompt >= most, "prompt_too_long").when(prompt + completion > most, "total_too_long")
