"""Writing tables, documents and reports."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame


def jsonl(df: DataFrame, path: str, by: list[str] | None = None, order: list[str] | None = None) -> None:
    """JSON lines, by folders of the columns ``by``, sorted within files by ``order``."""
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    w = df.write.mode("overwrite").option("ignoreNullFields", False)
    (w.partitionBy(*by) if by else w).json(path)


def parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def row_document(df: DataFrame, path: str) -> dict:
    """A one-row table as a JSON document, on the driver."""
    row = df.limit(2).collect()
    if len(row) != 1:
        raise ValueError("a document needs exactly one row")
    value = row[0].asDict(True)
    document(value, path)
    return value


def document(value: Any, path: str) -> None:
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    if p.suffix in (".yaml", ".yml"):
        import yaml

        p.write_text(yaml.safe_dump(value, allow_unicode=True, sort_keys=False), encoding="utf-8")
    else:
        p.write_text(json.dumps(value, ensure_ascii=False, indent=2, default=str) + "\n", encoding="utf-8")


def markdown(df: DataFrame, most: int = 200) -> str:
    """A table of at most ``most`` rows; how many more there are is said below it."""
    head = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    rows = df.limit(most + 1).collect()
    lines = [head, *("| " + " | ".join(map(cell, r)) + " |" for r in rows[:most])]
    more = df.count() - most if len(rows) > most else 0
    return "\n".join(lines) + "\n" + (f"\n{more} more rows are not shown.\n" if more else "")
