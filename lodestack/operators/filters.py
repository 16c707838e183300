"""Which rows take part: by split, kind of task, fitness for tests, category."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lodestack.operators.gates import first_reason


def from_training(split: Column) -> Column:
    """Whether a split's text names training data: train, .../train, ..._train or .../train/..."""
    return F.coalesce(split.rlike(r"^train$|[/_]train$|/train/"), F.lit(False))


def task_type_allowed(split: Column, kind: Column, training: tuple[str, ...] = (), held_out: tuple[str, ...] = ()) -> Column:
    """Whether a split takes a kind of task; an empty list allows all."""
    is_train = F.coalesce(split, F.lit("")) == "train"
    fits = lambda names: F.coalesce(kind.isin(*names), F.lit(False)) if names else F.lit(True)
    return F.when(is_train, fits(training)).otherwise(fits(held_out))


def unfit_for_tests(mode: Column, function: Column, canonical: Column, failed: Column) -> Column:
    """Why a row can't get generated tests; null if it can."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return first_reason([("io_mode_not_function_call", ~mode.eqNullSafe("function_call")), ("missing_fn_name", blank(function)), ("missing_canonical_solution", blank(canonical)), ("missing_previous_repair_code", blank(failed))])


def of_category(category: Column, wanted: str | None) -> Column:
    """Whether a row is of the wanted category; all are if none is named."""
    return F.lit(True) if wanted is None else F.coalesce(category == wanted, F.lit(False))
