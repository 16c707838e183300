"""Exact statistics in closed form, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed value: the normal quantile of a two-sided 95 % interval.
Z = 1.959963984540054


def rate(part: Column, whole: Column, digits: int | None = None) -> Column:
    """part / whole, 0 for an empty whole; rounded half-even on request."""
    r = F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / F.when(whole != 0, whole))
    return r if digits is None else F.bround(r, digits)


def wilson(passed: Column, total: Column) -> tuple[Column, Column]:
    """Ends of the Wilson 95 % interval; (0, 0) for no rows."""
    n = F.when(total != 0, total).cast("double")
    p = passed / n
    scale = 1 + Z**2 / n
    centre = (p + Z**2 / (2 * n)) / scale
    half = (Z / scale) * F.sqrt(p * (1 - p) / n + Z**2 / (4 * n * n))
    ends = F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
    return tuple(F.when(total != 0, e).otherwise(0.0) for e in ends)


def log_gamma(x: Column) -> Column:
    """ln gamma for x >= 1, by Stirling's series after a shift to x + 8; absolute error below 1e-12."""
    z = x + 8.0
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    shift = F.log(x) + F.log(x + 1) + F.log(x + 2) + F.log(x + 3) + F.log(x + 4) + F.log(x + 5) + F.log(x + 6) + F.log(x + 7)
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + series - shift


def exact_sign_p(wins: Column, losses: Column, none: float | None = 1.0) -> Column:
    """Two-sided exact sign (McNemar) test; ``none`` without discordant pairs.

    Terms are summed from the largest down as ratios of neighbours, so no factorial is formed.
    """
    n, k = (wins + losses).cast("long"), F.least(wins, losses).cast("long")
    top = F.exp(log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0) - n * F.log(F.lit(2.0)))
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    step = lambda a, i: F.struct((a["term"] * (k - i + 1) / (n - k + i)).alias("term"), (a["total"] + a["term"] * (k - i + 1) / (n - k + i)).alias("total"))
    # terms below 1e-18 of the first no longer count; a thousand of them reach there for any n below about 10**7
    ratio = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), F.least(k, F.lit(20_000)))).otherwise(F.array().cast("array<bigint>")), zero, step)["total"]
    return F.when(n == 0, F.lit(none)).otherwise(F.least(F.lit(1.0), 2.0 * top * ratio))


def sample_size(p: Column, half_width: float) -> Column:
    """Rows for a normal interval of this half-width."""
    return F.ceil(Z**2 * p * (1 - p) / half_width**2)


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def log1p_safe(x: Column) -> Column:
    return F.log1p(F.greatest(F.lit(0.0), F.coalesce(x.cast("double"), F.lit(0.0))))


def score_to_int(x: Column) -> Column:
    """A score of 1 to 5 rounded half-even; null for anything else."""
    r = F.bround(F.try_add(x.cast("double"), F.lit(0.0)), 0)
    return F.when(r.between(1, 5), r.cast("int"))


def kappa(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    """Cohen's kappa of a 2x2 table; 0 where chance agreement is complete."""
    n = (tp + tn + fp + fn).cast("double")
    seen = (tp + tn) / n
    chance = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    return F.when((n == 0) | (chance == 1), F.lit(0.0)).otherwise((seen - chance) / F.when(chance != 1, 1 - chance))
