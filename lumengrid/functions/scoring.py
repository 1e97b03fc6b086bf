"""Vector and score expressions. Row-level NaN counts as NULL inside plans; a score that is missing becomes 0 at the end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

FLAT = 1e-12


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Null if either is null or their lengths differ (zip_with fills the shorter with nulls)."""
    return F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    size = F.array(F.greatest(norm(v), F.lit(FLAT)))  # found once, not for each element
    return F.flatten(F.transform(size, lambda n: F.transform(as_doubles(v), lambda x: x / n)))


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector, null for a missing one."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(FLAT)) * F.greatest(norm(b), F.lit(FLAT)))


def shrunk_mean(count: Column, mean: Column, overall: Column, prior: float) -> Column:
    """The mean drawn towards the overall mean by prior ratings."""
    return (F.lit(prior) * overall + F.coalesce(count, F.lit(0)) * F.coalesce(mean, F.lit(0.0))) / (F.lit(prior) + F.coalesce(count, F.lit(0)))


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def minmax(x: Column, over: WindowSpec | None = None) -> Column:
    """0 to 1 over the finite values of a window; 0.5 where they are all equal, 0 for NaN and null, 1 and 0 for infinities."""
    over = over or Window.partitionBy()
    low, high = F.min(finite(x)).over(over), F.max(finite(x)).over(over)
    plus, minus = x.cast("double") == float("inf"), x.cast("double") == float("-inf")
    return (
        F.when(low.isNull(), 0.0)
        .when(high - low < FLAT, F.when(finite(x).isNotNull(), 0.5).otherwise(0.0))
        .when(F.coalesce(plus, F.lit(False)), 1.0)
        .when(F.coalesce(minus, F.lit(False)) | finite(x).isNull(), 0.0)
        .otherwise((finite(x) - low) / (high - low))
    )


def shares(names: Sequence[str], weights: dict[str, float]) -> dict[str, float]:
    """Weights of the signals that are present, adding up to 1."""
    if not names:
        raise ValueError("no signal is present")
    unknown = [n for n in names if n not in weights]
    if unknown:
        raise ValueError(f"no weight for {', '.join(unknown)}")
    total = sum(weights[n] for n in names)
    if total <= 0:
        raise ValueError("the weights present must add up to more than 0")
    return {n: weights[n] / total for n in names}


def blend(signals: dict[str, Column], weights: dict[str, float], over: WindowSpec | None = None) -> Column:
    """The weighted sum of min-max scaled signals; those that are absent are left out of the dict."""
    parts = shares(list(signals), weights)
    total = F.lit(0.0)
    for name, x in signals.items():
        total = total + F.lit(parts[name]) * minmax(x, over)
    return total


def shown(x: Column) -> Column:
    """Four decimals; null for NaN."""
    return F.round(F.when(F.isnan(x), None).otherwise(x), 4)
