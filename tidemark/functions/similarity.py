"""Bag similarities and string metrics.

A bag's weight is the sum of its tokens' weights, 1 each if unweighted; a token without a weight has 0. ``met``
is the weight of the bags' intersection.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Metric:
    """``value`` of (met, w1, w2); ``matches`` of (value, threshold); ``least`` overlap that a bag of a weight needs to match
    any other, and ``needed`` overlap of two bags of given weights."""

    name: str
    value: Callable[[Column, Column, Column], Column]
    least: Callable[[float, Column], Column]
    needed: Callable[[float, Column, Column], Column]
    tolerance: float = 0.0

    def matches(self, value: Column, threshold: float) -> Column:
        return value + F.lit(self.tolerance) >= F.lit(float(threshold))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / F.nullif(b, F.lit(0.0))).otherwise(F.lit(0.0))


_TOLERANCE = 1e-6
METRICS = {
    "jaccard": Metric("jaccard", lambda m, a, b: _ratio(m, a + b - m), lambda t, w: F.lit(float(t) - _TOLERANCE) * w, lambda t, a, b: F.lit((t - _TOLERANCE) / (1 + t - _TOLERANCE)) * (a + b), _TOLERANCE),
    "overlap": Metric("overlap", lambda m, a, b: m, lambda t, w: F.lit(float(t)) + w * 0, lambda t, a, b: F.lit(float(t))),
    "dice": Metric("dice", lambda m, a, b: _ratio(m * 2, a + b), lambda t, w: F.lit(t / (2.0 - t)) * w, lambda t, a, b: F.lit(t / 2.0) * (a + b)),
    "cosine": Metric("cosine", lambda m, a, b: _ratio(m, F.sqrt(a * b)), lambda t, w: F.lit(float(t) ** 2) * w, lambda t, a, b: F.lit(float(t)) * F.sqrt(a * b)),
}


def metric(name: str) -> Metric:
    """The metric of a name; a leading ``weighted`` and the case do not matter."""
    key = name.lower().replace("similarity", "").replace("_", "").removeprefix("weighted")
    if key not in METRICS:
        raise ValueError(f"unknown similarity {name!r}; known: {', '.join(METRICS)}")
    return METRICS[key]


def numbered(tokens: Column) -> Column:
    """A bag as a set: each token with how often it occurred before."""
    ordered = F.array_sort(tokens)
    return F.transform(ordered, lambda x, i: F.struct(x.alias("token"), (i + 1 - F.array_position(ordered, x)).cast("int").alias("nth")))


def bag_weight(tokens: Column, weights: Column | None = None) -> Column:
    """Sum of the tokens' weights; ``weights`` is a map from token to weight."""
    if weights is None:
        return F.size(tokens).cast("double")
    return F.aggregate(tokens, F.lit(0.0), lambda s, x: s + F.coalesce(F.try_element_at(weights, x), F.lit(0.0)))


def intersection_weight(a: Column, b: Column, weights: Column | None = None) -> Column:
    """Weight of the bags' intersection: a token counts as often as both have it."""
    met = F.array_intersect(numbered(a), numbered(b))
    if weights is None:
        return F.size(met).cast("double")
    return F.aggregate(met, F.lit(0.0), lambda s, x: s + F.coalesce(F.try_element_at(weights, x["token"]), F.lit(0.0)))


def similarity(name: str, a: Column, b: Column, weights: Column | None = None) -> Column:
    """Similarity of two token columns. Bags without weight have similarity 0."""
    return metric(name).value(intersection_weight(a, b, weights), bag_weight(a, weights), bag_weight(b, weights))


def edit_distance(a: Column, b: Column, limit: int | None = None) -> Column:
    """Levenshtein distance of two token columns joined by blanks; ``limit + 1`` beyond a limit."""
    x, y = F.array_join(a, " "), F.array_join(b, " ")
    if limit is None:
        return F.levenshtein(x, y)
    d = F.levenshtein(x, y, limit)
    return F.when(d < 0, F.lit(limit + 1)).otherwise(d)


def number(c: Column | str, default: float = 0.0) -> Column:
    """The string as a number, or the default."""
    return F.coalesce(F.col(c).try_cast("double") if isinstance(c, str) else c.try_cast("double"), F.lit(float(default)))
