"""Matchers narrow candidate pairs (id_a, id_b, and what features need) to matches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Matcher = Callable[[DataFrame], DataFrame]


def all_pairs(pairs: DataFrame) -> DataFrame:
    """Every candidate matches."""
    return pairs


def by_similarity(value: Column, threshold: float, tolerance: float = 0.0) -> Matcher:
    """Keeps pairs whose value reaches the threshold."""
    return lambda pairs: pairs.where(value + F.lit(tolerance) >= F.lit(threshold))


def by_labels(labels: DataFrame, positive: float = 0.5) -> Matcher:
    """Keeps pairs labelled above ``positive``; ``labels`` is (id_a, id_b, label)."""
    yes = labels.where(F.col("label") > F.lit(positive)).select("id_a", "id_b").distinct()
    return lambda pairs: pairs.join(yes, ["id_a", "id_b"], "left_semi")


def pair_bucket(seed: int = 0) -> Column:
    """Number in [0, 1) of a pair, the same in every run."""
    h = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("id_a").cast("string"), F.col("id_b").cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def shares(parts: list[float], seed: int = 0) -> list[Column]:
    """Predicates that deal pairs out with the given probabilities, which must sum to 1."""
    if any(p < 0 for p in parts) or abs(sum(parts) - 1.0) > 1e-9:
        raise ValueError(f"{parts} are no probabilities that sum to 1")
    out, at = [], 0.0
    for i, p in enumerate(parts):
        top = 1.0 if i == len(parts) - 1 else at + p
        out.append((pair_bucket(seed) >= F.lit(at)) & (pair_bucket(seed) < F.lit(top)))
        at = top
    return out


@dataclass
class Hybrid:
    """Routes each pair to the matchers whose predicate it meets; the union of what they keep."""

    routes: list[tuple[Column, Matcher]] = field(default_factory=list)

    def add(self, predicate: Column, matcher: Matcher) -> Hybrid:
        self.routes.append((predicate, matcher))
        return self

    def __call__(self, pairs: DataFrame) -> DataFrame:
        kept = [m(pairs.where(p)) for p, m in self.routes]
        if not kept:
            return pairs.limit(0)
        out = kept[0]
        for k in kept[1:]:
            out = out.unionByName(k)
        return out.distinct()


@dataclass
class MatchSequence:
    """A join that makes candidates, then matchers in order. ``on_matches`` hears of every result."""

    join: Callable[..., DataFrame]
    matchers: list[Matcher] = field(default_factory=list)
    on_matches: list[Callable[[DataFrame], None]] = field(default_factory=list)

    def add(self, matcher: Matcher) -> MatchSequence:
        self.matchers.append(matcher)
        return self

    def run(self, a: DataFrame, b: DataFrame | None = None) -> DataFrame:
        pairs = self.join(a, b) if b is not None else self.join(a)
        for m in self.matchers:
            pairs = m(pairs)
        for f in self.on_matches:
            f(pairs)
        return pairs

    def describe(self) -> str:
        return " -> ".join(getattr(x, "__name__", type(x).__name__) for x in (self.join, *self.matchers))
