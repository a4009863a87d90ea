"""Quality of cleaning against constraints, and tuners of thresholds and metrics.

Unary constraints are (hash, attr, value); binary ones (hash1, hash2, attr, same).
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import edit_distance, similarity
from ..functions.tokens import Tokenizer, tokenize, word
from ..plans.scratch import materialize
from . import simjoin
from .active import ActiveLearner, confusion, pair_features, svm
from .sample import WorkingSet


def _cells(df: DataFrame, attrs: list[str]) -> DataFrame:
    """(hash, attr, cell) of the named columns."""
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("cell")) for a in attrs]))
    return df.select("hash", pairs.alias("c")).select("hash", "c.attr", "c.cell")


def unary_accuracy(df: DataFrame, constraints: DataFrame) -> DataFrame:
    """(hits, total, accuracy) over the constraints whose row is in the table."""
    attrs = [r.attr for r in constraints.select("attr").distinct().collect() if r.attr in df.columns]
    met = constraints.join(_cells(df, attrs), ["hash", "attr"]) if attrs else constraints.withColumn("cell", F.lit(None).cast("string")).limit(0)
    hits = met.agg(F.coalesce(F.sum(F.col("cell").eqNullSafe(F.col("value")).cast("long")), F.lit(0)).alias("hits"), F.count("*").alias("total"))
    return hits.withColumn("accuracy", F.coalesce(F.col("hits") / F.expr("nullif(cast(total as double), 0)"), F.lit(0.0)))


def binary_accuracy(df: DataFrame, constraints: DataFrame) -> DataFrame:
    """(hits, total, accuracy): whether two rows' values are equal just where they should be."""
    attrs = [r.attr for r in constraints.select("attr").distinct().collect() if r.attr in df.columns]
    if not attrs:
        met = constraints.withColumns({"x": F.lit(None).cast("string"), "y": F.lit(None).cast("string")}).limit(0)
    else:
        cells = _cells(df, attrs)
        x = cells.select(F.col("hash").alias("hash1"), "attr", F.col("cell").alias("x"))
        y = cells.select(F.col("hash").alias("hash2"), "attr", F.col("cell").alias("y"))
        met = constraints.join(x, ["hash1", "attr"]).join(y, ["hash2", "attr"])
    hits = met.agg(F.coalesce(F.sum((F.col("x").eqNullSafe(F.col("y")) == F.col("same")).cast("long")), F.lit(0)).alias("hits"), F.count("*").alias("total"))
    return hits.withColumn("accuracy", F.coalesce(F.col("hits") / F.expr("nullif(cast(total as double), 0)"), F.lit(0.0)))


def from_groups(groups: DataFrame, attr: str, group: str = "group") -> DataFrame:
    """Binary constraints from (hash, group): every two rows of a table of known truth."""
    a = groups.select(F.col("hash").alias("hash1"), F.col(group).alias("g1"))
    b = groups.select(F.col("hash").alias("hash2"), F.col(group).alias("g2"))
    return a.crossJoin(b).filter("hash1 <> hash2").select("hash1", "hash2", F.lit(attr).alias("attr"), (F.col("g1") == F.col("g2")).alias("same"))


@dataclass
class Evaluator:
    """Runs algorithms, each on the sample as it was, and measures them."""

    ws: WorkingSet
    unary: DataFrame | None = None
    binary: DataFrame | None = None

    def evaluate(self, algorithms: dict[str, Callable]) -> dict[str, dict]:
        out = {}
        for name, algorithm in algorithms.items():
            self.ws.reset()
            began = time.monotonic()
            algorithm(self.ws)
            self.ws.snapshot()
            spent = time.monotonic() - began
            score = lambda f, c: f(self.ws.clean, c).first().accuracy if c is not None else None
            out[name] = {"unary": score(unary_accuracy, self.unary), "binary": score(binary_accuracy, self.binary), "seconds": spent}
        self.ws.reset()
        return out


def bought_constraints(ws: WorkingSet, attr: str, learner: ActiveLearner, pairs: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Binary constraints from labels that an active learner buys for candidate pairs (hash1, hash2) of the clean sample.

    Only bought labels count, not what the model predicts for other pairs.
    """
    cells = ws.clean.select("hash", F.col(attr).cast("string").alias("v"))
    a, b = (cells.select(F.col("hash").alias(f"hash{i}"), F.col("v").alias(f"value_{s}")) for i, s in ((1, "a"), (2, "b")))
    both = pairs.select("hash1", "hash2").join(a, "hash1").join(b, "hash2")
    points = materialize(pair_features(both.withColumnsRenamed({"hash1": "id_a", "hash2": "id_b"}), metrics or ["Levenshtein", "JaroWinkler"]), "points")
    bought = learner.fit(points).labelled
    return points.join(bought.select("id", "label"), "id").select(F.col("id_a").alias("hash1"), F.col("id_b").alias("hash2"), F.lit(attr).alias("attr"), (F.col("label") > 0.5).alias("same"))


def _value(name: str, a: Column, b: Column) -> Column:
    return edit_distance(a, b).cast("double") if name == "edit" else similarity(name, a, b)


def constrained_similarities(ws: WorkingSet, binary: DataFrame, attr: str, name: str = "jaccard", tokenizer: Tokenizer | None = None) -> DataFrame:
    """(hash1, hash2, same, sim) of the attribute's binary constraints."""
    cells = ws.clean.select("hash", tokenize(tokenizer or word(), attr).alias("tokens"))
    a, b = cells.select(F.col("hash").alias("hash1"), F.col("tokens").alias("ta")), cells.select(F.col("hash").alias("hash2"), F.col("tokens").alias("tb"))
    return binary.filter(F.col("attr") == attr).join(a, "hash1").join(b, "hash2").select("hash1", "hash2", "same", _value(name, F.col("ta"), F.col("tb")).alias("sim"))


def _forest(edges: list[tuple[float, str, str]]) -> list[float]:
    """Weights of the spanning forest's edges, taken in the given order."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for w, a, b in edges:
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            out.append(w)
    return out


def tune_threshold(ws: WorkingSet, binary: DataFrame, attr: str, name: str = "jaccard", tokenizer: Tokenizer | None = None) -> float | None:
    """The largest threshold at which the pairs that must match stay connected: the weakest edge of their maximum
    spanning forest (for ``edit`` the largest of the minimum one). Labelled pairs only, so the driver holds few."""
    rows = constrained_similarities(ws, binary.filter("same"), attr, name, tokenizer).collect()
    distance = name == "edit"
    kept = _forest(sorted(((r.sim, r.hash1, r.hash2) for r in rows if distance or r.sim > 1e-6), reverse=not distance))
    return (max if distance else min)(kept) if kept else None


def merge_heights(ws: WorkingSet, binary: DataFrame, attr: str, name: str = "jaccard", tokenizer: Tokenizer | None = None) -> list[float]:
    """Distances (1 - similarity) at which single linkage merges the constrained rows: where components die."""
    rows = constrained_similarities(ws, binary, attr, name, tokenizer).collect()
    return _forest(sorted((1.0 - r.sim, r.hash1, r.hash2) for r in rows))


def persistence_threshold(ws: WorkingSet, binary: DataFrame, attr: str, name: str = "jaccard", tokenizer: Tokenizer | None = None) -> float | None:
    """1 less the first distance above 0 at which components merge."""
    heights = [h for h in merge_heights(ws, binary, attr, name, tokenizer) if h > 0]
    return 1.0 - min(heights) if heights else None


def candidate_count(df: DataFrame, attr: str, threshold: float, name: str = "jaccard", tokenizer: Tokenizer | None = None, id: str = "hash") -> int:
    """Ordered pairs of rows, a row with itself too, whose similarity is above the threshold.

    Equal values count as one with a weight. Values without a token have similarity 0 with all.
    """
    value = F.coalesce(F.col(attr).cast("string"), F.lit(""))
    values = materialize(df.groupBy(value.alias("value")).agg(F.count("*").alias("n")).select(F.md5("value").alias("id"), "value", "n", tokenize(tokenizer or word(), "value").alias("tokens")), "values")
    alike = F.size("tokens") > threshold if name == "overlap" else (F.size("tokens") > 0) & F.lit(1.0 > threshold)
    own = values.filter(alike)
    same = own.agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).alias("s")).first().s
    pairs = simjoin.prefix(values.select("id", "value"), id="id", cols=["value"], tokenizer=tokenizer, similarity_name=name, threshold=threshold).filter(F.col("sim") > threshold)
    n = lambda s: values.select(F.col("id").alias(f"id_{s}"), F.col("n").alias(f"n_{s}"))
    met = pairs.join(n("a"), "id_a").join(n("b"), "id_b").agg(F.coalesce(F.sum(F.col("n_a") * F.col("n_b")), F.lit(0)).alias("s")).first().s
    return int(same + 2 * met)


def choose_metric(ws: WorkingSet, binary: DataFrame, attr: str, names: tuple[str, ...] = ("jaccard", "cosine")) -> tuple[str, float]:
    """The metric, at its tuned threshold, with the fewest candidates."""
    tuned = {n: tune_threshold(ws, binary, attr, n) for n in names}
    counts = {n: candidate_count(ws.clean, attr, t, n) for n, t in tuned.items() if t is not None}
    if not counts:
        raise ValueError("no constraint ties rows together")
    best = min(counts, key=lambda n: (counts[n], names.index(n)))
    return best, tuned[best]


def matcher_rates(ws: WorkingSet, binary: DataFrame, attr: str, metrics: list[str]) -> tuple[float, float]:
    """False negative and false positive rates, on the constrained pairs, of a linear model trained on them."""
    cells = ws.clean.select("hash", F.col(attr).cast("string").alias("v"))
    pairs = binary.filter(F.col("attr") == attr).join(cells.select(F.col("hash").alias("hash1"), F.col("v").alias("value_a")), "hash1").join(cells.select(F.col("hash").alias("hash2"), F.col("v").alias("value_b")), "hash2")
    rows = materialize(pair_features(pairs.select(F.col("hash1").alias("id_a"), F.col("hash2").alias("id_b"), "value_a", "value_b", F.col("same").cast("double").alias("label")), metrics).select("id", "features", "label"), "constrained")
    c = confusion(svm(reg=0.01).fit(rows).transform(rows)).first()
    return c.fn / max(1, c.fn + c.tp), c.fp / max(1, c.fp + c.tn)
