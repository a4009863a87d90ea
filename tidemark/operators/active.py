"""Active learning over DataFrames (id, features, ...): models, point selectors, labels and the loop."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.ml.classification import LinearSVC, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor, RegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import features as metric_features
from ..plans.scratch import materialize
from .sample import bucket


class LabelSource(Protocol):
    """Something that labels points: (id, label) for the ids of ``points``."""

    def label(self, points: DataFrame) -> DataFrame: ...


@dataclass
class TableLabels:
    """Labels looked up in a table (id, label)."""

    labels: DataFrame

    def label(self, points: DataFrame) -> DataFrame:
        return points.select("id").join(self.labels.select("id", F.col("label").cast("double").alias("label")), "id")


def MapLabels(spark, known: dict) -> TableLabels:  # noqa: N802
    """Labels from a small map."""
    return TableLabels(spark.createDataFrame(list(known.items()), "id string, label double"))


def labelled(points: DataFrame, source: LabelSource) -> DataFrame:
    """The points with their labels; fails if one has none."""
    got = materialize(points.join(source.label(points), "id", "left"), "labelled")
    missing = got.filter("label IS NULL").count()
    if missing:
        raise LookupError(f"{missing} points got no label")
    return got


def svm(iterations: int = 100, reg: float = 1.0) -> LinearSVC:
    return LinearSVC(maxIter=iterations, regParam=reg, featuresCol="features", labelCol="label")


def forest(trees: int = 100, depth: int = 4, bins: int = 100, seed: int = 0) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=bins, seed=seed, featuresCol="features", labelCol="label")


def forest_regressor(trees: int = 100, depth: int = 4, bins: int = 100, seed: int = 0) -> RandomForestRegressor:
    """A forest whose prediction is the mean label of its leaves, between 0 and 1."""
    return RandomForestRegressor(numTrees=trees, maxDepth=depth, maxBins=bins, seed=seed, featuresCol="features", labelCol="label")


def _least(points: DataFrame, by: Column, n: int, ties: bool) -> DataFrame:
    """The n rows with the least value; with ``ties`` also those equal to the last of them."""
    ranked = points.withColumn("_by", by)
    first = ranked.orderBy("_by", "id").limit(n)
    if not ties:
        return first.drop("_by")
    cutoff = first.agg(F.max("_by").alias("_cut"))
    return ranked.join(F.broadcast(cutoff)).filter("_by <= _cut").drop("_by", "_cut")


def margin_selector(points: DataFrame, n: int, model) -> DataFrame:
    """Points nearest to the separating plane through the origin, ties included."""
    w = F.array(*[F.lit(float(x)) for x in model.coefficients])
    dot = F.aggregate(F.zip_with(vector_to_array("features"), w, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return _least(points, F.abs(dot), n, True)


def uncertainty_selector(points: DataFrame, n: int, model) -> DataFrame:
    """Points on whose class the trees disagree most (largest p (1 - p)); random ones if they agree on all."""
    p = F.col("prediction") if isinstance(model, RegressionModel) else vector_to_array("probability")[1]
    scored = model.transform(points).withColumn("_doubt", F.round(p * (1 - p), 12)).select(*points.columns, "_doubt")
    return _least(scored, F.struct(-F.col("_doubt"), bucket(F.col("id"), 1 << 31)), n, False).drop("_doubt")


@dataclass
class Step:
    """A model and the points it was trained on."""

    model: object
    labelled: DataFrame
    spent: int


@dataclass
class ActiveLearner:
    """Trains on a bootstrap, then buys the most telling labels in batches until the budget is spent.

    The points asked for are at most the budget (and ties), whatever the size of the table; the table itself is only
    scored and filtered.
    """

    estimator: object
    selector: Callable[[DataFrame, int, object], DataFrame]
    source: LabelSource
    budget: int = 10
    batch: int = 5
    bootstrap: int = 10
    seed: int = 0
    on_model: list[Callable[[Step], None]] = field(default_factory=list)
    on_labels: list[Callable[[DataFrame], None]] = field(default_factory=list)

    def steps(self, points: DataFrame, known: DataFrame | None = None) -> Iterator[Step]:
        points = points.select("id", "features")
        have = known.select("id", "features", "label") if known is not None else points.withColumn("label", F.lit(None).cast("double")).limit(0)
        have, spent = materialize(have, "known"), 0
        rest = points.join(have.select("id"), "id", "left_anti")
        n = have.count()
        if n < self.bootstrap:
            order = F.md5(F.concat_ws("/", F.lit(str(self.seed)), F.col("id").cast("string")))
            have, rest, got = self._buy(have, rest, rest.orderBy(order, "id").limit(self.bootstrap - n))
            spent += got
        while True:
            step = Step(self.estimator.fit(have), have, spent)
            for f in self.on_model:
                f(step)
            yield step
            want = min(self.batch, self.budget - spent)
            if want <= 0:
                return
            have, rest, got = self._buy(have, rest, self.selector(rest, want, step.model))
            if not got:
                return
            spent += want

    def _buy(self, have: DataFrame, rest: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        new = labelled(points.select("id", "features"), self.source)
        for f in self.on_labels:
            f(new.select("id", "label"))
        have = materialize(have.unionByName(new.select("id", "features", "label")), "known")
        return have, rest.join(new.select("id"), "id", "left_anti"), new.count()

    def fit(self, points: DataFrame, known: DataFrame | None = None) -> Step:
        """The last step."""
        last = None
        for last in self.steps(points, known):
            pass
        return last


def train_error(model, rows: DataFrame) -> float:
    """Share of the labelled rows that the model gets wrong."""
    out = model.transform(rows).agg(F.avg((F.col("prediction") != F.col("label")).cast("double")).alias("e")).first()
    return out.e or 0.0


def confusion(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: tp, tn, fp, fn, error, precision, recall, f1 (0 where undefined)."""
    n = lambda a, b: F.sum(F.when((F.col(label) == a) & (F.col(prediction) == b), 1).otherwise(0)).cast("long")
    t = rows.agg(n(1, 1).alias("tp"), n(0, 0).alias("tn"), n(0, 1).alias("fp"), n(1, 0).alias("fn"))
    part = lambda a, b: F.coalesce(F.expr(f"({a}) / nullif(cast({b} as double), 0)"), F.lit(0.0))
    return t.select("*", part("fp + fn", "tp + tn + fp + fn").alias("error"), part("tp", "tp + fp").alias("precision"), part("tp", "tp + fn").alias("recall"), part("2 * tp", "2 * tp + fp + fn").alias("f1"))


def pair_features(pairs: DataFrame, names: list[str], left: str = "value_a", right: str = "value_b") -> DataFrame:
    """(id, features, ...) of pairs; the id names both sides."""
    values = metric_features(names, [F.col(left)], [F.col(right)])
    return pairs.withColumns({"id": F.concat_ws("/", F.col("id_a").cast("string"), F.col("id_b").cast("string")), "features": array_to_vector(values)})


@dataclass
class LearnedSimilarity:
    """Similarity of two values that a learner works out from base metrics: the current model's prediction."""

    learner: ActiveLearner
    metrics: list[str] = field(default_factory=lambda: ["Levenshtein", "JaroWinkler"])
    model: object = None
    on_model: list[Callable[[object], None]] = field(default_factory=list)

    def train(self, pairs: DataFrame, known: DataFrame | None = None) -> LearnedSimilarity:
        """Learns from pairs (id_a, id_b, value_a, value_b), whose labels the learner buys; every model is heard of."""
        points = materialize(pair_features(pairs, self.metrics), "pairs")
        for step in self.learner.steps(points, known):
            self.update(step.model)
        return self

    def update(self, model) -> None:
        self.model = model
        for f in self.on_model:
            f(model)

    def similarity(self, pairs: DataFrame) -> DataFrame:
        """The pairs with ``sim``."""
        if self.model is None:
            raise ValueError("there is no model yet: train first")
        return self.model.transform(pair_features(pairs, self.metrics)).select(*pairs.columns, F.col("prediction").cast("double").alias("sim"))

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """As a matcher: the pairs whose similarity is above a half."""
        return self.similarity(pairs).where("sim > 0.5").drop("sim")


@dataclass
class ActiveMatcher:
    """Matcher that learns which pairs match: labels bought so far override the model. ``passthrough`` keeps labelled ones only."""

    learner: ActiveLearner
    metrics: list[str] = field(default_factory=lambda: ["Levenshtein", "JaroWinkler"])
    passthrough: bool = False
    on_matches: list[Callable[[DataFrame], None]] = field(default_factory=list)

    def __call__(self, pairs: DataFrame) -> DataFrame:
        points = materialize(pair_features(pairs, self.metrics), "pairs")
        out = None
        for step in self.learner.steps(points):
            bought = step.labelled.select("id", F.col("label").alias("_label"))
            if self.passthrough:
                scored = points.join(bought, "id").withColumn("_value", F.col("_label"))
            else:
                scored = step.model.transform(points).join(bought, "id", "left").withColumn("_value", F.coalesce("_label", "prediction"))
            out = scored.where("_value > 0.5").select(*pairs.columns)
            for f in self.on_matches:
                f(out)
        return out


def compare_with_random(points: DataFrame, truth: DataFrame, learner: ActiveLearner, seed: int = 0) -> list[dict]:
    """Errors, on a fifth held out, of each active model and of one trained on as many points picked at random."""
    held = bucket(F.concat_ws("/", F.lit(f"held{seed}"), F.col("id").cast("string")), 5) == 0
    train, test = points.where(~held), points.where(held).join(truth, "id")
    out = []
    for step in learner.steps(train):
        n = step.labelled.count()
        order = F.md5(F.concat_ws("/", F.lit(f"random{seed}"), F.col("id").cast("string")))
        passive = learner.estimator.fit(train.join(truth, "id").orderBy(order, "id").limit(n))
        out.append({"labels": n, "active": train_error(step.model, test), "random": train_error(passive, test)})
    return out
