"""Entity resolution of one attribute and de-duplication of records.

Resolution works on the distinct values: similar values are joined, matched, closed transitively, and each group's
values are replaced by one of them. A null value counts as an empty string.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import Tokenizer, white_space, word
from ..plans.scratch import materialize
from . import evaluate, simjoin
from .graph import connected_components
from .matchers import Hybrid, Matcher, by_similarity, shares
from .sample import WorkingSet


def merge_order(strategy: str) -> Column:
    """What orders the values (value, n) of a group; the least stands for it. Ties go to the smaller string."""
    name = strategy.strip().lower().replace(" ", "").replace("_", "")
    first = {"mostconcise": F.length("value").cast("long"), "leastconcise": -F.length("value").cast("long"), "mostfrequent": -F.col("n")}.get(name)
    if first is None:
        raise ValueError(f"{strategy!r} is not mostConcise, leastConcise or mostFrequent")
    return F.struct(first.alias("order"), F.col("value").alias("value"))


def canonical(values: DataFrame, edges: DataFrame, strategy: str) -> DataFrame:
    """(value, canonical) of every value. ``values`` is (id, value, n), ``edges`` (id_a, id_b)."""
    parts = connected_components(edges, "id_a", "id_b")
    placed = values.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    best = placed.groupBy("component").agg(F.min(merge_order(strategy))["value"].alias("canonical"))
    return placed.join(best, "component").select("value", "canonical")


@dataclass
class EntityResolution:
    """Algorithm on a working set: ``resolution(ws)``. Copies of it with other settings come from ``with_``."""

    attr: str
    similarity: str = "jaccard"
    threshold: float = 0.9
    weighted: bool = False
    strategy: str = "mostFrequent"
    tokenizer: Tokenizer = field(default_factory=word)
    matchers: list[Matcher] = field(default_factory=list)
    min_size: int = 0

    def with_(self, **changes) -> EntityResolution:
        return replace(self, **changes)

    def tune(self, ws: WorkingSet, binary: DataFrame) -> EntityResolution:
        """With the largest threshold that keeps together what the binary constraints say is the same."""
        found = evaluate.tune_threshold(ws, binary, self.attr, self.similarity, self.tokenizer)
        return self if found is None else self.with_(threshold=found)

    def tune_persistent(self, ws: WorkingSet, binary: DataFrame) -> EntityResolution:
        """With the threshold just below the first similarity at which different values merge."""
        found = evaluate.persistence_threshold(ws, binary, self.attr, self.similarity, self.tokenizer)
        return self if found is None else self.with_(threshold=found)

    def auto(self, ws: WorkingSet, binary: DataFrame, names: tuple[str, ...] = ("jaccard", "cosine")) -> EntityResolution:
        """With the metric, at its tuned threshold, that leaves the fewest candidates."""
        name, found = evaluate.choose_metric(ws, binary, self.attr, names)
        return self.with_(similarity=name, threshold=found)

    def values(self, df: DataFrame) -> DataFrame:
        """(id, value, n) of the attribute's distinct values."""
        value = F.coalesce(F.col(self.attr).cast("string"), F.lit(""))
        return df.groupBy(value.alias("value")).agg(F.count("*").alias("n")).select(F.md5("value").alias("id"), "value", "n")

    def candidates(self, values: DataFrame) -> DataFrame:
        """(id_a, id_b, sim, value_a, value_b) of similar values."""
        if self.similarity.lower() == "edit":
            pairs = simjoin.edit(values.select("id", "value"), id="id", cols=["value"], tokenizer=self.tokenizer, threshold=int(self.threshold))
        else:
            pairs = simjoin.prefix(values.select("id", "value"), id="id", cols=["value"], tokenizer=self.tokenizer, similarity_name=self.similarity, threshold=self.threshold, weighted=self.weighted, min_size=self.min_size)
        if not self.matchers:
            return pairs
        name = lambda s: values.select(F.col("id").alias(f"id_{s}"), F.col("value").alias(f"value_{s}"))
        return pairs.join(name("a"), "id_a").join(name("b"), "id_b")

    def mapping(self, df: DataFrame) -> DataFrame:
        """(value, canonical) of the attribute's values."""
        values = materialize(self.values(df), "values")
        pairs = self.candidates(values)
        for m in self.matchers:
            pairs = m(pairs)
        return canonical(values, pairs.select("id_a", "id_b"), self.strategy)

    def __call__(self, ws: WorkingSet) -> WorkingSet:
        return apply_mapping(ws, self.attr, self.mapping(ws.clean))


def apply_mapping(ws: WorkingSet, attr: str, mapping: DataFrame) -> WorkingSet:
    """Replaces the attribute by its canonical value."""
    new = mapping.select(F.col("value").alias("_value"), F.col("canonical").alias("_canonical"))
    clean = ws.clean
    both = clean.join(new, F.coalesce(clean[attr].cast("string"), F.lit("")) == new["_value"], "left")
    return ws.replace(both.select(*[F.coalesce("_canonical", clean[attr].cast("string")).alias(c) if c == attr else clean[c] for c in clean.columns]))


def short(attr: str, threshold: int = 1) -> EntityResolution:
    """For short attributes: edit distance on white-space tokens, the longest value stands."""
    return EntityResolution(attr, "edit", threshold, False, "leastConcise", white_space())


def long(attr: str, threshold: float = 0.9, weighted: bool = True) -> EntityResolution:
    """For long attributes: Jaccard of words, the most frequent value stands."""
    return EntityResolution(attr, "jaccard", threshold, weighted, "mostFrequent", word())


def active(attr: str, matcher: Matcher, threshold: float = 0.9, weighted: bool = True) -> EntityResolution:
    """As ``long``, but a learning matcher decides on the candidates."""
    return long(attr, threshold, weighted).with_(matchers=[matcher])


def hybrid(attr: str, low: float, high: float, matcher: Matcher, weighted: bool = True, crowd_ratio: float = 0.5, seed: int = 0) -> EntityResolution:
    """Candidates from ``low`` on; a share of ``crowd_ratio`` goes to the learning matcher, the others match from ``high`` on."""
    auto, crowd = shares([1.0 - crowd_ratio, crowd_ratio], seed)
    route = Hybrid().add(auto, by_similarity(F.col("sim"), high)).add(crowd, matcher)
    return long(attr, low, weighted).with_(matchers=[route])


class IncrementalResolution:
    """Resolution whose matches arrive in batches: edges only add up, so a batch that comes twice changes nothing."""

    def __init__(self, ws: WorkingSet, attr: str, strategy: str = "mostFrequent"):
        self.ws, self.attr, self.strategy = ws, attr, strategy
        self.start = ws.clean
        self.values = materialize(EntityResolution(attr).values(ws.clean), "values")
        self.edges = self.values.select(F.col("id").alias("id_a"), F.col("id").alias("id_b")).limit(0)

    def add(self, edges: DataFrame) -> WorkingSet:
        """Takes (id_a, id_b) in and rewrites the clean sample, which tells its listeners."""
        self.edges = materialize(self.edges.unionByName(edges.select("id_a", "id_b")).distinct(), "edges")
        self.ws.clean = self.start
        return apply_mapping(self.ws, self.attr, canonical(self.values, self.edges, self.strategy))


@dataclass
class RecordDeduplication:
    """Counts, for each sampled row, itself and the similar other rows of the full table, as ``dup``."""

    cols: list[str]
    threshold: float = 0.9
    weighted: bool = True
    similarity: str = "jaccard"
    tokenizer: Tokenizer = field(default_factory=word)

    def counts(self, sample: DataFrame, full: DataFrame) -> DataFrame:
        """(hash, dup) of the sampled rows with a similar other row."""
        pairs = simjoin.join(sample.select("hash", *self.cols), full.select("hash", *self.cols), self.similarity, id="hash", cols=self.cols, tokenizer=self.tokenizer, threshold=self.threshold, weighted=self.weighted)
        return pairs.groupBy(F.col("id_a").alias("hash")).agg((F.count("*") + 1).cast("int").alias("dup"))

    def __call__(self, ws: WorkingSet) -> WorkingSet:
        return ws.update_dup(self.counts(ws.clean, ws.base))
