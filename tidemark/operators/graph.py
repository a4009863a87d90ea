"""Connected components on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id that an edge names; the component is its smallest id.

    Each round points every id to the least of itself and its neighbours, follows the pointers three times over,
    and replaces ids by what they reach; edges within a component vanish, until none is left. Neighbours
    are reduced by a pre-aggregated minimum and the joins read written tables, so an id with very many
    edges is split like any skewed key. Edges with a null end are left out; loops give a component of one.
    """
    named = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    left = materialize(named.distinct(), "edges")
    maps: list[DataFrame] = []
    while not left.isEmpty():
        ends = left.select(F.col("a").alias("id"), F.least("a", "b").alias("to")).unionByName(left.select(F.col("b").alias("id"), F.least("a", "b").alias("to")))
        to = materialize(ends.groupBy("id").agg(F.min("to").alias("to")), "pointers")
        for _ in range(2):
            far = to.select(F.col("id").alias("at"), F.col("to").alias("far"))
            to = materialize(to.join(far, F.col("to") == F.col("at"), "left").select("id", F.coalesce("far", "to").alias("to")), "pointers")
        maps.append(to)
        pa, pb = to.select(F.col("id").alias("a"), F.col("to").alias("to_a")), to.select(F.col("id").alias("b"), F.col("to").alias("to_b"))
        moved = left.join(pa, "a").join(pb, "b").filter("to_a <> to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        left = materialize(moved.distinct(), "edges")
    if not maps:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out = maps[0].select("id", F.col("to").alias("component"))
    for m in maps[1:]:
        step = m.select(F.col("id").alias("at"), F.col("to").alias("far"))
        out = materialize(out.join(step, F.col("component") == F.col("at"), "left").select("id", F.coalesce("far", "component").alias("component")), "components")
    return out
