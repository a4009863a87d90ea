"""Estimators of grouped SUM, COUNT and AVG from samples, each as one lazy plan of (group, agg, se).

``raw`` scales a cleaned sample up, each row divided by its duplicate count. ``normalized`` estimates the correction from
the dirty to the clean sample: dirty minus clean for SUM and AVG, clean minus dirty for COUNT. Standard errors follow the
central limit theorem, with k the rows of the whole sample. AVG is over all rows of a group, those that fail the
predicate counting as 0. A group without a row that counts has the standard error 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import number

ONE = "1"


def indicator(where: str | Column | None) -> Column:
    """1.0 where the predicate holds, else 0.0."""
    if where is None or (isinstance(where, str) and not where.strip()):
        return F.lit(1.0)
    return F.when(F.expr(where) if isinstance(where, str) else where, 1.0).otherwise(0.0)


def conjunction(*where: str | None) -> str | None:
    """The predicates that are given, in parentheses, all required."""
    given = [f"({w})" for w in where if w and w.strip()]
    return " AND ".join(given) or None


def _group(group: str | None) -> Column:
    return F.expr(group).cast("string") if group else F.lit(ONE)


def _size(df: DataFrame) -> DataFrame:
    return F.broadcast(df.agg(F.count("*").cast("double").alias("_k")))


def _grouped(rows: DataFrame) -> DataFrame:
    """What the estimators need of each group ``_g``: sum, mean, variance, rows that count and rows of ``_x``."""
    hits = F.sum(F.when(F.col("_x") != 0, 1.0).otherwise(0.0))
    return rows.groupBy("_g").agg(F.sum("_x").alias("_sum"), F.avg("_x").alias("_avg"), F.var_samp("_x").alias("_var"), hits.alias("_c"), F.count("*").cast("double").alias("_n"))


def _rows(groups: DataFrame) -> DataFrame:
    """All groups' rows together.

    The sum hangs on every column by a remainder that is always 0, so that no column is pruned from it and Spark reads the
    groups' exchange once for both uses: the sample, or the whole join, runs once.
    """
    nothing = F.pmod(F.xxhash64(*groups.columns), F.lit(1)).cast("double")
    return F.broadcast(groups.agg(F.sum(F.col("_n") + nothing).alias("_k")))


def scaled_variance(ratio: float) -> Column:
    """Squared standard error of a group's scaled-up sum: selectivity part and spread part, over the sample size."""
    c, k = F.col("_c"), F.col("_k")
    n = k / F.lit(float(ratio))
    p = c / F.nullif(k, F.lit(0.0))
    m = F.col("_sum") / F.nullif(c, F.lit(0.0))
    return (p * (1 - p) * n * n * m * m + n * n * F.col("_var")) / F.nullif(k, F.lit(0.0))


def count_delta_se(c: Column, k: Column, ratio: float) -> Column:
    """Standard error of a count correction ``c`` from a sample of ``k`` rows; 0 for a negative share."""
    n = k / F.lit(float(ratio))
    share = c / F.nullif(n, F.lit(0.0))
    return n * F.sqrt(F.greatest(F.lit(0.0), (1 - share) * share)) / F.sqrt(F.nullif(k, F.lit(0.0)))


def _as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _copies(df: DataFrame, dup: str | None) -> Column:
    return F.coalesce(F.col(dup).cast("double"), F.lit(1.0)) if dup and dup in df.columns else F.lit(1.0)


def _valued(sample: DataFrame, function: str, attr: str, where, group: str | None, dup: str | None) -> DataFrame:
    """Each row's group ``_g`` and what it adds, ``_x``."""
    value = F.lit(1.0) if function == "count" else F.expr(attr).cast("double")
    return sample.select((value * indicator(where) / _copies(sample, dup)).alias("_x"), _group(group).alias("_g"))


def _estimate(groups: DataFrame, size: DataFrame, function: str, ratio: float) -> DataFrame:
    """(group, agg, se) of aggregated groups; ``size`` has the sample's rows as ``_k``."""
    if function == "avg":
        agg, se = F.col("_avg"), F.sqrt(F.col("_var") / F.col("_k"))
    else:
        agg, se = F.col("_sum") / F.lit(float(ratio)), F.sqrt(scaled_variance(ratio))
    return groups.join(size).select(F.col("_g").alias("group"), agg.alias("agg"), F.coalesce(se, F.lit(0.0)).alias("se"))


def raw(sample: DataFrame, function: str, attr: str = ONE, where: str | None = None, group: str | None = None, ratio: float = 1.0, dup: str | None = "dup") -> DataFrame:
    """Estimate from one sample of ``ratio`` of all rows, in one pass."""
    if function not in ("avg", "sum", "count"):
        raise ValueError(f"{function} is not avg, sum or count")
    groups = _grouped(_valued(sample, function, attr, where, group, dup))
    return _estimate(groups, _rows(groups), function, ratio)


def normalized(clean: DataFrame, dirty: DataFrame, function: str, attr: str = ONE, where: str | None = None, group: str | None = None, ratio: float = 1.0, key: str | Column = "hash", dup: str | None = "dup") -> DataFrame:
    """Correction estimated from the paired samples. Groups are the clean side's; values that are no numbers count as 0.

    The predicate is evaluated on each side by itself; for AVG it selects the pairs by the clean side.
    """
    if function == "count":
        after, before = (_grouped(_valued(x, "count", ONE, where, group, dup)) for x in (clean, dirty))
        size = _rows(before)
        name = lambda c: F.lower(F.trim(F.col(c)))
        old = before.select(F.col("_g").alias("_h"), F.col("_sum").alias("_before"))
        both = after.join(old, name("_g") == name("_h")).select(F.col("_g").alias("group"), ((F.col("_sum") - F.col("_before")) / F.lit(float(ratio))).alias("agg"))
        return both.join(size).select("group", "agg", F.coalesce(count_delta_se(F.col("agg"), F.col("_k"), ratio), F.lit(0.0)).alias("se"))
    value = lambda: number(F.expr(attr).cast("string"))
    hit = indicator(where)
    left = clean.select(_as_column(key).alias("_key"), _group(group).alias("_g"), value().alias("_c"), hit.alias("_ic"), _copies(clean, dup).alias("_d"))
    right = dirty.select(_as_column(key).alias("_key"), value().alias("_v"), hit.alias("_id"))
    both = left.join(right, "_key", "left").withColumns({"_v": F.coalesce("_v", F.lit(0.0)), "_id": F.coalesce("_id", F.lit(0.0))})
    if function == "avg":
        both = both.filter("_ic = 1.0") if where else both
        rows = both.withColumn("_x", F.col("_v") - F.col("_c") / F.col("_d"))
    elif function == "sum":
        rows = both.withColumn("_x", F.col("_v") * F.col("_id") - F.col("_c") * F.col("_ic") / F.col("_d"))
    else:
        raise ValueError(f"{function} is not avg, sum or count")
    return _estimate(_grouped(rows.select("_g", "_x")), _size(dirty), function, ratio)


def corrected(full_dirty: DataFrame, clean: DataFrame, dirty: DataFrame, function: str, attr: str = ONE, where: str | None = None, group: str | None = None, ratio: float = 1.0, key: str = "hash") -> DataFrame:
    """The full dirty table's answer, corrected by the samples' difference, with the correction's standard error."""
    fix = normalized(clean, dirty, function, attr, where, group, ratio, key)
    truth = raw(full_dirty, function, attr, where, group, 1.0, dup=None).select(F.col("group").alias("_group"), F.col("agg").alias("_full"))
    sign = 1 if function == "count" else -1
    return truth.join(fix, truth["_group"].eqNullSafe(fix["group"]), "left").select(F.col("_group").alias("group"), (F.col("_full") + sign * F.coalesce("agg", F.lit(0.0))).alias("agg"), F.coalesce("se", F.lit(0.0)).alias("se"))


def joined(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "left", names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Samples joined for a query over both, under their names: a column that both have is told apart by its qualifier.

    ``hash`` and ``dup`` are the left one's; the right one's row id is ``_right_hash``.
    """
    l, r = names
    ids = [F.col("hash").alias("_right_hash")] if "hash" in right.columns else []
    other = right.select(*[c for c in right.columns if c not in ("hash", "dup")], *ids).alias(r)
    return left.alias(l).join(other, F.col(f"`{l}`.`{left_key}`") == F.col(f"`{r}`.`{right_key}`"), how)


def joined_key() -> Column:
    """Names a row of ``joined``: a left row that meets several right ones pairs with itself once for each."""
    return F.concat_ws("/", F.col("hash"), F.coalesce(F.col("_right_hash"), F.lit("")))
