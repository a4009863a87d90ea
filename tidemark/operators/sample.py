"""Samples and working sets: a base table, and a clean and a dirty version of a sample of it.

Versions are immutable DataFrames. Every row has a ``hash``, derived from its key columns (and how often the key occurred
before) so that it is the same however often the plan runs, and a duplicate count ``dup``.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.parser import is_approximate, parse
from ..plans.scratch import materialize
from ..sources import catalog
from . import aqp


def row_hash(columns: list[str]) -> Column:
    """Hex MD5 of the columns' strings; nulls differ from empty strings."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]
    return F.md5(F.concat_ws("\x1f", *parts))


def bucket(key: str | Column, n: int) -> Column:
    """Bucket 0 to n - 1 of a key, by the first 32 bits of its MD5: the same in every engine."""
    c = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("long") % F.lit(n)


def with_row_ids(df: DataFrame, key: list[str] | None = None, unique: bool = False) -> DataFrame:
    """``hash``, ``dup`` = 1, then the columns. ``unique`` promises that ``key`` names a row, which saves numbering."""
    cols = key or df.columns
    h = row_hash(cols)
    if not unique:
        again = Window.partitionBy(*cols).orderBy(*cols)
        h = F.md5(F.concat_ws("\x1e", h, F.row_number().over(again).cast("string")))
    return df.select(h.alias("hash"), F.lit(1).alias("dup"), "*")


def _once(updates: DataFrame, value: str) -> DataFrame:
    """(_hash, _value, _has): one row a hash, so that an update never multiplies rows."""
    least = updates.groupBy(F.col("hash").alias("_hash")).agg(F.min(F.struct(F.col(value).alias("v"))).alias("lo"), F.max(F.struct(F.col(value).alias("v"))).alias("hi"))
    clash = F.raise_error(F.concat(F.lit("two different values for row "), F.col("_hash")))
    kind = dict(updates.dtypes)[value]
    return least.select("_hash", F.when(F.col("lo") == F.col("hi"), F.col("lo.v")).otherwise(clash.cast(kind)).alias("_value"), F.lit(True).alias("_has"))


def consistent(df: DataFrame, key: str, ratio: float) -> tuple[DataFrame, float]:
    """Rows whose key falls into bucket 0 of floor(1 / ratio), and the ratio this really is."""
    n = max(1, int(1.0 / ratio + 1e-9))
    return df.where(bucket(key, n) == 0), 1.0 / n


def uniform(rows: DataFrame, ratio: float, seed: int = 0) -> DataFrame:
    """Rows whose seeded hash falls below the ratio: each by itself, and the same ones however often the plan runs."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("hash"))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return rows.where(drawn < F.lit(ratio))


@dataclass(frozen=True)
class SampleMeta:
    base: str
    ratio: float
    key: str | None = None
    seed: int = 0


@dataclass
class WorkingSet:
    """Handle of a sample: ``clean`` is what cleaning changes, ``dirty`` what it is compared with."""

    spark: SparkSession
    meta: SampleMeta
    base: DataFrame
    clean: DataFrame
    dirty: DataFrame
    listeners: list = field(default_factory=list)

    @classmethod
    def create(cls, df: DataFrame, name: str = "sample", ratio: float = 1.0, key: str | None = None, seed: int = 0, row_key: list[str] | None = None, unique: bool = False, persist: bool = False) -> WorkingSet:
        """Samples ``df`` uniformly, or by a hash of ``key`` so that equal keys are in or out together."""
        base = with_row_ids(df, row_key, unique)
        if key is not None:
            sample, ratio = consistent(base, key, ratio)
        else:
            sample = uniform(base, ratio, seed) if ratio < 1.0 else base
        if persist:
            sample = materialize(sample, "sample")
        return cls(df.sparkSession, SampleMeta(name, ratio, key, seed), base, sample, sample)

    @property
    def ratio(self) -> float:
        return self.meta.ratio

    @property
    def columns(self) -> list[str]:
        return [c for c in self.clean.columns if c not in ("hash", "dup")]

    def attr(self, name: str, where: str | None = None) -> DataFrame:
        """(hash, attribute) of the clean sample."""
        rows = self.clean.where(where) if where else self.clean
        return rows.select("hash", name)

    def full(self) -> DataFrame:
        """The table that was sampled, without row ids."""
        return self.base.drop("hash", "dup")

    def column_index(self, name: str) -> int:
        """Place of a column in the clean sample, whatever the case; fails if there is none."""
        low = [c.lower() for c in self.clean.columns]
        if name.lower() not in low:
            raise KeyError(f"no column {name}; there are {', '.join(self.clean.columns)}")
        return low.index(name.lower())

    def update_attr(self, attr: str, updates: DataFrame, value: str = "value", missing: str = "null") -> WorkingSet:
        """Replaces ``attr`` by the value of the row's hash. A missing hash gives null, or is kept (``missing="keep"``).

        A hash may be named more than once with the same value; differing values fail when the result is read.
        """
        both = self.clean.join(_once(updates, value), self.clean["hash"] == F.col("_hash"), "left")
        out = F.when(F.col("_has"), F.col("_value")).otherwise(self.clean[attr]) if missing == "keep" else F.col("_value")
        self.clean = both.select(*[out.alias(c) if c == attr else self.clean[c] for c in self.clean.columns])
        return self._changed()

    def update_dup(self, updates: DataFrame, value: str = "dup") -> WorkingSet:
        """Replaces duplicate counts; 1 where there is none. Repeated hashes as for ``update_attr``."""
        both = self.clean.join(_once(updates, value), self.clean["hash"] == F.col("_hash"), "left")
        self.clean = both.select(*[F.coalesce(F.col("_value").cast("int"), F.lit(1)).alias("dup") if c == "dup" else self.clean[c] for c in self.clean.columns])
        return self._changed()

    def keep(self, hashes: DataFrame) -> WorkingSet:
        """Keeps the rows whose hash is named, each once."""
        self.clean = self.clean.join(hashes.select("hash"), "hash", "left_semi").select(*self.clean.columns)
        return self._changed()

    def replace(self, clean: DataFrame) -> WorkingSet:
        self.clean = clean
        return self._changed()

    def reset(self) -> WorkingSet:
        """Clean becomes dirty."""
        self.clean = self.dirty
        return self._changed()

    def rebase(self) -> WorkingSet:
        """Dirty becomes clean."""
        self.dirty = self.clean
        return self

    def snapshot(self) -> WorkingSet:
        """Writes the clean version, so that later plans start from it."""
        self.clean = materialize(self.clean, "clean")
        return self

    def cache(self) -> WorkingSet:
        self.clean = self.clean.persist()
        return self

    def write_back(self, path: str | None = None, table: str | None = None) -> DataFrame:
        """The whole cleaned table in its own columns, written to ``path`` or over the catalog table ``table``, if given.

        Only for samples of everything. The new rows are written aside before the table gives up its old ones.
        """
        if self.ratio < 1.0:
            raise ValueError(f"a sample of {self.ratio:g} of the rows cannot replace its table")
        out = self.clean.select(*[c for c in self.base.columns if c not in ("hash", "dup")])
        if table:
            return catalog.overwrite(out, table)
        if path:
            materialize(out, "write-back").write.mode("overwrite").parquet(path)
            return self.spark.read.parquet(path)
        return out

    def aqp(self, function: str, attr: str = "1", where: str | None = None, group: str | None = None, mode: str = "raw") -> DataFrame:
        """(group, agg, se). ``mode``: raw, normalized (the correction) or corrected."""
        if mode == "raw":
            return aqp.raw(self.clean, function, attr, where, group, self.ratio)
        if mode == "normalized":
            return aqp.normalized(self.clean, self.dirty, function, attr, where, group, self.ratio)
        if mode == "corrected":
            return aqp.corrected(self.base, self.clean, self.dirty, function, attr, where, group, self.ratio)
        raise ValueError(f"{mode} is not raw, normalized or corrected")

    def query(self, sql: str) -> DataFrame:
        """SQL in which ``$t`` is this sample; approximate statements are answered by the estimators."""
        if is_approximate(sql):
            s = parse(sql.replace("$t", "_t"))
            if s.source.strip() != "_t":
                raise ValueError("a working set answers queries on $t only; use a session for joins")
            return self.aqp(s.function, s.attr, s.where, s.group, s.mode)
        return self.spark.sql(sql.replace("$t", "{t}"), t=self.clean)

    def view(self, sql: str, ratio: float = 1.0, name: str = "view") -> WorkingSet:
        """A working set over a query's result."""
        out = self.query(sql)
        return WorkingSet.create(out.drop(*[c for c in ("hash", "dup") if c in out.columns]), name, ratio)

    def run(self, *algorithms) -> WorkingSet:
        """Applies cleaning algorithms, each a function of the working set."""
        for a in algorithms:
            a(self)
        return self

    def copy(self) -> WorkingSet:
        return replace(self, listeners=list(self.listeners))

    def _changed(self) -> WorkingSet:
        for f in list(self.listeners):
            f(self)
        return self
