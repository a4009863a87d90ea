"""Entry point: named working sets and SQL over them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .operators import aqp
from .operators.sample import SampleMeta, WorkingSet
from .plans.parser import ParseError, is_approximate, parse
from .plans.scratch import cleanup
from .sources import catalog
from .sources.loaders import read_csv

_JOIN = re.compile(r"^\s*(\w+)\s+join\s+(\w+)\s+on\s+(\w+)\.(\w+)\s*=\s*(\w+)\.(\w+)\s*$", re.I)


class Session:
    """Working sets by name. ``sql`` answers approximate statements from them and hands everything else to Spark."""

    def __init__(self, spark: SparkSession):
        self.spark, self.sets, self.tables = spark, {}, []

    def sample(self, table: DataFrame | str, name: str, ratio: float = 1.0, key: str | None = None, seed: int = 0, **options) -> WorkingSet:
        df = self.spark.table(table) if isinstance(table, str) else table
        self.sets[name] = ws = WorkingSet.create(df, name, ratio, key, seed, **options)
        return ws

    def load_csv(self, path: str, schema: list[tuple[str, str]] | str, name: str, ratio: float = 1.0, **options) -> WorkingSet:
        return self.sample(read_csv(self.spark, path, schema, **options), name, ratio)

    def get(self, name: str) -> WorkingSet:
        if name not in self.sets:
            raise KeyError(f"no sample {name}; there are {', '.join(self.sets) or 'none'}")
        return self.sets[name]

    def sql(self, statement: str) -> DataFrame:
        if not is_approximate(statement):
            for name, ws in self.sets.items():
                ws.clean.createOrReplaceTempView(name)
            return self.spark.sql(statement.strip().rstrip(";"))
        s = parse(statement)
        if m := _JOIN.match(s.source):
            return self._join(s, *m.groups())
        if not re.fullmatch(r"\w+", s.source):
            raise ParseError(f"{s.source!r} is neither a sample nor an equi-join of two")
        return self.get(s.source).aqp(s.function, s.attr, s.where, s.group, s.mode)

    def _join(self, s, left: str, right: str, t1: str, c1: str, t2: str, c2: str) -> DataFrame:
        """Fact sample joined with another one; the ratio and the duplicate counts are the fact's.

        Names are resolved by Spark, qualified ones by their sample; one that both have needs its qualifier.
        """
        if {t1, t2} != {left, right} or left == right:
            raise ParseError(f"the join names {t1} and {t2}, not {left} and {right}")
        k1, k2 = (c1, c2) if t1 == left else (c2, c1)
        a, b = self.get(left), self.get(right)
        together = (a.meta.key, b.meta.key) == (k1, k2) and abs(a.ratio - b.ratio) < 1e-12
        if b.ratio < 1.0 and not together:
            raise ValueError(f"{right} holds {b.ratio:g} of its rows: join a whole table, or two samples of one ratio by their join keys")
        names = (left, right)
        clean = aqp.joined(a.clean, b.clean, k1, k2, "inner" if s.mode == "raw" else "left", names)
        if s.mode == "raw":
            return aqp.raw(clean, s.function, s.attr, s.where, s.group, a.ratio)
        return aqp.normalized(clean, aqp.joined(a.dirty, b.dirty, k1, k2, "left", names), s.function, s.attr, s.where, s.group, a.ratio, aqp.joined_key())

    def save(self, name: str) -> list[str]:
        """Writes a working set as the catalog tables ``<name>_base``, ``_clean`` and ``_dirty``; their names."""
        ws = self.get(name)
        about = {"tidemark.ratio": repr(ws.ratio), "tidemark.base": ws.meta.base, "tidemark.key": ws.meta.key or "", "tidemark.seed": str(ws.meta.seed)}
        made = []
        for part in ("base", "clean", "dirty"):
            catalog.create_shared(getattr(ws, part), f"{name}_{part}", about)
            made.append(f"{name}_{part}")
        self.tables += [t for t in made if t not in self.tables]
        return made

    def open(self, name: str) -> WorkingSet:
        """A working set that was saved, by this application or, in a catalog that lasts, an earlier one."""
        about = catalog.properties(self.spark, f"{name}_clean")
        meta = SampleMeta(about["tidemark.base"], float(about["tidemark.ratio"]), about["tidemark.key"] or None, int(about["tidemark.seed"]))
        base, clean, dirty = (self.spark.table(f"{name}_{part}") for part in ("base", "clean", "dirty"))
        self.sets[name] = ws = WorkingSet(self.spark, meta, base, clean, dirty)
        return ws

    def close(self, tables: bool = True, scratch: bool = False) -> None:
        """Drops the views and, unless told otherwise, the catalog tables this session made, nothing else.

        ``scratch`` also deletes every scratch folder this application has written: only when no result is read any more.
        """
        for name in self.sets:
            self.spark.catalog.dropTempView(name)
        self.sets.clear()
        if tables:
            for name in self.tables:
                catalog.drop(self.spark, name)
            self.tables.clear()
        if scratch:
            cleanup(self.spark)
