"""Extraction of columns by splitting an attribute."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sample import WorkingSet


@dataclass
class Split:
    """Adds the pieces of ``attr``, split by a pattern, as columns. Missing pieces are ``missing``; columns that exist stay."""

    attr: str
    delimiter: str
    names: list[str]
    missing: str | None = ""

    def apply(self, df: DataFrame) -> DataFrame:
        parts = F.split(self.attr, self.delimiter, -1)
        new = {n: F.get(parts, F.lit(i)) for i, n in enumerate(self.names) if n not in df.columns}
        return df.withColumns({n: c if self.missing is None else F.coalesce(c, F.lit(self.missing)) for n, c in new.items()})

    def __call__(self, ws: WorkingSet) -> WorkingSet:
        ws.base, ws.dirty = self.apply(ws.base), self.apply(ws.dirty)
        return ws.replace(self.apply(ws.clean))


def split(attr: str, delimiter: str, names: list[str]) -> Split:
    """Missing pieces are empty strings."""
    return Split(attr, delimiter, names)


def fast_split(attr: str, delimiter: str, names: list[str]) -> Split:
    """Missing pieces are null."""
    return Split(attr, delimiter, names, None)


@dataclass
class LearnedSplit:
    """Learns, from examples, which characters delimit: those of the input that no output has."""

    attr: str
    names: list[str]
    delimiters: set[str] = field(default_factory=set)

    def add(self, example: str, outputs: list[str]) -> LearnedSplit:
        self.delimiters |= set(example) - set("".join(outputs))
        return self

    def split(self) -> Split:
        if not self.delimiters:
            raise ValueError("no example shows a delimiter")
        return Split(self.attr, "[" + "".join(re.escape(c) for c in sorted(self.delimiters)) + "]", self.names)

    def __call__(self, ws: WorkingSet) -> WorkingSet:
        return self.split()(ws)
