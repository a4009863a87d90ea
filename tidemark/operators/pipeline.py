"""Cleaning pipelines: algorithms in order, queries that are answered again after every change, and specs for both."""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from . import extract, resolution
from .sample import WorkingSet

Algorithm = Callable[[WorkingSet], WorkingSet]


@dataclass
class Pipeline:
    """``run`` applies the algorithms. A registered query's results pile up: one at the start, one for each change."""

    algorithms: list[Algorithm]
    queries: dict[str, str] = field(default_factory=dict)
    results: dict[str, list[DataFrame]] = field(default_factory=dict)

    def register(self, name: str, sql: str) -> Pipeline:
        self.queries[name] = sql
        return self

    def answer(self, ws: WorkingSet) -> None:
        for name, sql in self.queries.items():
            self.results.setdefault(name, []).append(ws.query(sql))

    def run(self, ws: WorkingSet, background: bool = False):
        """The working set, or a future of it when run in the background."""

        def work() -> WorkingSet:
            self.answer(ws)
            ws.listeners.append(self.answer)
            try:
                return ws.run(*self.algorithms)
            finally:
                ws.listeners.remove(self.answer)

        if not background:
            return work()
        pool = ThreadPoolExecutor(1)
        future = pool.submit(work)
        pool.shutdown(wait=False)
        return future


def stage(spec: dict, matcher=None) -> Algorithm:
    """The algorithm of one stage's spec, in either of the two notations."""
    if "operator" in spec:
        return _short_stage(spec, matcher)
    name, threshold = spec["name"].lower(), spec.get("threshold")
    weighted = str(spec.get("weighting", True)).lower() == "true"
    if name == "shortattributeer":
        return resolution.short(spec["attribute"], int(float(1 if threshold is None else threshold)))
    if name == "longattributeer":
        return resolution.long(spec["attribute"], float(0.9 if threshold is None else threshold), weighted)
    if name in ("activelearninger", "hybrider") and matcher is None:
        raise ValueError(f"{spec['name']} needs a matcher that learns")
    if name == "activelearninger":
        return resolution.active(spec["attribute"], matcher, float(0.9 if threshold is None else threshold), weighted)
    if name == "hybrider":
        return resolution.hybrid(spec["attribute"], float(threshold), float(spec["second_threshold"]), matcher, weighted)
    if name == "recorddedup":
        cols = spec["dedup_columns"]
        return resolution.RecordDeduplication(cols.split(",") if isinstance(cols, str) else cols, float(0.9 if threshold is None else threshold), weighted)
    if name == "splitextraction":
        out = spec["output_columns"]
        return extract.split(spec["attribute"], spec["delimiter"], out.split(",") if isinstance(out, str) else out)
    raise ValueError(f"unknown stage {spec['name']!r}")


def _short_stage(spec: dict, matcher) -> Algorithm:
    options, kind = spec.get("options", {}), spec["operator"].lower()
    if kind == "extract":
        out = options["output_columns"]
        return extract.split(spec["field"], options["delimiter"], out.split(",") if isinstance(out, str) else out)
    if kind != "attrdedup":
        raise ValueError(f"unknown operator {spec['operator']!r}")
    name = options.get("similarity", "jaccard").lower()
    made = resolution.short(spec["field"], int(float(options.get("threshold", 1)))) if name == "edit" else resolution.long(spec["field"], float(options.get("threshold", 0.9))).with_(similarity=name)
    crowd = options.get("crowd")
    if crowd and matcher is None:
        raise ValueError("a stage that asks a crowd needs a matcher that learns")
    if crowd == "active":
        return made.with_(matchers=[matcher])
    if crowd == "hybrid":
        return resolution.hybrid(spec["field"], float(options.get("low", 0.5)), float(options.get("threshold", 0.9)), matcher)
    return made


def run_pipeline(spec: dict | str, sets: dict[str, WorkingSet], matcher=None) -> dict[str, list[DataFrame]]:
    """Runs ``{pipeline | stages, dataset, sql_query | sql_queries}``; each query's results, before and after each stage."""
    spec = json.loads(spec) if isinstance(spec, str) else spec
    if spec["dataset"] not in sets:
        raise KeyError(f"no dataset {spec['dataset']}")
    sql = spec.get("sql_queries") or ([spec["sql_query"]] if "sql_query" in spec else [])
    p = Pipeline([stage(s, matcher) for s in spec.get("pipeline", spec.get("stages", []))], {str(i): q for i, q in enumerate(sql)})
    p.run(sets[spec["dataset"]])
    return p.results
