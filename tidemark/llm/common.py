"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..plans.workers import give_back, mix64, open_fs

__all__ = ["column", "give_back", "grouped", "mix64", "open_fs", "slices", "utf8_bytes"]


def slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def utf8_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding them."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def grouped(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal integers in ``by``, from batches that hold each run together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([column(batch, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in by])
        cuts = [0, *(np.flatnonzero((np.diff(ids, axis=1) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(s, e - s)
            if held and any(column(held[0], c)[0].as_py() != column(part, c)[0].as_py() for c in by):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)
