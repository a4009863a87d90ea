"""Cost-balanced packing of documents into fixed-length training sequences.

A piece of n tokens costs ``linear * n + quadratic * n * n``: attention looks within a piece only. Documents longer
than a sequence first fill whole sequences of their own. What remains is taken in descending cost, and
each piece goes to the open sequence of the lowest cost that still has room for all of it; if none
has, it is cut, and fills the cheapest sequences with room. A window opens just as many sequences as its
tokens need, so all but its last are filled.

Each task packs its own rows in windows of ``window_tokens``: no shuffle, bounded memory, and nothing that
a hot source could gather in one place.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..plans.ship import ship
from .common import column, slices
from .tokens import encoder

#: Sequence numbers of one task; a task of more would need over 2**40 tokens.
TASK_SEQUENCES = 1 << 36


def pack(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 0.01) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that cover every document, sequences from 0."""
    pieces, tails, total = [], [], 0
    sequence = 0
    for d, n in enumerate(lengths):
        full = n // capacity
        for k in range(full):
            pieces.append((d, k * capacity, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            tails.append((n % capacity, d, full * capacity))
            total += n % capacity
    cost = lambda n: linear * n + quadratic * n * n
    bins = -(-total // capacity)
    used = [0] * bins
    if total % capacity:  # the last sequence is short: it has room for what is left over only
        used[-1] = capacity - total % capacity
    short = used[-1] if bins else 0
    # Lengths only fall, so a sequence lies in ``fits`` if it has room for the piece at hand, and else waits by its room.
    fits: list[tuple[float, int]] = []
    waits: list[tuple[float, int, int]] = []  # (cost, sequence, filled), out of date if it was filled or fits since
    by_room: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
    in_fits = [False] * bins

    def put(c: float, b: int, n: int) -> None:
        room = capacity - used[b]
        if room >= n:
            in_fits[b] = True
            heapq.heappush(fits, (c, b))
        elif room:
            in_fits[b] = False
            by_room[room].append((c, b))
            heapq.heappush(waits, (c, b, used[b]))

    tails.sort(key=lambda x: (-x[0], x[1]))
    lowest = capacity
    for b in range(bins):
        put(0.0, b, lowest)
    for n, d, start in tails:
        while lowest > n:
            lowest -= 1
            for c, b in by_room[lowest]:
                if not in_fits[b] and capacity - used[b] == lowest:
                    put(c, b, lowest)
            by_room[lowest] = []
        if fits:
            c, b = heapq.heappop(fits)
            pieces.append((d, start, n, sequence + b, used[b]))
            used[b] += n
            put(c + cost(n), b, lowest)
            continue
        while n:  # no sequence has room for all of it
            c, b, filled = heapq.heappop(waits)
            if in_fits[b] or used[b] != filled:
                continue
            part = min(n, capacity - used[b])
            pieces.append((d, start, part, sequence + b, used[b]))
            used[b] += part
            n, start = n - part, start + part
            put(c + cost(part), b, lowest)
    if short:
        last = sequence + bins - 1
        pieces = [(d, s, n, q, o - short if q == last else o) for d, s, n, q, o in pieces]
    return pieces


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, window_tokens: int = 4_000_000, linear: float = 1.0, quadratic: float = 0.01, key: str = "doc_id") -> DataFrame:
    """One row per piece: key, start, length, ids_le (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone; a null key stays null. Repeated rows are packed once each. Other columns are left out, and an
    empty table gives no pieces. The last sequence of a window may be short.
    """
    ship(docs.sparkSession)

    def flush(keys: list, ids: list[np.ndarray], base: int) -> tuple[pa.RecordBatch, int]:
        got = pack([len(x) for x in ids], capacity, linear, quadratic)
        got.sort()
        cols = {
            key: pa.array([keys[d] for d, *_ in got], pa.int64()),
            "start": pa.array([s for _, s, *_ in got], pa.int64()),
            "length": pa.array([n for _, _, n, *_ in got], pa.int64()),
            "ids_le": pa.array([ids[d][s : s + n].tobytes() for d, s, n, *_ in got], pa.binary()),
            "doc_tokens": pa.array([len(ids[d]) for d, *_ in got], pa.int64()),
            "sequence_id": pa.array([base + q for *_, q, _ in got], pa.int64()),
            "offset": pa.array([o for *_, o in got], pa.int64()),
        }
        return pa.RecordBatch.from_pydict(cols), max((q for *_, q, _ in got), default=-1) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base = encoder(tokenizer).ids, TaskContext.get().partitionId() * TASK_SEQUENCES
        keys, ids, held = [], [], 0
        for batch in batches:
            for part in slices(batch, 64):
                for k, text in zip(column(part, key).to_pylist(), column(part, "text").to_pylist(), strict=True):
                    keys.append(k)
                    ids.append(np.append(encode(text), end_id).astype("<u4"))
                    held += len(ids[-1])
                    if held >= window_tokens:
                        out, n = flush(keys, ids, base)
                        yield out
                        keys, ids, held, base = [], [], 0, base + n
        if keys:
            yield flush(keys, ids, base)[0]

    return docs.select(key, "text").mapInArrow(run, f"{key} long, start long, length long, ids_le binary, doc_tokens long, sequence_id long, offset long")
