"""Exact top-k search by inner product with pivot-table elimination.

Vectors get one more component that makes all candidates of a block equally long, so the largest inner product is the least
distance. The table, worked out once and stored with the candidates, holds each candidate's distance to many pivots; by
the triangle inequality every pivot gives a lower bound of the distance to a query, and the largest of them counts.
Candidates are evaluated in the order of their bounds until the next bound cannot reach the k-th best score any more: then
the result is exact, for what was left out scores strictly less. Pivots are picked far from each other in a bounded
sample; they steer the cost, not the result.

Queries and candidates are cut into blocks, candidates by their nearest pivot, so that a block's range of distances can
rule it out as a whole. A task takes one block of each at a time, so its memory is fixed whatever the tables hold. A query
starts with a floor, its k-th best score in the sample, and a task raises the floor from block to block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.scratch import discard, materialize, shuffle_partitions
from ..plans.ship import ship
from .common import column

#: Inner products below this are exact in double precision.
EXACT = 2.0**53
LONG = (-(1 << 63), (1 << 63) - 1)
#: Blocks of queries whose floors a task remembers.
FLOORS_HELD = 1024


def integers(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """(key, v): floor(scale * x) of each component in double precision, without vectors that are null, empty or hold null or non-finite components.

    Rows with a null key take no part either: they could be named neither as a query nor as a result.
    """
    x = F.col(vector).cast("array<double>")
    fine = F.col(vector).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    floor = F.transform(x, lambda c: _floor(c * F.lit(scale)))
    return vectors.filter(fine & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), floor.alias("v"))


def _floor(c):
    """Floor that stays a double, so that large components do not overflow."""
    whole = F.rint(c)
    return whole - F.when(whole > c, F.lit(1.0)).otherwise(F.lit(0.0))


def pick_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first pivots of a sample."""
    if not len(sample):
        return sample
    chosen, gap = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(n, len(sample)):
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(gap.argmax()))
    return sample[chosen]


def distances(rows: np.ndarray, pivots: np.ndarray, lifted: bool = False) -> np.ndarray:
    """Distance of each row to each pivot. Lifted rows have the component that makes them as long as the longest; pivots and queries have 0 there."""
    norms = (rows * rows).sum(axis=1)
    # a lifted row's squared length is the longest's
    length = np.full(len(rows), norms.max()) if lifted and len(rows) else norms
    return np.sqrt(np.maximum(length[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2.0 * (rows @ pivots.T), 0.0))


def search_block(
    q_ids: np.ndarray,
    q: np.ndarray,
    c_ids: np.ndarray,
    c: np.ndarray,
    pivots: np.ndarray,
    k: int,
    step: int = 256,
    q_table: np.ndarray | None = None,
    c_table: np.ndarray | None = None,
    floors: np.ndarray | None = None,
    evaluated: list[int] | None = None,
) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """Yields each query, in order, with its k best candidates of at least its floor and their scores. Candidates must come in ascending ids.

    Tables that are not given are worked out from the pivots. ``evaluated`` gets the number of candidates computed for each query.
    """
    q_table = distances(q, pivots) if q_table is None else q_table
    c_table = distances(c, pivots, True) if c_table is None else c_table
    floors = np.full(len(q_ids), -np.inf) if floors is None else floors
    top, q_norms = (c * c).sum(axis=1).max(), (q * q).sum(axis=1)
    exact = np.sqrt(max(q_norms.max(), 1.0) * max(top, 1.0)) < EXACT / 4
    slack = 1e-9 * (q_norms + top) + 1e-6
    # what the block's nearest and farthest candidates of each pivot leave possible
    apart = np.maximum(c_table.min(axis=0) - q_table, q_table - c_table.max(axis=0)).max(axis=1, initial=0.0)
    possible = (q_norms + top - apart * apart) / 2.0 + slack >= floors
    for i in range(len(q_ids)):
        best_s, best_j, done = np.zeros(0), np.zeros(0, np.int64), 0
        if possible[i]:
            low = np.abs(c_table - q_table[i]).max(axis=1, initial=0.0)
            bound = (q_norms[i] + top - low * low) / 2.0 + slack[i]
            order = np.flatnonzero((bound >= floors[i]) & (c_ids != q_ids[i]))
            order = order[np.argsort(-bound[order], kind="stable")]
            width = step
            while done < len(order) and not (len(best_s) >= k and bound[order[done]] < best_s[k - 1]):
                at = order[done : done + width]
                s = c[at] @ q[i] if exact else np.array([_whole(c[j], q[i]) for j in at.tolist()], dtype=object)
                best_s, best_j = np.concatenate([best_s, s]), np.concatenate([best_j, at])
                keep = np.lexsort((best_j, -best_s))[:k] if exact else np.array(sorted(range(len(best_s)), key=lambda x, s=best_s, j=best_j: (-s[x], j[x]))[:k], dtype=np.int64)
                best_s, best_j = best_s[keep], best_j[keep]
                done, width = done + len(at), 2 * width
        if evaluated is not None:
            evaluated.append(done)
        scores = [min(max(int(x), LONG[0]), LONG[1]) for x in best_s.tolist()]
        fine = sum(x >= floors[i] for x in scores)
        yield int(q_ids[i]), best_j[:fine], scores[:fine]


def _whole(a: np.ndarray, b: np.ndarray) -> int:
    return sum(int(x) * int(y) for x, y in zip(a.tolist(), b.tolist(), strict=True))


def raised(floor: float, scores: list[int], k: int) -> float:
    """The floor after a block gave ``scores``; one cut to the least long says nothing."""
    return max(floor, float(scores[k - 1])) if len(scores) >= k and scores[k - 1] > LONG[0] else floor


def runs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(dim, block, keys, vectors) of blocks that follow each other; one that has ``rows`` rows is closed, and more of it make another."""
    at, keys, vs = None, [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        dim, block, key = (column(batch, n).to_numpy(zero_copy_only=False) for n in ("dim", "block", "key"))
        flat, ends = column(batch, "v").flatten().to_numpy(zero_copy_only=False), np.cumsum(dim, dtype=np.int64)
        cuts = [0, *(np.flatnonzero((np.diff(dim) != 0) | (np.diff(block) != 0)) + 1).tolist(), len(dim)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            here = (int(dim[s]), int(block[s]))
            if keys and (at != here or sum(map(len, keys)) >= rows):
                yield *at, np.concatenate(keys), np.concatenate(vs)
                keys, vs = [], []
            at = here
            keys.append(key[s:e].astype(np.int64))
            vs.append(flat[ends[s] - dim[s] : ends[e - 1]].reshape(e - s, here[0]).astype(np.float64))
    if keys:
        yield *at, np.concatenate(keys), np.concatenate(vs)


def record(**values) -> pa.RecordBatch:
    """One row of integers and, from arrays, bytes."""
    cells = [pa.array([v.tobytes()], pa.binary()) if isinstance(v, np.ndarray) else pa.array([v], pa.int32()) for v in values.values()]
    return pa.RecordBatch.from_arrays(cells, list(values))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, pivots: int = 32, sample: int = 2000, query_rows: int = 1024, candidate_rows: int = 8192) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's ``k`` best candidates other than itself.

    Both inputs are (key, v) as made by ``integers``. Ties go to the smaller key; a query with fewer candidates gets all;
    scores beyond a long are cut to its range. Candidates whose dimension differs from the query's are no candidates.
    Repeated keys count as one vector each; a query is never its own result, by key. Either table may be empty. The driver
    holds ``sample`` vectors, of which pivots and first floors come; dimensions that have none there go without.
    """
    spark = queries.sparkSession
    ship(spark)
    given = materialize(candidates.select("key", "v", F.size("v").alias("dim")), "candidates")
    queries = materialize(queries.select("key", "v", F.size("v").alias("dim")), "queries")
    # a cell is about a block at least: pivots come farthest first, so the first few are spread out as well
    cells = max(1, min(pivots, given.count() // candidate_rows))
    drawn = given.orderBy(F.xxhash64("key"), "key").limit(sample).collect()
    scouts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    centres: dict[int, np.ndarray] = {}
    for d in {r.dim for r in drawn}:
        rows = [r for r in drawn if r.dim == d]
        centres[d] = pick_pivots(np.array([r.v for r in rows], dtype=np.float64), pivots)
        rows.sort(key=lambda r: r.key)
        scouts[d] = np.array([r.key for r in rows], np.int64), np.array([r.v for r in rows], dtype=np.float64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds each candidate's nearest pivot among the first ``cells``."""
        for batch in batches:
            dim = column(batch, "dim").to_numpy(zero_copy_only=False)
            flat, ends = column(batch, "v").flatten().to_numpy(zero_copy_only=False), np.cumsum(dim, dtype=np.int64)
            cell = np.zeros(len(dim), np.int32)
            for d in set(dim.tolist()) & set(centres):
                rows = np.flatnonzero(dim == d)
                v = flat[(ends[rows] - d)[:, None] + np.arange(d)[None, :]]
                cell[rows] = distances(v, centres[d][:cells]).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    placed = materialize(given.mapInArrow(place, "key long, v array<double>, dim int, cell int"), "cells")
    discard(given)
    # a cell is cut into parts of about as many rows as wanted, by a hash of the key; parts are numbered through
    parts = F.ceil(F.count("*") / F.lit(candidate_rows)).cast("int")
    numbers = placed.groupBy("dim", "cell").agg(parts.alias("parts"))
    before = F.sum("parts").over(Window.orderBy("dim", "cell").rowsBetween(Window.unboundedPreceding, -1))
    numbers = materialize(numbers.withColumn("first", F.coalesce(before, F.lit(0)).cast("int")), "parts")
    c_blocks = numbers.agg(F.sum("parts").alias("n")).first().n or 1
    q_blocks = max(1, -(-queries.count() // query_rows))
    tasks = 4 * shuffle_partitions(spark)
    number = lambda n: F.pmod(F.xxhash64("key"), n).cast("int")

    def cut(df: DataFrame, blocks: int) -> DataFrame:
        return df.repartition(max(1, min(blocks, tasks)), "dim", "block").sortWithinPartitions("dim", "block", "key").select("dim", "block", "key", "v")

    def pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (d, block, keys, v) in enumerate(runs(batches, 2 * query_rows)):
            table, floors = distances(v, centres.get(d, v[:0])), np.full(len(keys), -np.inf)
            if d in scouts:
                for i, (_, _, scores) in enumerate(search_block(keys, v, *scouts[d], centres[d], k, q_table=table)):
                    floors[i] = raised(floors[i], scores, k)
            yield record(dim=d, q_block=block, q_part=part, q_keys=keys, q_v=v, q_table=table, floors=floors)

    def pack_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, block, keys, v in runs(batches, 2 * candidate_rows):
            yield record(dim=d, c_block=block, c_keys=keys, c_v=v, c_table=distances(v, centres.get(d, v[:0]), True))

    q_side = materialize(cut(queries.withColumn("block", number(F.lit(q_blocks))), q_blocks).mapInArrow(pack_queries, "dim int, q_block int, q_part int, q_keys binary, q_v binary, q_table binary, floors binary"), "q-blocks")
    numbered = placed.join(numbers, ["dim", "cell"]).withColumn("block", F.col("first") + number(F.col("parts")))
    c_side = materialize(cut(numbered, c_blocks).mapInArrow(pack_candidates, "dim int, c_block int, c_keys binary, c_v binary, c_table binary"), "c-blocks")
    discard(placed)

    # every block of queries meets every block of candidates of its dimension, by an equality of numbers; where candidates
    # have fewer blocks than there are tasks, lanes of queries share them out
    lanes = max(1, min(q_blocks, -(-tasks // c_blocks)))
    q_side = q_side.withColumn("lane", F.pmod("q_block", F.lit(lanes))).withColumn("c_block", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))
    c_side = c_side.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    on = ["dim", "c_block", "lane"]
    n = max(1, min(c_blocks * lanes, tasks))
    met = q_side.repartition(n, *on).join(c_side.repartition(n, *on).hint("merge"), on)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                one = {n: batch.column(i)[row].as_py() for i, n in enumerate(batch.schema.names)}
                d = one["dim"]
                q_ids, c_ids = np.frombuffer(one["q_keys"], np.int64), np.frombuffer(one["c_keys"], np.int64)
                q, c = np.frombuffer(one["q_v"]).reshape(-1, d), np.frombuffer(one["c_v"]).reshape(-1, d)
                near = centres.get(d, c[:0])
                q_table, c_table = np.frombuffer(one["q_table"]).reshape(len(q), len(near)), np.frombuffer(one["c_table"]).reshape(len(c), len(near))
                at = (d, one["q_block"], one["q_part"])
                if len(held) > FLOORS_HELD:
                    held.clear()
                floors = held.setdefault(at, np.frombuffer(one["floors"]).copy())
                out: list[list] = [[], [], []]
                for i, (qid, js, scores) in enumerate(search_block(q_ids, q, c_ids, c, near, k, q_table=q_table, c_table=c_table, floors=floors)):
                    floors[i] = raised(floors[i], scores, k)
                    out[0] += [qid] * len(js)
                    out[1] += c_ids[js].tolist()
                    out[2] += scores
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["query_id", "vec_id", "score"])

    found = met.mapInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id", "salt").orderBy(F.desc("score"), "vec_id")
    salted = found.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, c_blocks // 64))))
    first = salted.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k) if c_blocks > 64 else salted
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return first.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
