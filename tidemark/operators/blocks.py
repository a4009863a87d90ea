"""Similarity joins of bags, block against block: no pair leaves a task before it is known to match.

A row's bag is its tokens' 64-bit hashes with how often the row has them, rare tokens first: those that a sample of rows does
not name as frequent in order of their hashes, the others by rising frequency. Bags are written once, in blocks of rows of like
size, their numbers packed by bytes; a task reads a block and those whose sizes let them match. Two bags that match share tokens before the point from
which the rest of a bag weighs less than the overlap it needs, and these first parts grow shorter with the weights of the rows
met. So first parts are joined, weights met there summed up, and pairs whose sum leaves too much to the rest are ruled out; the
others are compared bag by bag. The order steers the cost alone. An overlap of a fixed weight leaves hardly anything out: there whole bags
are joined, and what rows share of tokens that many of them have is a product of matrices.

The number of pairs of blocks grows with the square of the rows; disk does not. Two tokens of one hash count as equal: hashes have
63 bits, so for 16 million compared pairs of bags of 400 tokens the chance of any such is below 1e-6.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize, new_path, shuffles_removed
from ..plans.ship import ship
from ..plans.workers import give_back, open_fs

#: A block's rows and tokens at most, about; blocks that a task holds; frequencies read at once; meetings of tokens at once.
BLOCK_ROWS, BLOCK_TOKENS, TOGETHER, PIECE, MEETINGS = 4096, 2_000_000, 4, 500_000, 4_000_000
#: Rows given out at once.
ROWS_OUT = 200_000
#: Marks the codes of the sample's frequent tokens, which come last; the rest of such a code is the token's place among them.
TOP = np.uint64(1) << np.uint64(63)
#: File beside the blocks: in how many rows each frequent token stands.
BESIDE = "_frequent.parquet"
#: Rows sampled to order tokens and to cut blocks, frequent tokens told apart; share of a bag by which first parts are longer than they need be, which rules out more pairs.
ORDER_ROWS, FREQUENT, LONGER = 8_000, 1 << 16, 0.04
#: From this share of two blocks' pairs on, those that meet by a token are multiplied, not listed; times a row has a token told apart there, columns at once.
MULTIPLIED, TIMES, COLUMNS = 0.001, 512, 1024


def needed(name: str, t: float, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Overlap that bags of weights ``p`` and ``q`` need, as ``Metric.needed``, less its slack."""
    s = t - 1e-6
    return {"jaccard": lambda: s / (1 + s) * (p + q), "dice": lambda: t / 2 * (p + q), "cosine": lambda: t * np.sqrt(p * q), "overlap": lambda: t + 0 * (p + q)}[name]() - 1e-6


def least(name: str, t: float, p: np.ndarray) -> np.ndarray:
    """Overlap that a bag of weight ``p`` needs with any other, less its slack."""
    return {"jaccard": lambda: (t - 1e-6) * p, "dice": lambda: t / (2 - t) * p, "cosine": lambda: t * t * p, "overlap": lambda: t + 0 * p}[name]() - 1e-6


def _files(path: str) -> tuple[pafs.FileSystem, list[str]]:
    fs, at = open_fs(path)
    return fs, sorted(x.path for x in fs.get_file_info(pafs.FileSelector(at)) if x.base_name.endswith(".parquet"))


def _frequencies(rows: DataFrame, least: int) -> str:
    """Folder of (h, df): in how many rows a token stands, for tokens of ``least`` rows or more."""
    counted = rows.select(F.explode(F.array_distinct("h")).alias("h")).groupBy("h").agg(F.count("*").cast("int").alias("df"))
    return materialize(counted.filter(F.col("df") >= least), "frequencies")._scratch_path


def _sample(rows: DataFrame, n_rows: float) -> tuple[DataFrame, int]:
    """(h) of one row in so many, of about ORDER_ROWS in all. It orders tokens and cuts blocks, which steers the cost alone."""
    one_in = int(max(1, n_rows // ORDER_ROWS))
    some = rows.filter(F.pmod(F.xxhash64("id"), F.lit(one_in)) == 0)
    return some.select(F.transform("tokens", lambda x: F.xxhash64(x)).alias("h")), one_in


def _frequent(sample: DataFrame) -> np.ndarray:
    """Hashes of the most frequent tokens of a sample, the rarest first; a bounded number."""
    counted = sample.select(F.explode("h").alias("h")).groupBy("h").count().filter("count > 1").orderBy(F.desc("count"), "h").limit(FREQUENT)
    return counted.select("h").toArrow().column(0).to_numpy().view(np.uint64)[::-1]


def _coder(frequent: np.ndarray):
    """Hashes to codes in the order of bags."""
    place = np.argsort(frequent)
    known = frequent[place]

    def code(h: np.ndarray) -> np.ndarray:
        out = h >> np.uint64(1)
        if len(known):
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[at] == h
            out[hit] = TOP | place[at[hit]].astype(np.uint64)
        return out

    return code


def _rows_with_frequent(spark, path: str, frequent: np.ndarray, others: float) -> np.ndarray:
    """In how many rows each of the frequent tokens stands, in their order; one that no file names is in ``others``."""
    df = np.full(len(frequent), others)
    if len(frequent):
        named = spark.createDataFrame(pa.table({"h": frequent.view(np.int64), "at": np.arange(len(frequent))}))
        found = spark.read.parquet(path).join(F.broadcast(named), "h").select("at", "df").toArrow()  # a bounded number
        df[found["at"].to_numpy()] = found["df"].to_numpy()
    return df


def _rows_with(path: str, h: np.ndarray, others: float) -> np.ndarray:
    """In how many rows each token of ``h`` (sorted, distinct) stands; one that no file names is in ``others``."""
    df = np.full(len(h), others)
    fs, names = _files(path)
    for name in names:
        known = pq.ParquetFile(fs.open_input_file(name))
        for batch in known.iter_batches(PIECE):
            key, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            order = np.argsort(key)
            key, n = key[order], n[order]
            at = np.minimum(np.searchsorted(key, h), len(key) - 1)
            hit = key[at] == h
            df[hit] = n[at[hit]]
    return df


def _packed(values: np.ndarray) -> bytes:
    """All numbers' first bytes, then their second ones and so on: most are the same along a bag, so files and shuffles hold little of them."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _bags(paths: str | None, n_rows: float, others: float, frequent: np.ndarray, of_frequent: np.ndarray | None, places: np.ndarray):
    """Batches (id, share, h) to bags (id, same, block, total, tokens, times, dfs); h holds a token as often as the row. ``places`` has
    sizes, where their rows begin in the line of blocks, and how much of it they take; ``share`` in [0, 1) spreads rows of a size.
    ``dfs`` is of the tokens that are not among the frequent ones, whose rows ``of_frequent`` has once for all."""

    def many(tables: list[pa.RecordBatch], code) -> Iterator[pa.RecordBatch]:
        kept, same = [], []
        for x in tables:
            lists = x.column(2)
            flat, cuts = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
            cuts = cuts - cuts[0]
            codes = code(flat)
            for s, e in zip(cuts, cuts[1:], strict=False):
                c, first, n = np.unique(codes[s:e], return_index=True, return_counts=True)
                kept.append((c, n.astype(np.uint32), flat[s:e][first[: np.searchsorted(c, TOP)]] if paths else None))
                same.append(blake2b(flat[s:e].tobytes(), digest_size=16).digest())
        dfs: list[np.ndarray | None] = [None] * len(kept)
        if paths:
            every = np.unique(np.concatenate([h for _, _, h in kept]))
            df = _rows_with(paths, every, others).astype(np.uint32)
            dfs = [df[np.searchsorted(every, h)] for _, _, h in kept]
        total = [float(n.sum() if d is None else (n * np.log10(n_rows / _all_rows_with(c, d, of_frequent))).sum()) for (c, n, _), d in zip(kept, dfs, strict=True)]
        raw = lambda arrays: pa.array([None if a is None else _packed(a) for a in arrays], pa.binary())
        k = 0
        for x in tables:
            part = slice(k, k := k + x.num_rows)
            size = np.diff(x.column(2).offsets.to_numpy())
            at = np.maximum(np.searchsorted(places[0], size, "right") - 1, 0)
            block = pa.array((places[1][at] + x.column(1).to_numpy() * places[2][at]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(same[part], pa.binary()), block, pa.array(total[part]), raw(c for c, _, _ in kept[part]), raw(n for _, n, _ in kept[part]), raw(dfs[part])], names=["id", "same", "block", "total", "tokens", "times", "dfs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, held, size = _coder(frequent), [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += len(batch.column(2).values)
                if size > BLOCK_TOKENS:
                    yield from many(held, code)
                    held, size = [], 0
        if held:
            yield from many(held, code)
        give_back()

    return run


def _all_rows_with(code: np.ndarray, dfs: np.ndarray, of_frequent: np.ndarray) -> np.ndarray:
    """In how many rows each token stands: ``dfs`` says so of those that are not frequent."""
    often = code >= TOP
    df = np.empty(len(code))
    df[often], df[~often] = of_frequent[(code[often] ^ TOP).astype(np.int64)], dfs
    return df


def _flat(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The values of a column of binary strings, one after the other."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _unpacked(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The numbers of a column that ``_packed`` made, one after the other."""
    width = np.dtype(kind).itemsize
    bags = column.to_pylist()
    out = np.empty((sum(len(x) for x in bags) // width, width), np.uint8)
    at = 0
    for x in bags:
        n = len(x) // width
        out[at : at + n] = np.frombuffer(x, np.uint8).reshape(width, n).T
        at += n
    return out.reshape(-1).view(kind)


class _Block:
    """A block's different bags by weight, the ids of each, and first parts by token. Equal lists of tokens are compared as one."""

    def __init__(self, path: str, name: str, t: float, n_rows: float):
        fs, names = _files(path)
        table = pa.concat_tables(pq.read_table(fs.open_input_file(n)) for n in names).combine_chunks()
        table = table.take(np.argsort(table["total"].to_numpy(), kind="stable"))
        first, kind = np.unique(_flat(table["same"], np.uint64).reshape(-1, 2), axis=0, return_index=True, return_inverse=True)[1:]
        kind = np.argsort(np.argsort(first))[kind.ravel()]  # numbered by weight, too
        self.id, self.copies = table["id"].combine_chunks().take(pa.array(np.argsort(kind, kind="stable"))), np.bincount(kind)
        self.from_id = np.cumsum(self.copies) - self.copies
        table = table.take(np.sort(first))
        self.total, self.same = table["total"].to_numpy(), _flat(table["same"], np.uint64).reshape(-1, 2)
        self.code, self.n = _unpacked(table["tokens"], np.uint64), _unpacked(table["times"], np.uint32).astype(np.float64)
        of_frequent = None if table["dfs"].null_count else pq.read_table(fs.open_input_file(f"{open_fs(path)[1].rsplit('/', 1)[0]}/{BESIDE}"))["df"].to_numpy()
        self.w = None if of_frequent is None else np.log10(n_rows / _all_rows_with(self.code, _unpacked(table["dfs"], np.uint32), of_frequent))
        self.length = np.array([len(x) // 8 for x in table["tokens"].to_pylist()])
        self.starts = np.concatenate([[0], np.cumsum(self.length)])
        mass = self.n if self.w is None else self.n * self.w
        row = np.repeat(np.arange(len(self.total), dtype=np.int32), self.length)
        upto = np.cumsum(mass)
        rest = upto[self.starts[1:] - 1][row] - upto + mass  # of the bag from this token on
        first = np.flatnonzero(rest >= self.cut(least(name, t, self.total), name)[row])
        self.at = first[np.argsort(self.code[first])]
        self.first_code, self.first_row, self.first_rest = self.code[self.at], row[self.at], rest[self.at]

    def cut(self, need: np.ndarray, name: str) -> np.ndarray:
        """A token belongs to the first part if the bag weighs so much from there on, and ``need`` is the overlap that the bag needs."""
        return np.full(len(need), -np.inf) if name == "overlap" else need - LONGER * self.total

    def first(self, cut: np.ndarray) -> tuple[np.ndarray, ...]:
        """Where each token of the first parts begins and ends in the rest; rows; places in the bags."""
        keep = np.flatnonzero(self.first_rest >= cut[self.first_row])
        code = self.first_code[keep]
        begin = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
        return code[begin], begin, np.diff(np.concatenate([begin, [len(code)]])), self.first_row[keep], self.at[keep]


def _met(x: _Block, i: int, y: _Block, js: np.ndarray) -> np.ndarray:
    """Weight that the bag ``i`` of ``x`` shares with each of ``js`` of ``y``."""
    s, e = x.starts[i], x.starts[i + 1]
    at = np.concatenate([np.arange(y.starts[j], y.starts[j + 1]) for j in js])
    place = np.minimum(np.searchsorted(x.code[s:e], y.code[at]), e - s - 1)
    hit = x.code[s:e][place] == y.code[at]
    shared = np.where(hit, np.minimum(x.n[s:e][place], y.n[at]), 0)
    if x.w is not None:
        shared = shared * x.w[s:e][place]
    return np.add.reduceat(shared, np.concatenate([[0], np.cumsum(y.length[js])[:-1]]))


def _multiplied(x: _Block, y: _Block, out: np.ndarray, code: tuple[np.ndarray, ...], at_x: np.ndarray, at_y: np.ndarray, row_x: np.ndarray, row_y: np.ndarray) -> np.ndarray:
    """Adds to ``out`` what pairs share of tokens (begin and count in x, in y) that many rows have; how often each row's token counted.

    The lesser of two numbers is the count of k that neither falls below: a column for each k that so many pairs reach."""
    bx, cx, by, cy = code
    sx, sy = int(row_x.min()), int(row_y.min())  # by weight, so the rows that may match are the last
    shape = len(x.total) - sx, len(y.total) - sy
    enough = MULTIPLIED * shape[0] * shape[1]
    upto = np.zeros(len(bx), np.int64)
    many = np.flatnonzero(cx * cy >= enough)
    if not len(many):
        return upto

    def entries(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the tokens' entries, and of their tokens."""
        return np.arange(count.sum()) + np.repeat(begin - np.cumsum(count) + count, count), np.repeat(np.arange(len(count)), count)

    def reached(a: _Block, at: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Rows that have each token k times at least, for each k from 1."""
        place, token = entries(begin, count)
        times = np.minimum(a.n[at[place]], most).astype(np.int64)
        found = np.bincount(token * most + times - 1, minlength=len(count) * most).reshape(-1, most)
        return np.cumsum(found[:, ::-1], axis=1)[:, ::-1]

    most = int(min(TIMES, x.n[at_x].max(), y.n[at_y].max()))
    for some in np.array_split(many, len(many) * most // MEETINGS + 1):
        upto[some] = (reached(x, at_x, bx[some], cx[some]) * reached(y, at_y, by[some], cy[some]) >= enough).sum(axis=1)
    columns = np.cumsum(upto[many])
    part = out.reshape(len(x.total), -1)[sx:, sy:]
    for some in np.split(many, np.unique(np.searchsorted(columns, np.arange(COLUMNS, columns[-1], COLUMNS)))):
        if not len(some):
            continue
        first = np.cumsum(upto[some]) - upto[some]

        def matrix(a: _Block, at: np.ndarray, begin: np.ndarray, count: np.ndarray, row: np.ndarray, start: int, weight: np.ndarray | None) -> np.ndarray:
            place, token = entries(begin, count)  # noqa: B023
            times = np.minimum(a.n[at[place]], upto[some][token]).astype(np.int64)  # noqa: B023
            column = np.arange(times.sum()) + np.repeat(first[token] - np.cumsum(times) + times, times)  # noqa: B023
            held = np.zeros((len(a.total) - start, int(upto[some].sum())))  # noqa: B023
            held[np.repeat(row[place] - start, times), column] = 1.0 if weight is None else np.repeat(weight[at[place]], times)
            return held

        part += matrix(x, at_x, bx[some], cx[some], row_x, sx, x.w) @ matrix(y, at_y, by[some], cy[some], row_y, sy, None).T
    return upto


def _beyond(a: _Block, row: np.ndarray, at: np.ndarray, begin: np.ndarray, count: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of tokens' entries those that a row has more than ``upto`` times: begin and count of each token, rows, places in the bags."""
    place = np.arange(count.sum()) + np.repeat(begin - np.cumsum(count) + count, count)
    token = np.repeat(np.arange(len(count)), count)
    more = a.n[at[place]] > upto[token]
    left = np.bincount(token[more], minlength=len(count))
    return np.cumsum(left) - left, left, row[place[more]], at[place[more]]


def _meetings(x: _Block, y: _Block, cut_x: np.ndarray, cut_y: np.ndarray, least_met: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row of x times rows of y plus row of y, weight met in the first parts) of the pairs that share a token there; with
    ``least_met`` first parts are whole bags, and only pairs that share about so much matter."""
    code_x, begin_x, count_x, row_x, at_x = x.first(cut_x)
    code_y, begin_y, count_y, row_y, at_y = y.first(cut_y)
    if not len(code_x) or not len(code_y):
        return np.zeros(0, np.int64), np.zeros(0)
    place = np.minimum(np.searchsorted(code_y, code_x), len(code_y) - 1)
    both = np.flatnonzero(code_y[place] == code_x)
    bx, cx, by, cy = begin_x[both], count_x[both], begin_y[place[both]], count_y[place[both]]
    cells = len(x.total) * len(y.total)
    dense = len(both) > 0 and int((cx * cy).sum()) > cells // 8
    out = np.zeros(cells) if dense else None
    beyond = np.zeros(len(both), np.int64)
    if dense and least_met is not None:
        beyond = _multiplied(x, y, out, (bx, cx, by, cy), at_x, at_y, row_x, row_y)
        bx, cx, row_x, at_x = _beyond(x, row_x, at_x, bx, cx, beyond)
        by, cy, row_y, at_y = _beyond(y, row_y, at_y, by, cy, beyond)
    upto = np.cumsum(cx * cy)
    keys, values = [], []
    ends = np.unique(np.searchsorted(upto, np.arange(MEETINGS, upto[-1], MEETINGS)) + 1) if len(upto) else []
    for part in np.split(np.arange(len(both)), ends):
        if not len(part):
            continue
        c, d = cx[part], cy[part]
        left = np.arange(c.sum()) + np.repeat(bx[part] - np.cumsum(c) + c, c)
        times = np.repeat(d, c)
        right = np.arange(times.sum()) + np.repeat(np.repeat(by[part], c) - np.cumsum(times) + times, times)
        over = np.repeat(np.repeat(beyond[part], c), times)
        left = np.repeat(left, times)
        i, j = row_x[left].astype(np.int64), row_y[right]
        if x is y:
            once = np.flatnonzero(i < j)
            left, right, i, j, over = left[once], right[once], i[once], j[once], over[once]
        value = np.minimum(x.n[at_x[left]], y.n[at_y[right]]) - over
        if x.w is not None:
            value *= x.w[at_x[left]]
        if dense:
            out += np.bincount(i * len(y.total) + j, value, cells)
        else:
            keys.append(i * len(y.total) + j)
            values.append(value)
    if dense:
        found = out > 0 if least_met is None or least_met <= 0 else out >= least_met
        if x.total[0] <= 0 and y.total[0] <= 0:  # bags that weigh nothing meet without weight
            found.reshape(len(x.total), -1)[np.ix_(x.total <= 0, y.total <= 0)] = True
        if x is y:
            found &= np.triu(np.ones((len(x.total), len(x.total)), bool), 1).ravel()
        key = np.flatnonzero(found)
        return key, out[key]
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0)
    key, value = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(key)
    key = key[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[begin], np.add.reduceat(value[order], begin) if len(key) else np.zeros(0)


def _pairs(x: _Block, y: _Block, name: str, t: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bags of x, bags of y, weight shared, equal lists) of pairs that may match; within a block each pair of different bags once."""

    def cuts(a: _Block, b: _Block) -> np.ndarray:
        need = np.maximum(needed(name, t, a.total, b.total[0]), least(name, t, a.total))
        return np.where(need <= a.total, a.cut(need, name), np.inf)

    cut_x, cut_y = cuts(x, y), cuts(y, x)
    whole = name == "overlap"  # then all that is shared has been met
    key, met = _meetings(x, y, cut_x, cut_y, t - 2e-6 if whole else None)
    i, j = key // len(y.total), key % len(y.total)
    p, q = x.total[i], y.total[j]
    need = needed(name, t, p, q)
    same = (x.same[i] == y.same[j]).all(axis=1)
    ok = np.flatnonzero((need <= np.minimum(p, q)) & (same | (met >= need) if whole else met >= need - np.maximum(cut_x[i], cut_y[j]) - 1e-6))
    i, j, need, same, met = i[ok], j[ok], need[ok], same[ok], met[ok]
    if not whole and len(i):
        ends = np.flatnonzero(i[1:] != i[:-1]) + 1
        parts = [js for some in np.split(np.arange(len(i)), ends) for js in np.array_split(some, len(some) // 256 + 1)]
        met = np.concatenate([_met(x, i[some[0]], y, j[some]) for some in parts])
    keep = np.flatnonzero((met > 0) & (met >= need) | same)
    for some in np.array_split(keep, len(keep) // ROWS_OUT + 1):
        if len(some):
            yield i[some], j[some], met[some], same[some]


def _of_rows(x: _Block, y: _Block, i: np.ndarray, j: np.ndarray, met: np.ndarray, same: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What pairs of bags are in rows; a bag and itself stand for each two rows that have it."""
    upto = np.cumsum(x.copies[i] * y.copies[j])
    for begin in range(0, int(upto[-1]), ROWS_OUT):
        at = np.arange(begin, min(begin + ROWS_OUT, int(upto[-1])))
        pair = np.searchsorted(upto, at, "right")
        p, q = i[pair], j[pair]
        a, b = np.divmod(at - upto[pair] + x.copies[p] * y.copies[q], y.copies[q])
        if x is y:
            once = np.flatnonzero((p != q) | (a < b))
            pair, p, q, a, b = pair[once], p[once], q[once], a[once], b[once]
        if len(pair):
            yield pa.RecordBatch.from_arrays([x.id.take(pa.array(x.from_id[p] + a)), y.id.take(pa.array(y.from_id[q] + b)), pa.array(x.total[p]), pa.array(y.total[q]), pa.array(met[pair]), pa.array(same[pair])], names=["id_x", "id_y", "total_x", "total_y", "met", "same"])


def _compare(x_path: str, y_path: str, name: str, t: float, n_rows: float):
    """Tasks (xs, ys: blocks) to (id_x, id_y, total_x, total_y, met, same); within one table a pair of blocks is compared once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.to_pylist():
                xs = {k: _Block(f"{x_path}/block={k}", name, t, n_rows) for k in task["xs"]}
                for k in task["ys"]:
                    y = xs[k] if k in xs and x_path == y_path else _Block(f"{y_path}/block={k}", name, t, n_rows)
                    for n, x in xs.items():
                        if x_path == y_path and n > k:
                            continue
                        for found in _pairs(x, y, name, t):
                            yield from _of_rows(x, y, *found)
                        if x is y and len(own := np.flatnonzero((x.copies > 1) & (needed(name, t, x.total, x.total) <= x.total))):
                            yield from _of_rows(x, x, own, own, x.total[own], np.ones(len(own), bool))
        give_back()

    return run


def _written(rows: DataFrame, paths: str | None, n_rows: float, others: float, frequent: np.ndarray, sample: DataFrame, one_in: int, least_size: int) -> tuple[str, list]:
    """Folder of the bags in blocks, and (block, low, high) of each. ``rows`` is (id, tokens)."""
    spark = rows.sparkSession
    least_size = max(1, least_size)
    of_frequent = _rows_with_frequent(spark, paths, frequent, others) if paths else None
    sizes = sample.groupBy(F.size("h").alias("size")).count().filter(F.col("size") >= least_size).orderBy("size").collect()  # as many as there are sizes
    starts, at = [(least_size, 0.0, 0.0)], 0.0
    for r in sizes:
        span = r["count"] * one_in * max(1 / BLOCK_ROWS, r["size"] / BLOCK_TOKENS)
        starts.append((r["size"], at, span))
        at += span
    hashed = rows.filter(F.size("tokens") >= least_size).select("id", (F.pmod(F.xxhash64("id", F.lit("block")), F.lit(1 << 20)) / F.lit(float(1 << 20))).alias("share"), F.transform("tokens", lambda x: F.xxhash64(x)).alias("h"))
    kind = dict(rows.dtypes)["id"]
    bags = hashed.mapInArrow(_bags(paths, n_rows, others, frequent, of_frequent, np.array(starts).T), f"id {kind}, same binary, block int, total double, tokens binary, times binary, dfs binary")
    path = new_path(spark, "blocks")
    with shuffles_removed(spark):
        bags.repartition(max(1, int(at) + 1), "block").write.partitionBy("block").option("compression", "zstd").parquet(path)
    fs, folder = open_fs(path)
    if paths:
        with fs.open_output_stream(f"{folder}/{BESIDE}") as out:
            pq.write_table(pa.table({"df": of_frequent}), out)
    if all(x.type != pafs.FileType.Directory for x in fs.get_file_info(pafs.FileSelector(folder))):
        return path, []
    found = spark.read.parquet(path).groupBy("block").agg(F.min("total").alias("low"), F.max("total").alias("high")).orderBy("block").collect()  # one of each block
    return path, [(r["block"], r["low"], r["high"]) for r in found]


def compare(a: DataFrame, b: DataFrame | None, name: str, t: float, weighted: bool, min_size: int, weigh: DataFrame | None = None) -> DataFrame:
    """(id_x, id_y, total_x, total_y, met, same) of the pairs of rows (id, tokens) that may match; rows of ``a`` are x if there is a ``b``.

    Tokens weigh as in ``weigh``, if it is given, else as in ``a``.
    """
    spark = a.sparkSession
    ship(spark)
    base = a if weigh is None else weigh
    n_rows = float(base.count())
    sample, one_in = _sample(a, n_rows if weigh is None else float(a.count()))
    frequent = _frequent(sample)
    paths = _frequencies(base.select(F.transform("tokens", lambda x: F.xxhash64(x)).alias("h")), 2 if base is a and b is None else 1) if weighted else None
    least_size = max(min_size, int(np.ceil(t)) if name == "overlap" and not weighted else 0)
    x_path, xs = _written(a, paths, n_rows, 1.0 if base is a else n_rows, frequent, sample, one_in, least_size)
    y_path, ys = _written(b, paths, n_rows, n_rows, frequent, *_sample(b, float(b.count())), least_size) if b is not None else (x_path, xs)  # a token that ``base`` has not weighs nothing

    def may(p: tuple, q: tuple) -> bool:
        low, high = (p, q) if p[2] <= q[2] else (q, p)
        small, large = low[2], max(low[2], high[1])
        return bool(needed(name, t, np.float64(small), np.float64(large)) <= small)

    together = max(1, min(TOGETHER, len(xs) // 16))
    groups = [xs[k : k + together] for k in range(0, len(xs), together)]
    near = [([p[0] for p in some], [q[0] for q in ys if any((b is not None or q[0] >= p[0]) and may(p, q) for p in some)]) for some in groups]
    share = max(1, min(8, sum(len(met) for _, met in near) // 128))
    tasks = [(some, met[i : i + share]) for some, met in near for i in range(0, len(met), share)]
    kind = dict(a.dtypes)["id"]
    schema = f"id_x {kind}, id_y {kind}, total_x double, total_y double, met double, same boolean"
    if not tasks:
        return spark.createDataFrame([], schema)
    todo = spark.createDataFrame(tasks, "xs array<int>, ys array<int>").repartition(min(len(tasks), 2000))
    return materialize(todo.mapInArrow(_compare(x_path, y_path, name, t, n_rows), schema), "pairs")
