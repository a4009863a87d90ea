"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector is turned by a random rotation, and the signs of the result are its code; the code's inner product with the
turned vector is stored as its correction factor. Dividing by it makes the estimate of an inner product with another
vector unbiased, and it gives the estimate's spread; only pairs whose upper confidence bound reaches the threshold are computed
exactly, and the exact value alone decides.

Candidates share, besides the label, the bits of one band of their codes. The number of bands is chosen so that a
pair at the threshold shares none with probability ``miss``. Equal vectors count as one with a weight, and a pair is looked at in
the first band that it shares only. A bucket of more than ``block`` vectors is cut into blocks that meet in pairs, in
tasks of their own.

Two rounds: first only codes travel, and the bits in which two codes differ bound the angle with ``SPREAD`` standard
deviations; vectors and factors are fetched for those rows of a bucket alone that have a partner within that bound.
No pair leaves its task: a bucket gives sums of links and edges that span what it linked. Buckets of a batch are
worked on together, as arrays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..plans.scratch import materialize, shuffle_partitions
from ..plans.ship import ship
from .common import column, mix64

#: Standard deviations of the confidence bound.
SPREAD = 6.0


def rotation(dim: int, bits: int, seed: int = 1) -> np.ndarray:
    """``dim`` rows of a random rotation of ``bits`` dimensions (``dim`` at least)."""
    q, r = np.linalg.qr(np.random.Generator(np.random.Philox(seed)).standard_normal((bits, bits)))
    return np.ascontiguousarray((q * np.sign(np.diag(r)))[:dim])


def codes(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs (as 0 and 1) and correction factors of unit vectors."""
    turned = unit @ turn
    return (turned > 0).astype(np.uint8), np.abs(turned).sum(axis=1) / math.sqrt(turn.shape[1])


def upper_bounds(signs: np.ndarray, factor: np.ndarray, turned: np.ndarray, spread: float = SPREAD) -> np.ndarray:
    """Upper confidence bounds of the inner products of coded vectors (rows) with turned ones (columns)."""
    bits = signs.shape[1]
    estimate = ((signs.astype(np.float32) * 2 - 1) @ turned.T.astype(np.float32)) / math.sqrt(bits) / factor[:, None]
    return estimate + (spread * np.sqrt(np.maximum(1 - factor**2, 0)) / factor / math.sqrt(bits - 1))[:, None]


def pair_bounds(signs: np.ndarray, factor: np.ndarray, turned: np.ndarray, spread: float = SPREAD) -> np.ndarray:
    """As ``upper_bounds``, of each coded vector with the turned one in the same row."""
    bits = signs.shape[1]
    estimate = np.einsum("ij,ij->i", signs.astype(np.float32) * 2 - 1, turned.astype(np.float32)) / math.sqrt(bits) / factor
    return estimate + spread * np.sqrt(np.maximum(1 - factor**2, 0)) / factor / math.sqrt(bits - 1)


def plan(rows: int, threshold: float, dim: int, miss: float, bucket: int = 32) -> tuple[int, int, int]:
    """Bits of a band, number of bands and bits of a code for ``rows`` vectors of one label. No band lies in two words."""
    band = min(32, max(8, math.ceil(math.log2(max(2, rows) / bucket))))
    shared = (1 - math.acos(min(1.0, threshold)) / math.pi) ** band
    bands = 1 if shared >= 1 else math.ceil(math.log(miss) / math.log(1 - shared))
    return band, bands, max(-(-max(256, dim) // 64), -(-bands // (64 // band))) * 64


def most_apart(threshold: float, bits: int, spread: float = SPREAD) -> int:
    """Most bits in which the codes of two vectors at the threshold differ, but for ``spread`` standard deviations."""
    p = math.acos(min(threshold, 1 - 1e-9)) / math.pi
    return math.ceil(bits * p + spread * math.sqrt(bits * p * (1 - p)))


def within(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of the same group, groups of these sizes following each other: those one apart, two apart and so on."""
    at = np.arange(int(sizes.sum()))
    after = np.repeat(np.cumsum(sizes), sizes) - at - 1
    rows, apart = at[after >= 1], 1
    while len(rows):
        yield rows, rows + apart
        apart += 1
        rows = rows[after[rows] >= apart]


def differ(words: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which codes differ."""
    out = np.zeros(len(x), np.int64)
    for w in range(words.shape[1]):
        out += np.bitwise_count(words[x, w] ^ words[y, w])
    return out


def met_before(words: np.ndarray, x: np.ndarray, y: np.ndarray, at: np.ndarray, band: int) -> np.ndarray:
    """Whether two codes share a band before the one they met in."""
    met, per, mask = np.zeros(len(x), bool), 64 // band, np.uint64((1 << band) - 1)
    for b in range(int(at.max()) if len(at) else 0):
        apart = ((words[x, b // per] ^ words[y, b // per]) >> np.uint64(b % per * band)) & mask
        met |= (apart == 0) & (b < at)
    return met


def exact(v: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines in double precision."""
    return np.einsum("ij,ij->i", v[x], v[y]) / (np.sqrt(np.einsum("ij,ij->i", v[x], v[x])) * np.sqrt(np.einsum("ij,ij->i", v[y], v[y])))


def linked(v: np.ndarray, signs: np.ndarray, words: np.ndarray, factor: np.ndarray, at: np.ndarray, side: np.ndarray, sizes: np.ndarray, turn: np.ndarray, band: int, threshold: float, few: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs of rows of the same group, each in the first band that it shares.

    ``side`` is 0 for rows that meet all others of their group, else rows meet those of another side. Groups of ``few`` rows or
    fewer go through lists of pairs, together; larger ones through products of matrices.
    """
    turned, most = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ turn, most_apart(threshold, signs.shape[1])
    out: list[np.ndarray] = []

    def settle(x: np.ndarray, y: np.ndarray) -> None:
        """Keeps the pairs whose exact value counts."""
        for lo in range(0, len(x), 1 << 16):
            i, j = x[lo : lo + (1 << 16)], y[lo : lo + (1 << 16)]
            fresh = ~met_before(words, i, j, at[i], band)
            i, j = i[fresh], j[fresh]
            hit = exact(v, i, j) >= threshold
            out.append(np.stack([i[hit], j[hit]]))

    small = np.repeat(sizes <= few, sizes)
    rows = np.flatnonzero(small)
    held, n = [], 0
    for i, j in within(sizes[sizes <= few]):
        i, j = rows[i], rows[j]
        ok = ((side[i] == 0) | (side[i] != side[j])) & (differ(words, i, j) <= most)
        i, j = i[ok], j[ok]
        for lo in range(0, len(i), 1 << 14):
            x, y = i[lo : lo + (1 << 14)], j[lo : lo + (1 << 14)]
            near = pair_bounds(signs[x], factor[x], turned[y]) >= threshold
            held.append((x[near], y[near]))
            n += int(near.sum())
        if n >= 1 << 16:
            settle(*map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if n:
        settle(*map(np.concatenate, zip(*held, strict=True)))
    ends = np.cumsum(sizes)
    for g in np.flatnonzero(sizes > few).tolist():
        first, last = int(ends[g] - sizes[g]), int(ends[g])
        for lo in range(first, last, 256):
            part = np.arange(lo, min(lo + 256, last))
            right = np.arange(lo + 1, last)
            near = upper_bounds(signs[part], factor[part], turned[right]) >= threshold
            near &= part[:, None] < right[None, :]
            near &= (side[part][:, None] == 0) | (side[part][:, None] != side[right][None, :])
            i, j = np.nonzero(near)
            settle(part[i], right[j])
    return tuple(np.concatenate(out, axis=1)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def spanning(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The least row that each of ``n`` rows reaches by the pairs."""
    root = np.arange(n)
    while True:
        least, old = np.minimum(root[x], root[y]), root.copy()
        np.minimum.at(root, x, least)
        np.minimum.at(root, y, least)
        root = root[root]
        if (root == old).all():
            return root


def _whole_groups(batches: Iterator[pa.RecordBatch], by: list[str], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """About ``rows`` rows at a time, groups never cut, with the groups' sizes."""
    held: list[pa.RecordBatch] = []

    def cut(t: pa.Table) -> np.ndarray:
        ids = np.stack([t.column(c).to_numpy() for c in by])
        return np.r_[0, np.flatnonzero((np.diff(ids, axis=1) != 0).any(axis=0)) + 1]

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            t = pa.Table.from_batches(held)
            starts = cut(t)
            if starts[-1]:
                yield t.slice(0, int(starts[-1])).combine_chunks(), np.diff(starts)
            held = t.slice(int(starts[-1])).combine_chunks().to_batches()
    held = [b for b in held if b.num_rows]
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, np.diff(np.r_[cut(t), t.num_rows])


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, miss: float = 1e-6, block: int = 2048, seed: int = 1) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding, label).

    Rows link when their labels are equal and not null and their cosine, in double precision, is at least
    ``threshold``. Vectors that are null, empty, zero or hold null or non-finite components, and those without a label or of another
    dimension, link with nothing, nor do rows with a null vec_id, whose component is null and which are not kept. Repeated rows
    are vectors like any other; other columns are left out.
    """
    spark = vectors.sparkSession
    ship(spark)
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists(x, lambda c: c != 0)
    # 0.0 and -0.0 are the same component
    v = F.when(fine, F.transform(x, lambda c: c + F.lit(0.0)))
    base = vectors.select("vec_id", F.col("label"), v.alias("v"))
    keyed = base.withColumns({"h1": F.when(F.col("v").isNotNull(), F.xxhash64("label", "v")), "h2": F.when(F.col("v").isNotNull(), F.hash("v", "label"))})
    reps = materialize(keyed.filter("v IS NOT NULL").groupBy("h1", "h2", "label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vectors")
    groups = reps.groupBy("label", F.size("v").alias("dim")).count().groupBy("dim").agg(F.max("count").alias("rows")).collect()
    plans = {r.dim: plan(r.rows, threshold, r.dim, miss) for r in groups}

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = np.array([len(a) for a in column(batch, "v").to_pylist()])
            for d in np.unique(dims).tolist():
                part = batch.take(pa.array(np.flatnonzero(dims == d)))
                band, n, bits = plans[d]
                turn = turns.setdefault(d, rotation(d, bits, seed))
                raw = column(part, "v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                signs, factor = codes(raw / np.linalg.norm(raw, axis=1, keepdims=True), turn)
                words = np.packbits(signs, axis=1, bitorder="little").view("<u8")
                per, at = 64 // band, np.arange(n)
                values = (words[:, at // per] >> (at % per * band).astype(np.uint64)[None, :]) & np.uint64((1 << band) - 1)
                salt = mix64(column(part, "group").to_numpy(zero_copy_only=False).view(np.uint64), 3)[:, None]
                keys = mix64(values + mix64(at.astype(np.uint64), 4)[None, :] + salt, 5).view(np.int64)
                yield pa.RecordBatch.from_arrays([column(part, "rep"), column(part, "n"), pa.array([r.tobytes() for r in raw], pa.binary()), pa.array([r.tobytes() for r in words], pa.binary()), pa.array(factor), pa.array(list(keys), pa.list_(pa.int64())), pa.array(np.full(len(raw), d, np.int32))], ["rep", "n", "raw", "code", "factor", "bands", "dim"])

    coded = materialize(reps.select("rep", "n", "v", F.xxhash64("label", F.size("v")).alias("group")).mapInArrow(code, "rep long, n long, raw binary, code binary, factor double, bands array<long>, dim int"), "codes")
    slots = coded.select("rep", "dim", "code", F.posexplode("bands").alias("at", "key"))
    large = materialize(coded.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > block), "buckets")
    if large.isEmpty():
        met = slots.withColumns({"lo": F.lit(0), "hi": F.lit(0), "mine": F.lit(0)})
    else:
        cuts = F.coalesce(F.ceil(F.col("m") / F.lit(block)), F.lit(1)).cast("int")
        shared = slots.join(large, "key", "left").withColumn("cuts", cuts).withColumn("mine", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("cuts")).cast("int"))
        met = shared.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).withColumns({"lo": F.least("mine", "other"), "hi": F.greatest("mine", "other")})
    by = ["key", "lo", "hi", "dim"]

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(shuffle_partitions(spark), *by).sortWithinPartitions(*by, "rep")

    def parts(t: pa.Table, sizes: np.ndarray) -> Iterator[tuple[int, pa.Table, np.ndarray, np.ndarray]]:
        """Rows of one dimension each: dimension, rows, group sizes and sides."""
        dims, same = t.column("dim").to_numpy(), t.column("lo").to_numpy() == t.column("hi").to_numpy()
        side = np.where(same, 0, 1 + t.column("mine").to_numpy())
        firsts = np.cumsum(sizes) - sizes
        for d in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == d)
            yield d, (t.take(pa.array(rows)) if len(rows) < t.num_rows else t), sizes[dims[firsts] == d], side[rows]

    def words_of(t: pa.Table, bits: int) -> np.ndarray:
        return np.frombuffer(b"".join(t.column("code").to_pylist()), "<u8").reshape(-1, bits // 64)

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of buckets that have a partner whose code is near enough, in the first band they share."""
        for t, sizes in _whole_groups(batches, by, 1 << 16):
            for d, rows, groups, side in parts(t, sizes):
                band, _, bits = plans[d]
                words, most, at = words_of(rows, bits), most_apart(threshold, bits), rows.column("at").to_numpy()
                hit = np.zeros(len(words), bool)
                for i, j in within(groups):
                    open_ = ~(hit[i] & hit[j]) & ((side[i] == 0) | (side[i] != side[j]))
                    i, j = i[open_], j[open_]
                    near = differ(words, i, j) <= most
                    i, j = i[near], j[near]
                    fresh = ~met_before(words, i, j, at[i], band)
                    hit[i[fresh]] = hit[j[fresh]] = True
                if hit.any():
                    yield from rows.select([*by, "mine", "at", "rep"]).filter(pa.array(hit)).combine_chunks().to_batches()

    near = materialize(dealt(met.select(*by, "mine", "at", "rep", "code")).mapInArrow(screen, "key long, lo int, hi int, dim int, mine int, at int, rep long"), "near")
    whole = dealt(near.join(coded.select("rep", "n", "raw", "code", "factor"), "rep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for t, sizes in _whole_groups(batches, by, 1 << 13):
            for d, rows, groups, side in parts(t, sizes):
                band, _, bits = plans[d]
                turn = turns.setdefault(d, rotation(d, bits, seed))
                words = words_of(rows, bits)
                signs = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
                v = np.frombuffer(b"".join(rows.column("raw").to_pylist())).reshape(-1, d)
                ids, n = rows.column("rep").to_numpy(), rows.column("n").to_numpy()
                x, y = linked(v, signs, words, rows.column("factor").to_numpy(), rows.column("at").to_numpy(), side, groups, turn, band, threshold)
                links = np.bincount(x, n[y], len(ids)).astype(np.int64) + np.bincount(y, n[x], len(ids)).astype(np.int64)
                root = spanning(x, y, len(ids))
                joined, counted = np.flatnonzero(root != np.arange(len(ids))), np.flatnonzero(links)
                a, b = np.r_[ids[counted], ids[joined]], np.r_[ids[counted], ids[root[joined]]]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=np.arange(len(b)) < len(counted)), pa.array(np.r_[links[counted], np.zeros(len(joined), np.int64)])], ["a", "b", "links"])

    found = materialize(whole.mapInArrow(run, "a long, b long, links long"), "links")
    links = found.filter("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    parts = connected_components(found.filter("b IS NOT NULL")).select(F.col("id").alias("rep"), "component")
    known = materialize(reps.select("h1", "h2", "rep", "n").join(links, "rep", "left").join(parts, "rep", "left"), "known")
    wide = keyed.select("vec_id", "h1", "h2").join(known.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "rep", "n", "links", "component"), (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    component = F.coalesce("component", "rep", "vec_id")
    return wide.select("vec_id", (F.coalesce("n", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
