"""Exact Jaccard join of word n-gram sets by universe partition and pigeonhole.

Two sets that link differ in at most H elements, H following from the size. A hash deals the elements into m > H
segments, so at least m - H segments are equal. Segments are ranked by a global order that puts the most
selective (largest) first; by the prefix principle two sets that link have an equal segment among the first H + 1 of each,
and only that subset is indexed. A band of sizes may instead use m = H // 2 + 1 segments and index, besides each
segment, its one-deletion neighbourhood: then one segment pair differs in one element at most, and the
two meet there. Each band takes the allocation of the least cost: keys to move, and candidates expected at the
corpus's size. Every candidate is verified on whole sets. Nothing is missed and nothing false links, but for collisions
of 64-bit hashes: elements are such hashes, and a set is known by two of them and its size.

Equal sets count as one. Candidates come in two rounds: each index bucket first meets its smallest member
only; after the links found so far are closed transitively, members of a bucket in different components meet each other
(in blocks if there are many), unless sizes or parity sketches rule the pair out.
Members of one component need no further check, so a large group of near copies costs no square of its size.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..plans.scratch import collecting, discard, materialize, shuffle_partitions
from ..plans.ship import ship
from .common import column, give_back, grouped, mix64, slices, utf8_bytes

_U = np.uint64
SKETCH_BITS = 1024


class WordHashes(dict):
    """Bounded memory of 64-bit word hashes, about 15 MB."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


#: The worker's, kept between tasks.
_WORD_HASHES = WordHashes()


def shingles(texts: list[bytes | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, element) of the documents' n-gram sets: sorted, distinct, elements as 64-bit hashes.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Fewer than ``n`` words make one element together.
    """
    words = [(t or b"").lower().split() for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.fromiter(map(_WORD_HASHES.__getitem__, itertools.chain.from_iterable(words)), dtype=np.uint64, count=int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    h = mix64(flat, n)
    for j in range(1, n):
        h[: len(h) - j] = mix64(h[: len(h) - j] + flat[j:], n + j)
    full = np.maximum(sizes - n + 1, 0)
    doc = np.repeat(np.arange(len(texts)), full)
    at = np.arange(int(full.sum())) - np.repeat(np.cumsum(full) - full, full) + np.repeat(starts, full)
    elements = h[at]
    for d in np.flatnonzero((sizes > 0) & (sizes < n)).tolist():
        x = mix64(flat[starts[d] : starts[d] + 1], 64 + int(sizes[d]))
        for j in range(1, int(sizes[d])):
            x = mix64(x + flat[starts[d] + j], 64 + j)
        doc, elements = np.append(doc, d), np.append(elements, x)
    order = np.lexsort((elements, doc))
    doc, elements = doc[order], elements[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (elements[1:] != elements[:-1])
    return doc[fresh], elements[fresh]


@dataclass(frozen=True)
class Band:
    """Allocation of the sizes from ``lo`` to below ``hi``."""

    lo: int
    hi: int
    segments: int
    deletions: bool


def differ(size: int | np.ndarray, percent: int):
    """Largest symmetric difference of a set of this size and one that links with it and is no smaller."""
    return size * (100 - percent) // percent


def allocate(rows: int, percent: int, shared: float = 0.02, largest: int = 1 << 30) -> list[Band]:
    """The cheapest allocation of each band.

    The cost of a document is its keys plus the candidates that unrelated documents are expected to give it:
    ``rows * shared ** k`` for an indexed segment of k elements, ``shared`` being the chance that an element of one also is in
    the other. Bands go up to ``largest``, which no set can reach: a text in a column has less than 2**31 bytes, and two words
    take four of them with the blanks between.
    """
    if percent >= 100:
        return []
    lo = -(-percent // (100 - percent))
    out: list[Band] = []
    while lo < largest:
        hi = 2 * lo
        h = differ(hi - 1, percent)

        def cost(m: int, deletions: bool, lo: int = lo, hi: int = hi) -> float:
            total = 0.0
            for size in {lo, (lo + hi) // 2, hi - 1}:
                mean, left = size / m, float(m if deletions else min(m, differ(size, percent) + 1))
                keys = left + (size if deletions else 0)
                unlikely, p = 0.0, []
                for k in range(int(mean + 12 * math.sqrt(mean) + 12)):
                    p.append(math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)))
                for k in reversed(range(len(p))):
                    take = min(left, p[k] * m)
                    unlikely += take * (max(1, k) * shared ** max(0, k - 1) if deletions else shared**k)
                    left -= take
                total += keys + rows * (unlikely + left)
            return total

        choices = [(math.ceil(f * (h + 1)), False) for f in (1.0, 1.15, 1.3, 1.6, 2.0, 2.5)] + [(h // 2 + 1, True)]
        m, deletions = min(choices, key=lambda c: cost(*c))
        out.append(Band(lo, hi, m, deletions))
        lo = hi
    return out


def index_keys(doc: np.ndarray, elements: np.ndarray, n_docs: int, bands: list[Band], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, key) of the index entries; ``doc`` ascends."""
    sizes = np.bincount(doc, minlength=n_docs)
    lows = np.array([b.lo for b in bands], dtype=np.int64)
    own = np.searchsorted(lows, sizes, side="right") - 1
    out_doc, out_key = [], []
    for below in (0, 1):
        band = own - below
        use = band >= 0
        if below:  # also in the band below, if a partner can be there
            use &= (own >= 1) & (sizes * percent <= (lows[np.maximum(own, 0)] - 1) * 100)
        ids = np.flatnonzero(use)
        if not len(ids):
            continue
        local = np.full(n_docs, -1)
        local[ids] = np.arange(len(ids))
        mine = use[doc]
        d, e = local[doc[mine]], elements[mine]
        b = band[ids]
        m = np.array([x.segments for x in bands], dtype=np.int64)[b]
        off = np.cumsum(m) - m
        seg = (mix64(e, 41) % m[d].astype(np.uint64)).astype(np.int64)
        cell = off[d] + seg
        mixed = mix64(e, 42)
        order = np.argsort(cell, kind="stable")
        counts = np.bincount(cell, minlength=int(m.sum()))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed[order], dtype=np.uint64)))
        ends = np.cumsum(counts)
        total = sums[ends] - sums[ends - counts]
        owner = np.repeat(np.arange(len(ids)), m)
        place = (np.arange(len(owner)) - off[owner]) + (b[owner] << 40)
        key_of = lambda s, n, p: mix64(s + mix64(p.astype(np.uint64), 43) + mix64(n.astype(np.uint64), 44), 45)
        key = key_of(total, counts, place)
        deletions = np.array([x.deletions for x in bands])[b]
        rank = np.lexsort((key, -counts, owner))
        keep = np.arange(len(owner)) - off[owner] < np.where(deletions, m, np.minimum(m, differ(sizes[ids], percent) + 1))[owner]
        at = rank[keep]
        out_doc.append(ids[owner[at]])
        out_key.append(key[at])
        gone = deletions[d]
        if gone.any():
            c = cell[gone]
            out_doc.append(ids[d[gone]])
            out_key.append(key_of(total[c] - mixed[gone], counts[c] - 1, place[c]))
    if not out_doc:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    doc, key = np.concatenate(out_doc), np.concatenate(out_key)
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    return doc[fresh], key[fresh]


def _per_doc(doc: np.ndarray, n_docs: int, values: np.ndarray) -> np.ndarray:
    """Wrapping sums by document."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    ends = np.cumsum(np.bincount(doc, minlength=n_docs))
    return sums[ends] - np.concatenate((np.zeros(1, np.uint64), sums[ends][:-1]))


def signatures(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n, h1, h2 (of the set), keys and sketch of every document with a doc_id."""
    bands = allocate(docs.count(), percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 256):
                d, e = shingles(utf8_bytes(column(part, "text")), words)
                n_docs = part.num_rows
                sizes = np.bincount(d, minlength=n_docs)
                parity = (np.bincount(d * SKETCH_BITS + (mix64(e, 51) % _U(SKETCH_BITS)).astype(np.int64), minlength=n_docs * SKETCH_BITS) & 1).astype(np.uint8)
                sketch = np.packbits(parity).view(np.int64)
                words_at = pa.array(np.arange(n_docs + 1) * (SKETCH_BITS // 64), pa.int32())
                kd, key = index_keys(d, e, n_docs, bands, percent)
                offsets = np.concatenate(([0], np.cumsum(np.bincount(kd, minlength=n_docs))))
                keys = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(key.view(np.int64)))
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(sizes), pa.array(_per_doc(d, n_docs, mix64(e, 61)).view(np.int64)), pa.array(_per_doc(d, n_docs, mix64(e, 62)).view(np.int64)), keys, pa.ListArray.from_arrays(words_at, pa.array(sketch))], ["doc_id", "n", "h1", "h2", "keys", "sketch"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, h1 long, h2 long, keys array<long>, sketch array<long>")


def _buckets(entries: DataFrame) -> DataFrame:
    """(key, id, least) of the keys that two ids or more have. ``entries`` is (id, key).

    The least id of a key is pre-aggregated before it is shuffled, and joined back: a key that very many ids have is
    split by Spark like any skewed one, and no task holds a key's ids.
    """
    ends = entries.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").select("key", "least")
    return entries.join(materialize(ends, "keys"), "key").select("key", "id", "least")


def _possible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and parity sketches allow: no two sets differ in fewer elements than their sketches in bits."""
    side = lambda c: reps.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    gap = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    near = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return both.filter(near & (gap * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent))).select("a", "b")


def _verify(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    needed = materialize(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "needed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 256):
                d, e = shingles(utf8_bytes(column(part, "text")), words)
                offsets = np.concatenate(([0], np.cumsum(np.bincount(d, minlength=part.num_rows))))
                yield pa.RecordBatch.from_arrays([column(part, "id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(e.view(np.int64)))], ["id", "grams"])
        give_back()

    texts = docs.select(F.col("doc_id").alias("id"), "text").join(needed, "id", "left_semi")
    sets = materialize(texts.mapInArrow(run, "id long, grams array<long>"), "sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("grams").alias("y")), "b")
    met = F.size(F.array_intersect("x", "y"))
    return both.filter(F.lit(100) * met >= F.lit(percent) * (F.size("x") + F.size("y") - met)).select("a", "b")


def _across(rows: DataFrame, percent: int, block: int) -> DataFrame:
    """Pairs of bucket members in different components that sizes and sketches allow; a pair may come more than once.

    ``rows`` has key, id, component, n, sketch, members.
    """
    mine = F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")
    cut = rows.withColumn("cuts", F.ceil(F.col("members") / F.lit(block)).cast("int")).withColumn("mine", mine)
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).withColumns({"lo": F.least("mine", "other"), "hi": F.greatest("mine", "other")})
    dealt = met.select("key", "lo", "hi", "mine", "id", "component", "n", "sketch").repartition(shuffle_partitions(rows.sparkSession), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()  # a pair may share many buckets of this task

        def emit() -> pa.RecordBatch:
            pairs = sorted(found)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([x for _, x in pairs], pa.int64())], ["a", "b"])

        for t in grouped(batches, ["key", "lo", "hi"]):
            ids, comp, n, mine = (t.column(c).to_numpy() for c in ("id", "component", "n", "mine"))
            sketch = t.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
            lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
            left, right = np.flatnonzero(mine == lo), np.flatnonzero(mine == hi)
            for s in range(0, len(left), 256):
                rows = left[s : s + 256]
                x, y = n[rows][:, None], n[right][None, :]
                ok = (comp[rows][:, None] != comp[right][None, :]) & (np.minimum(x, y) * 100 >= np.maximum(x, y) * percent)
                if lo == hi:
                    ok &= np.arange(s, s + len(rows))[:, None] < np.arange(len(right))[None, :]
                i, j = np.nonzero(ok)
                p, q = rows[i], right[j]
                gap = np.zeros(len(p), np.int64)
                for w in range(sketch.shape[1]):
                    gap += np.bitwise_count(sketch[p, w] ^ sketch[q, w])
                near = gap * (100 + percent) <= (n[p] + n[q]) * (100 - percent)
                u, v = ids[p[near]], ids[q[near]]
                found.update(zip(np.minimum(u, v).tolist(), np.maximum(u, v).tolist(), strict=True))
                if len(found) > 500_000:
                    yield emit()
        if found:
            yield emit()
        give_back()

    return dealt.mapInArrow(run, "a long, b long")


def components(docs: DataFrame, words: int = 5, percent: int = 80, block: int = 1024) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    Two documents link when 100 * intersection >= percent * union of their sets. A null or empty text has
    no set and links with nothing. Rows with the same doc_id are one document of which each text may link; a null doc_id
    is its own component, null. Other columns are left out, and an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    with collecting() as made:
        sigs = materialize(signatures(docs, words, percent), "signatures")
        slim = materialize(sigs.select("doc_id", "n", "h1", "h2"), "sets")
        filled = sigs.filter("n > 0 AND doc_id IS NOT NULL")
        classes = materialize(slim.filter("n > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep")), "classes")
        named = classes.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "rep")
        reps = filled.join(named, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & (F.col("doc_id") == F.col("rep")), "left_semi")
        reps = materialize(reps.filter(F.size("keys") > 0).select(F.col("doc_id").alias("id"), "n", "keys", "sketch"), "representatives")
        discard(sigs)
        buckets = materialize(_buckets(reps.select("id", F.explode("keys").alias("key"))), "buckets")
        stars = materialize(buckets.filter("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct(), "stars")
        first = materialize(_possible(stars, reps, percent), "first")
        linked = materialize(_verify(docs, first, words, percent), "linked")
        parts = materialize(connected_components(linked), "parts")
        placed = materialize(buckets.join(parts, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")), "placed")
        open_ = placed.groupBy("key").agg(F.count("*").alias("members"), F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 <> c1").select("key", "members")
        rows = materialize(placed.join(materialize(open_, "open"), "key"), "rows").join(reps.select("id", "n", "sketch"), "id")
        second = materialize(_across(rows, percent, block).distinct().join(first, ["a", "b"], "left_anti"), "second")
        if not second.isEmpty():
            linked = linked.unionByName(_verify(docs, second, words, percent))
            parts = connected_components(linked)
        closed = classes.join(parts, F.col("rep") == F.col("id"), "left").select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("n").alias("gn"), F.coalesce("component", "rep").alias("component_id"))
        closed = materialize(closed, "closed")
    for path in made:
        if path not in (sigs._scratch_path, slim._scratch_path, closed._scratch_path):
            discard(path, spark)
    with_set = slim.filter("n > 0 AND doc_id IS NOT NULL").join(closed, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & (F.col("n") == F.col("gn")))
    without = slim.filter("n = 0 OR doc_id IS NULL").withColumn("component_id", F.col("doc_id"))
    return with_set.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(without.select("doc_id", F.col("n").alias("n_shingles"), "component_id"))


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` whose doc_id is the smallest of its component, all columns; of repeated rows of a doc_id and set one stays."""
    found = materialize(components(docs, words, percent), "components")
    gone = materialize(found.filter("doc_id <> component_id").select("doc_id").distinct(), "copies")
    kept = docs.join(gone, "doc_id", "left_anti") if not gone.isEmpty() else docs
    again = found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    again = materialize(again, "repeated")
    if again.isEmpty():
        return kept.select(*docs.columns)
    one = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, "doc_id", "left_anti").unionByName(one).select(*docs.columns)
