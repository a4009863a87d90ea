"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram binds its letters: each letter's vector is permuted (rotated)
by its place and the vectors are multiplied. A document bundles, that is adds, the vectors of all its n-grams; a
language's prototype bundles its documents, each scaled to length 1. The prototypes' common part is taken away,
and a document goes to the language whose prototype has the largest cosine with it.

Letters are what Unicode calls so, lower-cased; a stretch of anything else is one boundary letter. Only n-grams with
a letter count. Whole texts are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ship import ship
from .common import column, give_back, mix64, slices

UNDETERMINED = "und"
DIM, ORDER = 1024, 3
#: n-grams whose vectors are held at once, and documents bundled at once.
GRAMS_AT_ONCE, DOCS_AT_ONCE = 1024, 128


class Letters:
    """Maps code points to letters: 0 is the boundary, others are the lower-cased code point."""

    def __init__(self):
        self.known: dict[int, int] = {}
        self.table = np.full(0x110000, -1, np.int32)

    def of(self, codes: np.ndarray) -> np.ndarray:
        got = self.table[codes]
        if (got < 0).any():
            for c in np.unique(codes[got < 0]).tolist():
                ch = chr(c)
                low = ch.lower()
                self.table[c] = (ord(low) if len(low) == 1 else c) if ch.isalpha() else 0
            got = self.table[codes]
        return got


def vectors(letters: np.ndarray, dim: int) -> np.ndarray:
    """The letters' random vectors, made from the letter alone."""
    words = mix64(mix64(letters.astype(np.uint64), 11)[:, None] + np.arange(dim // 64, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15), 12)
    bits = np.unpackbits(words.view(np.uint8).reshape(len(letters), -1), axis=1)
    return (bits.astype(np.int8) * 2 - 1).reshape(len(letters), dim)


class Bundler:
    """Document vectors of batches of texts."""

    def __init__(self, dim: int = DIM, order: int = ORDER):
        self.dim, self.order, self.letters = dim, order, Letters()
        self.rotated: dict[int, np.ndarray] = {}

    def _grams(self, text: str) -> np.ndarray:
        """The text's n-grams as numbers of 21 bits a letter."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        x = self.letters.of(codes)
        x = np.concatenate(([0], x, [0])).astype(np.uint64)
        keep = np.ones(len(x), bool)
        keep[1:] = (x[1:] != 0) | (x[:-1] != 0)
        x = x[keep]
        if len(x) < self.order:
            return np.zeros(0, np.uint64)
        out = np.zeros(len(x) - self.order + 1, np.uint64)
        for i in range(self.order):
            out = (out << np.uint64(21)) | x[i : len(x) - self.order + 1 + i]
        return out[out != 0]

    def _letter(self, letter: int) -> np.ndarray:
        got = self.rotated.get(letter)
        if got is None:
            if len(self.rotated) > 4096:
                self.rotated.clear()
            v = vectors(np.array([letter]), self.dim)[0]
            got = self.rotated[letter] = np.stack([np.roll(v, self.order - 1 - i) for i in range(self.order)])
        return got

    def gram_vectors(self, grams: np.ndarray) -> np.ndarray:
        out = None
        for i in range(self.order):
            at = ((grams >> np.uint64(21 * (self.order - 1 - i))) & np.uint64(0x1FFFFF)).astype(np.int64)
            seen, back = np.unique(at, return_inverse=True)
            v = np.stack([self._letter(x)[i] for x in seen.tolist()])[back]
            out = v if out is None else out * v
        return out

    def bundle(self, texts: list[str | None]) -> np.ndarray:
        """Unit document vectors; zero where a text has no letter."""
        out = np.zeros((len(texts), self.dim), np.float32)
        grams = [self._grams(t) if t else np.zeros(0, np.uint64) for t in texts]
        lo = 0
        while lo < len(texts):
            hi, size = lo + 1, len(grams[lo])
            while hi < len(texts) and size + len(grams[hi]) <= 1 << 20:
                size += len(grams[hi])
                hi += 1
            doc = np.repeat(np.arange(hi - lo), [len(g) for g in grams[lo:hi]])
            seen, at = np.unique(np.concatenate(grams[lo:hi]), return_inverse=True)
            cells, n = np.unique(at.astype(np.int64) * (hi - lo) + doc, return_counts=True)
            gram, doc = cells // (hi - lo), cells % (hi - lo)
            for g in range(0, len(seen), GRAMS_AT_ONCE):
                a, b = np.searchsorted(gram, (g, g + GRAMS_AT_ONCE))
                v = self.gram_vectors(seen[g : g + GRAMS_AT_ONCE]).astype(np.float32)
                rows, local = np.unique(doc[a:b], return_inverse=True)
                counts = np.zeros((len(rows), len(v)), np.float32)
                counts[local, gram[a:b] - g] = n[a:b]
                out[lo + rows] += counts @ v
            lo = hi
        norm = np.linalg.norm(out.astype(np.float64), axis=1)
        return (out / np.where(norm > 0, norm, 1)[:, None]).astype(np.float32)


_BUNDLERS: dict[tuple[int, int], Bundler] = {}


def bundler(dim: int, order: int) -> Bundler:
    """The worker's bundler, kept between tasks."""
    if (dim, order) not in _BUNDLERS:
        _BUNDLERS[dim, order] = Bundler(dim, order)
    return _BUNDLERS[dim, order]


def train(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", per_lang: int = 2000, dim: int = DIM, order: int = ORDER) -> dict[str, np.ndarray]:
    """Prototypes of the languages named in the rows where ``learn`` holds.

    Fits on a bounded sample: ``per_lang`` distinct texts with a letter of each language (all, if there are fewer), those
    of the smallest hashes. Copies of a text count once. Every language that is named is learned; rows with a null doc_id are
    rows like any other, and ``learn`` decides on them. Vectors are added up by Spark; the driver gets one of each language.
    """
    ship(docs.sparkSession)
    labelled = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    rows = labelled.select(F.col(lang).alias("lang"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    distinct = rows.select("lang", "hash").distinct()
    # Joined by broadcast: a few bytes for each language, of which the driver holds a vector of 8 KB later on.
    sizes = F.broadcast(distinct.groupBy("lang").count())
    # Only hashes below a share that holds more than per_lang of them are sorted, so that a language's list is short: the share is
    # ten standard deviations and a hundred too large, and a list of fewer has a chance below 1e-20.
    share = F.lit(per_lang + 10 * per_lang**0.5 + 100) / F.col("count")
    near = distinct.join(sizes, "lang").filter(F.col("hash").cast("double") / F.lit(2.0**64) + 0.5 < share)
    hashes = near.groupBy("lang").agg(F.sort_array(F.collect_list("hash")).alias("hashes"))
    cuts = F.broadcast(hashes.select("lang", F.element_at("hashes", F.least(F.size("hashes"), F.lit(per_lang))).alias("cut")))
    picked = rows.join(cuts, "lang").filter("hash <= cut").groupBy("lang", "hash").agg(F.min("text").alias("text")).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, sums = bundler(dim, order), {}
        for batch in batches:
            for part in slices(batch, DOCS_AT_ONCE):
                v = b.bundle(column(part, "text").to_pylist())
                langs = np.array(column(part, "lang").to_pylist(), dtype=object)
                for x in sorted(set(langs)):
                    sums[x] = sums.get(x, 0) + v[langs == x].sum(axis=0, dtype=np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["lang", "sum"])
        give_back()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of a language's partial sums, which follow each other."""
        at, held = None, None
        for batch in batches:
            for lang_, data in zip(column(batch, "lang").to_pylist(), column(batch, "sum").to_pylist(), strict=True):
                if at is not None and lang_ != at:
                    yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([held.tobytes()], pa.binary())], ["lang", "sum"])
                held = np.frombuffer(data) + (held if lang_ == at else 0.0)
                at = lang_
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([held.tobytes()], pa.binary())], ["lang", "sum"])

    partial = picked.repartition(16).mapInArrow(run, "lang string, sum binary")
    total = partial.repartition(4, "lang").sortWithinPartitions("lang", "sum").mapInArrow(add, "lang string, sum binary")
    out = {r.lang: np.frombuffer(r.sum) for r in total.collect()}
    return {k: out[k] for k in sorted(out) if np.any(out[k])}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", dim: int = DIM, order: int = ORDER, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds the predicted language and the cosine with its prototype, cut to 0..1.

    ``und`` with score 0 if the text is null, empty or has no letter, or if nothing was learned. Ties go to the first
    name. All columns stay, rows too; a column that has the name of a result is replaced.
    """
    ship(docs.sparkSession)
    labels = sorted(prototypes)
    raw = np.stack([prototypes[k] / np.linalg.norm(prototypes[k]) for k in labels]) if labels else np.zeros((0, dim))
    mean = raw.mean(axis=0) if len(labels) > 1 else np.zeros(dim)
    centred = raw - mean
    centred /= np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)
    kept = [c for c in docs.columns if c not in names]
    at = kept.index(text)
    shift = mean.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, protos = bundler(dim, order), centred.astype(np.float32)
        for batch in batches:
            for part in slices(batch, DOCS_AT_ONCE):
                texts = part.column(at).to_pylist()
                v = b.bundle(texts)
                has = v.any(axis=1)
                v = v - shift
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                best = np.zeros(len(texts), np.int64)
                score = np.zeros(len(texts))
                if labels:
                    cos = v @ protos.T
                    best, score = cos.argmax(axis=1), np.clip(cos.max(axis=1).astype(np.float64), 0.0, 1.0)
                found = [labels[i] if h and labels else UNDETERMINED for i, h in zip(best.tolist(), has.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found), pa.array(np.where(has, score, 0.0))], [*kept, *names])
        give_back()

    schema = docs.select(*kept).schema.add(names[0], "string").add(names[1], "double")
    return docs.select(*kept).mapInArrow(run, schema)


def held_out(key: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the key as text leaves 1 by 3."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learned from those that are not held out."""
    prototypes = train(docs, ~held_out())
    slim = docs.select("doc_id", "text", held_out().alias("held_out"))
    return predict(slim, prototypes).select("doc_id", "held_out", "lang_pred", "score")
