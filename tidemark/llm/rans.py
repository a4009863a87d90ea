"""Token ids in files of a static range asymmetric numeral system.

All blocks share one table of frequencies, counted over the whole corpus and scaled to a power of two. A block holds
a fixed number of ids, interleaved over many lanes that code as vectors; it names its sizes and a checksum,
and no block needs another one. A file lists where its blocks start (checkpoints) and its documents' ids and
lengths, so blocks, and any range of ids, can be decoded in parallel. Files follow ascending document ids;
a manifest, which Spark commits as a whole, names them with the number of ids before each.

File: ``TMRANS1\\0``, blocks, directory, footer. Block: ids u32, lanes u32, words u32, crc32 u32 (of what follows),
lane states u64, words u32. Directory: block offsets u64, document ids i64, document lengths u64. Footer: blocks
u64, documents u64, ids u64, first id's number u64, directory's offset u64, directory's crc32 u32, table's crc32 u32.
All numbers are little-endian.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import discard, materialize, new_path, shuffle_partitions, shuffles_removed
from ..plans.ship import ship
from .common import column, open_fs, slices
from .tokens import encoder

MAGIC = b"TMRANS1\0"
BLOCK, FOOTER = struct.Struct("<IIII"), struct.Struct("<QQQQQII")
LANES, BLOCK_IDS = 1024, 1 << 18
#: Least state of a lane; states shed and take 32-bit words.
LOW = 1 << 31
NULL_ID = -(1 << 63)
MANIFEST = "file string, docs long, ids long, first long, bytes long, crc32 long"


class Table:
    """Frequencies scaled to ``2**bits``; an id that never occurs has none and cannot be coded."""

    def __init__(self, counts: dict[int, int]):
        symbols = np.array(sorted(counts), dtype=np.int64)
        n = np.array([counts[s] for s in symbols.tolist()], dtype=np.float64)
        self.bits = min(24, max(12, int(16 * max(1, len(symbols)) - 1).bit_length()))
        size = 1 << self.bits
        if len(symbols) > size:
            raise ValueError(f"over {size} different ids")
        scaled = np.maximum(1, np.floor(n / max(n.sum(), 1.0) * size)).astype(np.int64)
        order = np.argsort(-n, kind="stable")
        while len(symbols) and (off := size - int(scaled.sum())):
            if off > 0:
                scaled[order[0]] += off
            else:
                for i in order:
                    take = min(int(scaled[i]) - 1, -off)
                    scaled[i] -= take
                    off += take
                    if not off:
                        break
        self._set(symbols, scaled)

    def _set(self, symbols: np.ndarray, scaled: np.ndarray) -> None:
        top = int(symbols[-1]) + 1 if len(symbols) else 1
        self.freq, self.cum = np.zeros(top, np.uint64), np.zeros(top, np.uint64)
        self.freq[symbols] = scaled
        self.cum[symbols] = np.cumsum(scaled) - scaled
        self.lookup = np.repeat(symbols, scaled).astype(np.uint32)

    def dump(self) -> bytes:
        symbols = np.flatnonzero(self.freq).astype("<u4")
        return zlib.compress(struct.pack("<II", self.bits, len(symbols)) + symbols.tobytes() + self.freq[symbols].astype("<u4").tobytes())

    @classmethod
    def load(cls, data: bytes) -> Table:
        raw = zlib.decompress(data)
        bits, n = struct.unpack_from("<II", raw)
        self = cls.__new__(cls)
        self.bits = bits
        self._set(np.frombuffer(raw, "<u4", n, 8).astype(np.int64), np.frombuffer(raw, "<u4", n, 8 + 4 * n).astype(np.int64))
        return self

    def encode(self, ids: np.ndarray, lanes: int = LANES) -> bytes:
        """A block of ids."""
        k, n = np.uint64(self.bits), len(ids)
        freq, cum = self.freq[ids], self.cum[ids]
        if n and not freq.all():
            raise ValueError("an id is not in the table")
        limit, low32, half = freq << np.uint64(63 - self.bits), np.uint64(0xFFFFFFFF), np.uint64(32)
        x, out = np.full(lanes, LOW, np.uint64), []
        for lo in range((n - 1) // lanes * lanes, -1, -lanes) if n else ():
            hi = min(n, lo + lanes)
            s, f = x[: hi - lo], freq[lo:hi]
            shed = s >= limit[lo:hi]
            out.append((s[shed] & low32).astype("<u4"))
            s = np.where(shed, s >> half, s)
            q = s // f
            x[: hi - lo] = (q << k) + (s - q * f) + cum[lo:hi]
        words = np.concatenate(out[::-1]) if out else np.zeros(0, "<u4")
        body = x.astype("<u8").tobytes() + words.tobytes()
        return BLOCK.pack(n, lanes, len(words), zlib.crc32(body)) + body

    def decode(self, data: bytes) -> np.ndarray:
        """Ids of a block, once its checksum holds."""
        n, lanes, count, crc = BLOCK.unpack_from(data)
        body = memoryview(data)[BLOCK.size : BLOCK.size + 8 * lanes + 4 * count]
        if zlib.crc32(body) != crc:
            raise ValueError("a block does not match its checksum")
        x, words = np.frombuffer(body, "<u8", lanes).copy(), np.frombuffer(body, "<u4", count, 8 * lanes).astype(np.uint64)
        k, mask, half, low = np.uint64(self.bits), np.uint64((1 << self.bits) - 1), np.uint64(32), np.uint64(LOW)
        ids, at = np.empty(n, np.uint32), 0
        for lo in range(0, n, lanes):
            hi = min(n, lo + lanes)
            s = x[: hi - lo]
            slot = s & mask
            got = self.lookup[slot]
            ids[lo:hi] = got
            s = self.freq[got] * (s >> k) + slot - self.cum[got]
            need = np.flatnonzero(s < low)
            s[need] = (s[need] << half) | words[at : at + len(need)]
            at += len(need)
            x[: hi - lo] = s
        return ids


class FileWriter:
    """Writes documents' ids to an open stream, block by block."""

    def __init__(self, stream, table: Table, table_crc: int, first: int, block_ids: int = BLOCK_IDS):
        self.stream, self.table, self.table_crc, self.first, self.block_ids = stream, table, table_crc, first, block_ids
        self.at = self.crc = 0
        self.offsets, self.keys, self.lengths, self.held, self.n_held, self.ids = [], [], [], [], 0, 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at, self.crc = self.at + len(data), zlib.crc32(data, self.crc)

    def add(self, key: int, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.lengths.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block_ids:
            self._blocks(self.block_ids)

    def _blocks(self, least: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        lo = 0
        while len(ids) - lo >= max(1, least):
            part = ids[lo : lo + self.block_ids]
            self.offsets.append(self.at)
            self._put(self.table.encode(part, min(LANES, max(1, len(part) // 64))))
            lo, self.ids = lo + len(part), self.ids + len(part)
        self.held, self.n_held = [ids[lo:]], len(ids) - lo

    def close(self) -> tuple[int, int, int, int]:
        """Documents, ids, bytes and crc32 of the file."""
        self._blocks(1)
        directory = np.array(self.offsets, "<u8").tobytes() + np.array(self.keys, "<i8").tobytes() + np.array(self.lengths, "<u8").tobytes()
        footer = FOOTER.pack(len(self.offsets), len(self.keys), self.ids, self.first, self.at, zlib.crc32(directory), self.table_crc)
        self._put(directory)
        self._put(footer)
        return len(self.keys), self.ids, self.at, self.crc


class FileReader:
    """Decodes a file from its checkpoints."""

    def __init__(self, file, table: Table, table_crc: int):
        self.file, self.table = file, table
        size = file.size()
        blocks, docs, self.ids, self.first, self.end, crc, used = FOOTER.unpack(file.read_at(FOOTER.size, size - FOOTER.size))
        directory = file.read_at(size - FOOTER.size - self.end, self.end)
        if file.read_at(len(MAGIC), 0) != MAGIC or used != table_crc or zlib.crc32(directory) != crc:
            raise ValueError("the file's directory or table does not match")
        self.offsets = np.frombuffer(directory, "<u8", blocks)
        self.keys = np.frombuffer(directory, "<i8", docs, 8 * blocks)
        self.lengths = np.frombuffer(directory, "<u8", docs, 8 * (blocks + docs)).astype(np.int64)

    def block(self, i: int) -> np.ndarray:
        lo = int(self.offsets[i])
        hi = int(self.offsets[i + 1]) if i + 1 < len(self.offsets) else self.end
        return self.table.decode(self.file.read_at(hi - lo, lo))

    def span(self, start: int, count: int, block_ids: int = BLOCK_IDS) -> np.ndarray:
        """Ids ``start`` to ``start + count`` of the file, by the blocks that hold them."""
        if count <= 0:
            return np.zeros(0, np.uint32)
        lo, hi = start // block_ids, min(len(self.offsets), -(-(start + count) // block_ids))
        got = np.concatenate([self.block(i) for i in range(lo, hi)])
        return got[start - lo * block_ids : start - lo * block_ids + count]

    def documents(self, start: int = 0, stop: int | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
        """(document, first id's number, ids) of the documents that start at ``start`` to before ``stop`` in the file, with a
        block or a document in memory at a time."""
        begins = np.cumsum(self.lengths) - self.lengths
        lo, hi = np.searchsorted(begins, start), len(begins) if stop is None else np.searchsorted(begins, stop)
        if lo >= hi:
            return
        block, at = self.block_of(int(begins[lo]))
        parts, held = [], 0
        if at:
            parts, block = [self.block(block)[at:]], block + 1
            held = len(parts[0])
        at = self.first + int(begins[lo])
        for key, n in zip(self.keys[lo:hi].tolist(), self.lengths[lo:hi].tolist(), strict=True):
            while held < n:
                parts.append(self.block(block))
                held, block = held + len(parts[-1]), block + 1
            ids = parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            yield key, at, ids[:n]
            parts, held, at = [ids[n:]] if n < len(ids) else [], len(ids) - n, at + n

    def block_of(self, number: int) -> tuple[int, int]:
        """The block that holds an id, and the id's place in it. All blocks of a file but the last hold the same number of ids."""
        size = BLOCK.unpack(self.file.read_at(BLOCK.size, int(self.offsets[0])))[0] if len(self.offsets) else 1
        return number // max(1, size), number % max(1, size)


def checksum(file, chunk: int = 8 << 20) -> int:
    """crc32 of a whole file."""
    crc = 0
    for at in range(0, file.size(), chunk):
        crc = zlib.crc32(file.read_at(min(chunk, file.size() - at), at), crc)
    return crc


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 2, partitions: int | None = None) -> DataFrame:
    """Tokenizes ``docs`` (doc_id, text) and writes their ids below ``folder``; the manifest as a DataFrame.

    A null or empty text is the end id alone. Documents follow ascending doc_id, nulls first; rows with equal ids
    follow each other. Other columns are left out, and an empty table gives an archive without files. The driver
    holds a bound for each partition and a count for each id of the vocabulary, nothing else.
    """
    spark = docs.sparkSession
    ship(spark)
    n = partitions or shuffle_partitions(spark)
    cuts = docs.select(F.col("doc_id").cast("double")).approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []
    bounds = np.array(sorted(set(cuts)), dtype=np.float64)

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        tail = b"" if end_id is None else np.array([end_id], dtype=e.width).tobytes()
        for batch in batches:
            for part in slices(batch, 256):
                keys = [NULL_ID if k is None else k for k in column(part, "doc_id").to_pylist()]
                ids = [e.encode(t) + tail for t in column(part, "text").to_pylist()]
                place = np.searchsorted(bounds, np.array(keys, dtype=np.float64), side="left")
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.binary()), pa.array(place, pa.int32())], ["doc_id", "ids", "part"])

    raw = f"{folder}-raw"

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keeps a partition's ids in one compressed file and counts them."""
        fs, root = open_fs(raw)
        fs.create_dir(root, recursive=True)
        task, width = TaskContext.get(), encoder(tokenizer).width
        name, counts, n_docs, writer = f"{root}/{task.partitionId():06d}", np.zeros(0, np.int64), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keep = pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "ids")], ["doc_id", "ids"])
            if writer is None:
                stream = fs.open_output_stream(f"{name}.{task.taskAttemptId()}", compression=None)
                writer = pa.ipc.new_stream(stream, keep.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            for part in slices(keep, 512):
                writer.write_batch(part)
                got = np.bincount(np.frombuffer(b"".join(column(part, "ids").to_pylist()), dtype=width))
                if len(got) > len(counts):
                    counts, got = got, counts
                counts[: len(got)] += got
                n_docs += part.num_rows
        if writer:
            writer.close()
            stream.close()
            fs.move(f"{name}.{task.taskAttemptId()}", name)
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen) + 1, task.partitionId()), pa.int64()), pa.array(np.r_[-1, seen], pa.int64()), pa.array(np.r_[n_docs, counts[seen]], pa.int64())], ["part", "id", "n"])

    dealt = docs.select("doc_id", "text").mapInArrow(tokenize, "doc_id long, ids binary, part int").repartitionById(n, "part").sortWithinPartitions("doc_id", "ids")
    counts = materialize(dealt.mapInArrow(hold, "part long, id long, n long"), "counts")
    sizes = {r.part: r.n for r in counts.groupBy("part").agg(F.sum(F.when(F.col("id") >= 0, F.col("n")).otherwise(0)).alias("n")).collect()}
    table = Table({r.id: r.n for r in counts.filter("id >= 0").groupBy("id").agg(F.sum("n").alias("n")).collect()})
    data = table.dump()
    crc = zlib.crc32(data)
    fs, root = open_fs(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/table", compression=None) as out:
        out.write(data)
    firsts, total = {}, 0
    for p in sorted(sizes):
        firsts[p], total = total, total + sizes[p]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        _, held = open_fs(raw)
        shared, width, done = Table.load(data), encoder(tokenizer).width, []
        for batch in batches:
            for p in column(batch, "id").to_pylist():
                name, temp = f"tokens-{p:06d}.rans", f"{root}/.tmp-{p:06d}-{TaskContext.get().taskAttemptId()}"
                with fs.open_output_stream(temp, compression=None) as stream, fs.open_input_stream(f"{held}/{p:06d}", compression=None) as source:
                    writer = FileWriter(stream, shared, crc, firsts[p])
                    for piece in pa.ipc.open_stream(source):
                        for key, ids in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                            writer.add(key, np.frombuffer(ids, dtype=width))
                    made = writer.close()
                fs.move(temp, f"{root}/{name}")
                done.append((name, made[0], made[1], firsts[p], made[2], made[3]))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["file", "docs", "ids", "first", "bytes", "crc32"])

    parts = spark.createDataFrame([(p,) for p in sorted(sizes)], "id long").repartition(max(1, len(sizes))) if sizes else spark.createDataFrame([], "id long")
    with shuffles_removed(spark):
        parts.mapInArrow(encode, MANIFEST).write.parquet(f"{folder}/manifest")
    discard(raw, spark)
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_tokens(spark: SparkSession, folder: str, task_ids: int = 16 * BLOCK_IDS) -> DataFrame:
    """doc_id, start, n_tokens and ids_le (little-endian unsigned 32-bit) of every document in the archive.

    A task takes the documents that start in ``task_ids`` ids of a file, found by its directory and decoded from its checkpoints,
    so a large file is decoded by many tasks. Files are held against the manifest: their size, documents, ids and, by the
    task of their first ids, their checksum; blocks, directory and table by their own checksums.
    """
    ship(spark)
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        with fs.open_input_stream(f"{root}/table", compression=None) as f:
            data = f.read()
        table, crc = Table.load(data), zlib.crc32(data)
        emit = lambda rows: pa.RecordBatch.from_arrays([pa.array([None if r[0] == NULL_ID else r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([len(r[2]) for r in rows], pa.int64()), pa.array([r[2].astype("<u4").tobytes() for r in rows], pa.binary())], ["doc_id", "start", "n_tokens", "ids_le"])
        for batch in batches:
            for name, docs, ids, first, size, crc32, part in zip(*(column(batch, c).to_pylist() for c in ("file", "docs", "ids", "first", "bytes", "crc32", "part")), strict=True):
                with fs.open_input_file(f"{root}/{name}") as file:
                    reader = FileReader(file, table, crc)
                    if (len(reader.keys), reader.ids, reader.first, file.size()) != (docs, ids, first, size):
                        raise ValueError(f"{name} is not the file of the manifest")
                    if part == 0 and checksum(file) != crc32:
                        raise ValueError(f"{name} does not match its checksum")
                    rows, held = [], 0
                    for row in reader.documents(part * task_ids, (part + 1) * task_ids):
                        rows.append(row)
                        held += len(row[2])
                        if held >= 2_000_000 or len(rows) >= 10_000:
                            yield emit(rows)
                            rows, held = [], 0
                    if rows:
                        yield emit(rows)

    parts = manifest.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("ids") - 1) / F.lit(task_ids)).cast("long")))))
    return parts.repartition(max(1, min(10_000, parts.count()))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_le binary")


def archive(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the documents' ids in the shared folder and reads them back."""
    folder = new_path(docs.sparkSession, "rans")
    write_tokens(docs, folder, tokenizer)
    return read_tokens(docs.sparkSession, folder)
