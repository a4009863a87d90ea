"""Deterministic sharded WARC writer and reader.

Records are range-sorted by key, so each task writes one range of them. A task writes gzip members to a file of
a temporary name and starts another file once the compressed size reaches ``roll_bytes``; a finished file is
renamed, and only the manifest, which Spark commits as a whole, makes it part of the archive. Headers and
digests are made anew from the payloads, times are a parameter, so a task that runs again writes the
same bytes. Of records with equal payloads the one with the smallest key holds it; the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import materialize, new_path, shuffle_partitions, shuffles_removed
from ..plans.ship import ship
from .common import column, open_fs, slices

MANIFEST = "file string, records long, bytes long, sha1 string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest32(payload: Column) -> Column:
    """Upper-case base32 SHA-1 of a binary column, by built-in functions: five hex digits make four of base 32."""
    hex_ = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hex_, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def revisits(pages: DataFrame, min_revisit_bytes: int) -> DataFrame:
    """(page_id, digest, refers_to) of the records whose payload another one of a smaller page_id holds. Carries no payloads.

    Nobody refers to a record without a page_id; such a record revisits one that has one.

    Equal payloads may be a third of all rows: their owner is found by pre-aggregation, and the join's two sides
    are shuffled for it alone, so that Spark can split a large key.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    slim = pages.filter(F.octet_length(payload) >= min_revisit_bytes).select("page_id", digest32(payload).alias("digest"))
    slim = materialize(slim, "digests")
    owners = slim.groupBy("digest").agg(F.min("page_id").alias("owner"), F.count("*").alias("n")).filter("n > 1 AND owner IS NOT NULL").drop("n")
    return slim.join(materialize(owners, "owners"), "digest").filter("page_id IS NULL OR page_id <> owner").select("page_id", "digest", F.col("owner").alias("refers_to"))


def _name(page_id) -> str:
    return "null" if page_id is None else str(page_id)


def _uri(url: str | None, page_id) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:x-page:{_name(page_id)}"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, copy: int, date: str) -> bytes:
    """One WARC/1.1 record, uncompressed."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    block_digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{_name(page_id)}{f':{copy}' if copy else ''}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_uri(url, page_id)}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{block_digest}", f"Content-Type: application/http; msgtype={'response'}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, folder: str, roll_bytes: int = 64 << 20, min_revisit_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", partitions: int | None = None) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) below ``folder``; the manifest as a DataFrame.

    Null html is an empty payload, and a null url becomes a URN. Of repeated rows of one page_id and payload the first
    is the response and the others revisit it; a null page_id is written as "null", and of equal payloads only such records
    have, each is a response. An empty table gives an archive without files.
    """
    spark = pages.sparkSession
    ship(spark)
    pages = pages.select("page_id", "url", "html")
    none = F.lit(None)
    notes = revisits(pages, min_revisit_bytes).select("page_id", none.cast("string").alias("url"), none.cast("string").alias("html"), F.lit(0).alias("kind"), "digest", "refers_to")
    rows = pages.select("page_id", "url", "html", F.lit(1).alias("kind"), none.cast("string").alias("digest"), none.cast("long").alias("refers_to"))
    n = partitions or shuffle_partitions(spark)
    dealt = rows.unionByName(notes).repartitionByRange(n, "page_id").sortWithinPartitions("page_id", "kind", "url", "html", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        out = temp = sha = None
        records = size = files = 0
        done: list[tuple] = []

        def close() -> None:
            nonlocal out, files
            if out:
                out.close()
                name = f"part-{part:06d}-{files:05d}.warc.gz"
                fs.move(temp, f"{root}/{name}")
                done.append((name, records, size, sha.hexdigest()))
                out, files = None, files + 1

        page, owners, seen = -1, {}, {}
        for batch in batches:
            for piece in slices(batch, 256):
                for row in piece.to_pylist():
                    if row["page_id"] != page:
                        page, owners, seen = row["page_id"], {}, {}
                    if row["kind"] == 0:
                        owners[row["digest"]] = row["refers_to"]
                        continue
                    payload = (row["html"] or "").encode()
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    refers = owners.get(digest)
                    if refers is None and page is not None and digest in seen and len(payload) >= min_revisit_bytes:
                        refers = page
                    copy = len(seen) if digest not in seen else seen["copies"]
                    seen[digest] = True
                    seen["copies"] = seen.get("copies", 0) + 1
                    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
                    data = packer.compress(record(page, row["url"], payload, digest, refers, copy, date)) + packer.flush()
                    if out is None:
                        temp = f"{root}/.tmp-{part:06d}-{files:05d}-{attempt}"
                        out, sha, records, size = fs.open_output_stream(temp, compression=None), hashlib.sha1(), 0, 0
                    out.write(data)
                    sha.update(data)
                    records, size = records + 1, size + len(data)
                    if size >= roll_bytes:
                        close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["file", "records", "bytes", "sha1"])

    manifest = dealt.mapInArrow(run, MANIFEST)
    with shuffles_removed(spark):
        manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each gzip member of an archive."""
    while data:
        opener = zlib.decompressobj(31)
        raw = opener.decompress(data) + opener.flush()
        data = opener.unused_data
        head, _, rest = raw.partition(b"\r\n\r\n")
        headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        yield headers, rest[: int(headers["Content-Length"])]


class _Hashed:
    """A stream whose bytes are counted and hashed as they are read."""

    def __init__(self, stream):
        self.stream, self.size, self.sha = stream, 0, hashlib.sha1()

    def read(self, n: int) -> bytes:
        data = self.stream.read(n)
        self.size += len(data)
        self.sha.update(data)
        return data


def _members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Uncompressed gzip members of a stream, one in memory at a time."""
    opener, parts, data = zlib.decompressobj(31), [], b""
    while data or (data := stream.read(chunk)):
        parts.append(opener.decompress(data))
        data = b""
        if opener.eof:
            yield b"".join(parts)
            data, opener, parts = opener.unused_data, zlib.decompressobj(31), []


def read_warc(spark: SparkSession, folder: str, manifest: DataFrame | None = None) -> DataFrame:
    """Records of the archive's committed files, checked against their digests, and files against the manifest."""
    ship(spark)
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest") if manifest is None else manifest

    def number(urn: str) -> int | None:
        name = re.match(r"<urn:x-page:(null|-?\d+)", urn)[1]
        return None if name == "null" else int(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        for batch in batches:
            for name, records, size, sha1 in zip(*(column(batch, c).to_pylist() for c in ("file", "records", "bytes", "sha1")), strict=True):
                rows = []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    hashed = _Hashed(stream)
                    for raw in _members(hashed):
                        head, _, rest = raw.partition(b"\r\n\r\n")
                        h = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                        block = rest[: int(h["Content-Length"])]
                        http, _, payload = block.partition(b"\r\n\r\n")
                        said, digest = int(re.search(rb"Content-Length: (\d+)", http)[1]), h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if h["WARC-Type"] == "response" and (len(payload) != said or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                            raise ValueError(f"{name}: {h['WARC-Record-ID']} does not match its digest")
                        rows.append((number(h["WARC-Record-ID"]), said, digest, h["WARC-Type"], number(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None))
                if (len(rows), hashed.size, hashed.sha.hexdigest()) != (records, size, sha1):
                    raise ValueError(f"{name} is not the file of the manifest")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = max(1, min(shuffle_partitions(spark), manifest.count()))
    return manifest.repartition(files).mapInArrow(run, RECORDS)


def archive(pages: DataFrame) -> DataFrame:
    """Writes the pages as an archive in the shared folder and reads it back."""
    folder = new_path(pages.sparkSession, "warc")
    return read_warc(pages.sparkSession, folder, write_warc(pages, folder))
