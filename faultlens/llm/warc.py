"""WARC archives: writing, normalising monolithic gzip, reading by offset.

A whole-file gzip stream cannot be entered in the middle.  The normaliser inflates such a
stream once, front to back, writes every record as a gzip member of its own, and
writes a sidecar index with the offset and length of each member.  Readers then seek.

Archives are files in the shared folder.  Every file is written under a temporary name and
renamed when complete; names depend on the partition only, so a task that is run again after
a lost executor replaces its file by an equal one.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.llm.common import discard, session, stored
from faultlens.session import unique_dir

MIN_REVISIT_BYTES = 100
LEVEL = 1
READ_BYTES = 1 << 18
OUT_BYTES = 8 << 20
SLICE_RECORDS = 20_000      # records a reading task takes from one archive
_DATE = "1970-01-01T00:00:00Z"      # pages carry no crawl time
_INDEX_ROW = struct.Struct("<QI")   # offset, length of a member


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder that executors share (local paths, file:, s3:, gs:, hdfs: ...)."""
    uri = re.sub(r"^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class _Placed:
    """A file that gets its name only when it is complete."""

    def __init__(self, uri: str):
        self.fs, self.path = _filesystem(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"

    def __enter__(self) -> BinaryIO:
        self.out = self.fs.open_output_stream(self.part)
        return self.out

    def __exit__(self, kind, *_) -> None:
        self.out.close()
        if kind is None:
            self.fs.move(self.part, self.path)
        else:
            self.fs.delete_file(self.part)


def _one_line(s: str | None) -> str:
    return re.sub(r"[\r\n]+", " ", s or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
           revisit: bool) -> bytes:
    """One uncompressed WARC/1.1 record.  A revisit has the HTTP head only, with the full payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}",
            "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}",
            f"Content-Length: {len(block)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _one_line(url))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers (lower-case names) and block of one record."""
    cut = raw.index(b"\r\n\r\n")
    lines = raw[:cut].decode().split("\r\n")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(head["content-length"])
    block = raw[cut + 4:cut + 4 + size]
    if not lines[0].startswith("WARC/") or len(block) != size:
        raise ValueError("broken WARC record")
    return {"head": head, "block": block}


def records_of(stream: BinaryIO) -> Iterator[bytes]:
    """The raw records of an inflated stream, whose end of record follows from its Content-Length."""
    buffer = bytearray()

    def fill(n: int) -> bool:
        while len(buffer) < n:
            more = stream.read(READ_BYTES)
            if not more:
                return False
            buffer.extend(more)
        return True

    while fill(1):
        looked = 0
        while (cut := buffer.find(b"\r\n\r\n", max(0, looked - 3))) < 0:
            looked = len(buffer)
            if not fill(looked + 1):
                raise ValueError("WARC stream ends inside a header")
        size = int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", buffer[:cut])[1])
        end = cut + 4 + size + 4
        if not fill(end) or buffer[end - 4:end] != b"\r\n\r\n":
            raise ValueError("WARC stream ends inside a record")
        yield bytes(buffer[:end])
        del buffer[:end]


class Inflated(io.RawIOBase):
    """Front-to-back reader of a gzip file with any number of members."""

    def __init__(self, raw: BinaryIO):
        self.raw, self.z, self.rest = raw, None, b""

    def read(self, n: int = READ_BYTES) -> bytes:
        while True:
            data = self.rest or self.raw.read(READ_BYTES)
            self.rest = b""
            if not data:
                if self.z is not None:
                    raise ValueError("gzip stream ends early")
                return b""
            self.z = self.z or zlib.decompressobj(31)
            out = self.z.decompress(data, n)
            self.rest = self.z.unconsumed_tail
            if self.z.eof:
                self.rest, self.z = self.z.unused_data, None
            if out:
                return out


def _gzip(raw: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def normalise(source: str, target: str) -> int:
    """Rewrite one archive as one gzip member per record, with ``target``.idx beside it; the number of records."""
    files, path = _filesystem(source)
    at = n = 0
    with files.open_input_stream(path, compression=None) as raw, _Placed(target) as out, \
            _Placed(target + ".idx") as index:
        for rec in records_of(Inflated(raw)):
            member = _gzip(rec)
            out.write(member)
            index.write(_INDEX_ROW.pack(at, len(member)))
            at, n = at + len(member), n + 1
    return n


def read_slice(archive: str, first: int, last: int) -> Iterator[bytes]:
    """Records ``first`` to ``last`` (exclusive) of a normalised archive, by their offsets."""
    files, path = _filesystem(archive)
    with files.open_input_file(path + ".idx") as f:
        f.seek(first * _INDEX_ROW.size)
        rows = list(_INDEX_ROW.iter_unpack(f.read((last - first) * _INDEX_ROW.size)))
    with files.open_input_file(path) as f:
        for offset, length in rows:
            f.seek(offset)
            yield zlib.decompress(f.read(length), 31)


def marked_pages(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, html (null as empty), digest and refers_to (the page_id of the first equal payload
    of at least ``min_bytes``, if that is another one)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    digest = F.sha2(F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary"), 256).alias("digest")
    firsts = (pages.select("page_id", html).where(F.octet_length("html") >= min_bytes)
              .select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest"))
              .groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    repeats, _ = stored(firsts.select("digest", "first"), "warc_repeats")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html, digest)
    joined = rows.join(repeats, "digest", "left")
    # A null id never is the first one; equal ids are both the response.
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", "digest", F.when(other, F.col("first")).alias("refers_to"))


def write_archives(marked: DataFrame, folder: str) -> DataFrame:
    """Write each partition as one whole-file gzip stream; (archive, records) per file."""
    session(marked)
    root_fs, root = _filesystem(folder)
    root_fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        n = 0
        with _Placed(target) as out:
            z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            for batch in batches:
                ids, urls, htmls, digests, refers = (batch.column(i) for i in range(5))
                for i in range(batch.num_rows):
                    ref = refers[i].as_py()
                    out.write(z.compress(record(ids[i].as_py(), urls[i].as_py(), htmls[i].as_py().encode(),
                                                digests[i].as_py(), ref, ref is not None)))
                    n += 1
            out.write(z.flush())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([n], pa.int64())], names=["archive", "records"])

    return stored(marked.select("page_id", "url", "html", "digest", "refers_to")
                  .mapInArrow(run, "archive string, records long"), "warc_written")[0]


def normalise_archives(spark: SparkSession, archives: DataFrame, folder: str) -> DataFrame:
    """Normalise every archive of ``archives`` (archive) into ``folder``, one task per file; (archive, records)."""
    session(archives)
    root_fs, root = _filesystem(folder)
    root_fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                target = f"{folder}/{source.rpartition('/')[2]}"
                n = normalise(source, target)
                yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([n], pa.int64())],
                                                 names=["archive", "records"])

    n_files = max(1, archives.count())
    return stored(archives.select("archive").repartition(n_files).mapInArrow(run, "archive string, records long"),
                  "warc_normalised")[0]


_READ = ("page_id long, url string, record_type string, payload_digest string, payload_bytes long, "
         "refers_to long, payload binary")


def _page_number(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def read_archives(archives: DataFrame, slice_records: int = SLICE_RECORDS) -> DataFrame:
    """The records of normalised archives (archive, records), read by offset.

    Columns: page_id, url, record_type, payload_digest, payload_bytes (of the full payload),
    refers_to, payload (null for a revisit).  The digest of each response is checked.
    """
    session(archives)
    n = F.col("records")
    slices = archives.where("records > 0").select("archive", n, F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((n - 1) / slice_records) * slice_records, F.lit(slice_records).cast("long"))).alias("first"))
    slices = slices.select("archive", "first", F.least(n, F.col("first") + slice_records).alias("last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in batches:
            for archive, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for raw in read_slice(archive, first, last):
                    rec = parse_record(raw)
                    head, block = rec["head"], rec["block"]
                    cut = block.index(b"\r\n\r\n")
                    length = int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", block[:cut])[1])
                    digest = head["warc-payload-digest"].removeprefix("sha256:")
                    payload = None
                    if head["warc-type"] == "response":
                        payload = block[cut + 4:]
                        if len(payload) != length or hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
                    out.append((_page_number(head["warc-record-id"]), head.get("warc-target-uri"), head["warc-type"],
                                digest, length, _page_number(head.get("warc-refers-to")), payload))
                    size += len(raw)
                    if size >= OUT_BYTES:
                        yield _batch(out)
                        out, size = [], 0
        if out:
            yield _batch(out)

    n_slices = max(1, slices.count())
    return slices.repartition(n_slices).mapInArrow(run, _READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    cols = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                      names=[c.split()[0] for c in _READ.split(", ")])


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as whole-file gzip WARC archives, normalise them, and read them
    back through the offset index: the columns of :func:`read_archives`, one row per input row.

    A null html is an empty payload; a null url writes no target; null page_ids are kept and never
    referred to; of rows with equal payloads and equal smallest page_id all are responses.
    Other columns are not read; an empty table gives an empty result.
    """
    spark = session(pages)
    mono, normal = unique_dir(spark, "llm", "warc_mono"), unique_dir(spark, "llm", "warc")
    written = write_archives(marked_pages(pages), mono)
    archives = normalise_archives(spark, written, normal)
    discard(spark, mono)
    return read_archives(archives)


# The contract in SQL (the archives themselves are checked by reading them back).
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= {MIN_REVISIT_BYTES} GROUP BY ALL)
SELECT page_id, payload_bytes, d.payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND payload_bytes >= {MIN_REVISIT_BYTES}"""
