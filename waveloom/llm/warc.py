"""WARC archives: written by task, read back as a chunked record table.

Payloads are streamed: a record is a header block and then chunks. The reader turns a record into rows
(record_id, chunk_no, data, n_bytes, digest) where digest is the SHA-256 of the payload up to and with
that chunk, so the last chunk's digest is the payload's and no step holds a whole record.
"""

from __future__ import annotations

import hashlib
import zlib
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waveloom.llm.bitmaps import flagged
from waveloom.llm.common import committed_file, fresh_path, materialize, open_fs, spread

CHUNK = 64 << 10
#: Equal payloads shorter than this are each written in full.
LEAST_REVISIT = 100
DATE = datetime(2024, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def record_types(df: DataFrame, id_col: str, payload_col: str, least: int = LEAST_REVISIT) -> DataFrame:
    """(id, digest, refers_to) of the rows that are revisits. Digests are computed in the scan; groups are reduced to
    their smallest id map-side, and joined back on the digest as narrow rows."""
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    keys = df.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(payload, 256)).alias("digest"), F.octet_length(payload).alias("n"))
    first = keys.where(F.col("n") >= least).groupBy("digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return keys.join(first, "digest", "inner").where("first_id is not null and not id <=> first_id").select("id", "digest", F.col("first_id").alias("refers_to")).distinct()


def _head(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n"


def name_of(page: int | None) -> str:
    return "none" if page is None else str(page)


def number_of(name: str) -> int | None:
    name = name.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "none" else int(name)


class _Members:
    """Gzip members in a row, one per record, as archives of this kind are read from any record on."""

    def __init__(self, out):
        self.out, self.z = out, None

    def write(self, data: bytes) -> None:
        self.z = self.z or zlib.compressobj(1, zlib.DEFLATED, 31)
        self.out.write(self.z.compress(data))

    def end(self) -> None:
        self.out.write(self.z.flush())
        self.z = None


def chunks_of(buffer: pa.Buffer, size: int = CHUNK):
    """Views of a value's bytes, copied nowhere."""
    view = memoryview(buffer)
    for at in range(0, len(view), size):
        yield view[at : at + size]


def write_archives(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", path: str | None = None, least: int = LEAST_REVISIT) -> DataFrame:
    """Write a record per row into ``.warc.gz`` files in the shared folder; the manifest: path, records.

    Of equal payloads of at least ``least`` bytes the smallest id is a response, the others are revisits
    of it without payload. A null payload counts as empty, a null url as an empty target. A null id
    is read back as one; it is a response only if no row with an id has the payload. Rows that repeat an id
    are records that repeat it.
    """
    path = path or fresh_path(df.sparkSession, "warc")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"))
    keyed = spread(rows).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    again = materialize(record_types(df, id_col, payload_col, least).withColumnsRenamed({"id": "again_id", "digest": "again_digest"}), "warc-revisits")
    # only payloads that may be revisits are moved
    marked = flagged(keyed, F.xxhash64("id", "digest"), again.select(F.xxhash64("again_id", "again_digest").alias("key")))
    moved = marked.where("may").join(again, F.col("id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left")
    typed = moved.select("id", "url", "payload", "refers_to").unionByName(marked.where("not may").select("id", "url", "payload", F.lit(None).cast("long").alias("refers_to")))

    def write(batches):
        file = members = name = None
        n = 0
        for batch in batches:
            ids, urls, refers = (batch.column(c).to_pylist() for c in ("id", "url", "refers_to"))
            payloads = batch.column("payload")
            for i, (page, url, target) in enumerate(zip(ids, urls, refers, strict=True)):
                if file is None:
                    name = f"{path}/part-{TaskContext.get().partitionId():06d}.warc.gz"
                    file = committed_file(name)
                    members = _Members(file.__enter__())
                value = payloads[i].as_buffer()
                digest = hashlib.sha256()
                for chunk in chunks_of(value):
                    digest.update(chunk)
                kind = "response" if target is None else "revisit"
                fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{name_of(page)}>"), ("WARC-Date", DATE), ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Payload-Digest", f"sha256:{digest.hexdigest()}")]
                if target is None:
                    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(value.size))]
                else:
                    fields += [("WARC-Refers-To", f"<urn:page:{target}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Content-Length", "0")]
                members.write(_head(fields))
                if target is None:
                    for chunk in chunks_of(value):
                        members.write(chunk)
                members.write(b"\r\n\r\n")
                members.end()
                n += 1
        if file is not None:
            file.__exit__(None, None, None)
            yield pa.RecordBatch.from_pydict({"path": [name], "records": pa.array([n], pa.int64())})

    return materialize(typed.mapInArrow(write, "path string, records long"), "warc-manifest")


class _Stream:
    """Bytes of a gzip file's members, in pieces of bounded size."""

    def __init__(self, file):
        self.file, self.z, self.held, self.raw = file, zlib.decompressobj(31), b"", b""

    def _more(self) -> bool:
        while True:
            if self.z.eof:  # a member has ended; the next begins
                self.raw, self.z = self.z.unused_data, zlib.decompressobj(31)
            self.raw = self.raw or self.file.read(CHUNK)
            if not self.raw:
                return False
            data = self.z.decompress(self.raw, CHUNK)
            self.raw = self.z.unconsumed_tail
            if data:
                self.held += data
                return True

    def line(self) -> bytes:
        while (at := self.held.find(b"\r\n")) < 0:
            if not self._more():
                rest, self.held = self.held, b""
                return rest
        out, self.held = self.held[:at], self.held[at + 2 :]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise EOFError("a record is cut short")
        out, self.held = self.held[:n], self.held[n:]
        return out

    def at_end(self) -> bool:
        return not self.held and not self._more()


def chunk_rows(file, size: int = CHUNK):
    """(record, record_id, chunk_no, data, n_bytes, digest so far, last, type, refers_to, header digest) per chunk;
    an empty payload is one empty chunk. Memory: one chunk."""
    stream, record = _Stream(file), 0
    while not stream.at_end():
        if not stream.line().startswith(b"WARC/"):
            raise ValueError("not a record")
        fields = {}
        while line := stream.line():
            k, _, v = line.partition(b":")
            fields[k.strip().lower()] = v.strip().decode()
        left, number, digest = int(fields[b"content-length"]), 0, hashlib.sha256()
        refers = fields.get(b"warc-refers-to")
        while True:
            data = stream.take(min(size, left))
            left -= len(data)
            digest.update(data)
            yield record, number_of(fields[b"warc-record-id"]), number, data, len(data), digest.hexdigest(), left == 0, fields[b"warc-type"], number_of(refers) if refers else None, fields[b"warc-payload-digest"].removeprefix("sha256:")
            number += 1
            if not left:
                break
        stream.take(4)
        record += 1


CHUNK_TABLE = "archive string, record long, record_id long, chunk_no long, data binary, n_bytes long, digest string, last boolean, record_type string, refers_to long, header_digest string"


def read_chunks(manifest: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunked record table of the archives. Archives are dealt to tasks; batches hold a few MB."""
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.string()]
    names = [c.split()[0] for c in CHUNK_TABLE.split(", ")]

    def read(batches):
        rows, held = [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                filesystem, place = open_fs(path)
                with filesystem.open_input_stream(place, compression=None) as file:
                    for row in chunk_rows(file, size):
                        rows.append((path, *row))
                        held += 200 + row[4]
                        if held > 4 << 20:
                            yield out()
                            rows, held = [], 0
        if rows:
            yield out()

    return manifest.select("path").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 2).mapInArrow(read, CHUNK_TABLE)


def records(chunks: DataFrame) -> DataFrame:
    """A row per record: record_id, payload_bytes, payload_digest, record_type, refers_to. Chunks are summed
    map-side. A revisit's bytes are those of the response that it refers to, by id and digest, as several records may
    share an id."""
    whole = chunks.groupBy("archive", "record").agg(
        F.first("record_id").alias("record_id"),
        F.sum("n_bytes").alias("n_bytes"),
        F.max_by("digest", "chunk_no").alias("digest"),
        F.first("record_type").alias("record_type"),
        F.first("refers_to", ignorenulls=True).alias("refers_to"),
        F.first("header_digest").alias("header_digest"),
    )
    whole = materialize(whole.drop("archive", "record"), "warc-records")
    responses = whole.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to"), F.col("digest").alias("header_digest")).agg(F.max("n_bytes").alias("there_bytes"))
    revisits = whole.where("record_type = 'revisit'").join(responses.withColumn("there_digest", F.col("header_digest")), ["refers_to", "header_digest"], "left")
    agree = lambda digest: F.when(F.col("header_digest") == digest, digest).otherwise(F.raise_error(F.lit("a payload differs from its digest")))
    return (
        whole.where("record_type = 'response'")
        .select("record_id", F.col("n_bytes").alias("payload_bytes"), agree(F.col("digest")).alias("payload_digest"), "record_type", "refers_to")
        .unionByName(revisits.select("record_id", F.col("there_bytes").alias("payload_bytes"), agree(F.col("there_digest")).alias("payload_digest"), "record_type", "refers_to"))
    )
