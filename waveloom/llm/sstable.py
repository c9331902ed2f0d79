"""Sorted-string-table shards of token ids.

A shard holds a contiguous range of keys in ascending order. File layout, all numbers little-endian:

    blocks   zlib(entries); an entry is varint(shared key bytes), varint(other key bytes),
             varint(value bytes), the other key bytes, the value. A block's first entry shares nothing.
    index    a record per block: first key (17 bytes), u64 place, u32 bytes
    filter   Bloom filter bits
    footer   u64 index place, u64 index records, u64 filter place, u64 filter bits, u32 hashes,
             u64 entries, u64 ids, 8 bytes magic

A key is a byte that is 0 for a null identifier, else 1; the identifier, big-endian with its sign turned, so
that bytes order as numbers do; and the document's number among rows of that identifier. A value is ids as unsigned 16- or 32-bit integers behind
a byte that tells their width.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waveloom.llm.common import committed_file, fresh_path, materialize, open_fs, spread, worker
from waveloom.llm.packing import text_slices
from waveloom.llm.tokens import crc32, shared_encoder, vocabulary, with_end

MAGIC = b"WLSST\x00\x00\x01"
FOOTER = struct.Struct("<QQQQIQQ8s")
BLOCK = 64 << 10
BITS_PER_KEY, HASHES = 10, 7
#: Stands for a null identifier in the filter.
NO_ID = -(1 << 63)


KEY, RECORD = 17, 29


def key_of(doc_id: int | None, nth: int = 0) -> bytes:
    return struct.pack(">BQQ", 0, 0, nth) if doc_id is None else struct.pack(">BQQ", 1, (doc_id + (1 << 63)) & (1 << 64) - 1, nth)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:9])[0] - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(buffer: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buffer[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(ids: np.ndarray, bits: int) -> np.ndarray:
    h = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    a, b = h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return (a[:, None] + np.arange(HASHES, dtype=np.uint64) * b[:, None]) % np.uint64(bits)


class ShardWriter:
    """Appends entries in key order; holds one block, the sparse index and the identifiers."""

    def __init__(self, out, block: int = BLOCK):
        self.out, self.block = out, block
        self.at = self.ids = 0
        self.index, self.keys, self.held, self.first, self.last = [], [], bytearray(), b"", b""

    def add(self, doc_id: int, nth: int, ids: np.ndarray) -> None:
        key = key_of(doc_id, nth)
        shared = 0
        if self.held:
            while shared < KEY and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        narrow = not len(ids) or ids.max() < 1 << 16
        value = (b"\x02" if narrow else b"\x04") + np.ascontiguousarray(ids, "<u2" if narrow else "<u4").tobytes()
        self.held += _varint(shared) + _varint(KEY - shared) + _varint(len(value)) + key[shared:]
        self.held += value
        self.last = key
        self.keys.append(NO_ID if doc_id is None else doc_id)
        self.ids += len(ids)
        if len(self.held) >= self.block:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            packed = zlib.compress(self.held, 1)
            self.out.write(packed)
            self.index.append(self.first + struct.pack("<QI", self.at, len(packed)))
            self.at += len(packed)
            self.held = bytearray()

    def close(self) -> None:
        self._flush()
        bits = max(64, -(-len(self.keys) * BITS_PER_KEY // 64) * 64)
        bloom = np.zeros(bits, bool)
        bloom[_bloom_places(np.array(self.keys, np.int64), bits).ravel()] = True
        index, bloom = b"".join(self.index), np.packbits(bloom).tobytes()
        self.out.write(index + bloom + FOOTER.pack(self.at, len(self.index), self.at + len(index), bits, HASHES, len(self.keys), self.ids, MAGIC))


class ShardReader:
    """Reads a shard through a seekable file: footer and index at once, blocks as asked for."""

    def __init__(self, file):
        self.file = file
        file.seek(file.size() - FOOTER.size)
        place, n, bloom_at, self.bits, _, self.entries, self.n_ids, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        file.seek(place)
        index = file.read(RECORD * n)
        self.first = [index[i : i + KEY] for i in range(0, RECORD * n, RECORD)]
        self.blocks = [struct.unpack("<QI", index[i + KEY : i + RECORD]) for i in range(0, RECORD * n, RECORD)]
        file.seek(bloom_at)
        self.bloom = np.unpackbits(np.frombuffer(file.read(self.bits // 8), np.uint8))

    def _block(self, i: int):
        place, size = self.blocks[i]
        self.file.seek(place)
        data, at, key = zlib.decompress(self.file.read(size)), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            other, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + other]
            at += other
            yield key, np.frombuffer(data, "<u2" if data[at] == 2 else "<u4", (size - 1) // data[at], at + 1)
            at += size

    def __iter__(self):
        for i in range(len(self.blocks)):
            for key, ids in self._block(i):
                yield id_of(key), ids

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """Ids of a document, by the filter, then binary search of the block index."""
        if not self.bloom[_bloom_places(np.array([NO_ID if doc_id is None else doc_id], np.int64), self.bits)[0]].all():
            return None
        key = key_of(doc_id)
        if (i := bisect_right(self.first, key) - 1) >= 0:
            for found, ids in self._block(i):
                if found == key:
                    return ids
        return None


def write_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """Encode every text, append id 0, write shards in ascending id order into the shared folder. The
    manifest: path, first_id, entries, ids, start (ids in the shards before).

    Rows are dealt to shards by ranges of the id and sorted there. A null text counts as empty. A null
    id sorts before all others. Rows that repeat an id follow one another, ordered by text.
    A retried task writes the same file under the same name.
    """
    spark = df.sparkSession
    path, tokenizer = path or fresh_path(spark, "sst"), tokenizer or vocabulary("byte_bpe_50k.json")

    @worker
    def write(batches):
        encoder, writer, first, file, name, last, nth = shared_encoder(tokenizer, False), None, None, None, None, (), 0
        for whole in batches:
            for batch in text_slices(whole, "text"):
                keys = batch.column("id").to_pylist()
                offsets, ids = with_end(*encoder.encode(batch.column("text")))
                for i, key in enumerate(keys):
                    if writer is None:
                        first, name = key, f"{path}/{key_of(key)[:9].hex()}.sst"
                        file = committed_file(name)
                        writer = ShardWriter(file.__enter__())
                    nth = nth + 1 if key == last else 0
                    last = key
                    writer.add(key, nth, ids[offsets[i] : offsets[i + 1]])
        if writer is not None:
            writer.close()
            file.__exit__(None, None, None)
            yield pa.RecordBatch.from_pydict({"path": [name], "first_id": pa.array([first], pa.int64()), "entries": pa.array([len(writer.keys)], pa.int64()), "ids": pa.array([writer.ids], pa.int64())})

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # rows that repeat an id share a shard: ranges are cut between ids
    dealt = rows.repartitionByRange(max(rows.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions"))), "id").sortWithinPartitions("id", "text")
    shards = materialize(dealt.mapInArrow(write, "path string, first_id long, entries long, ids long"), "sst-manifest")
    before = Window.orderBy("first_id").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    return shards.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_shards(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and the ids) of every entry, from the files."""

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                filesystem, place = open_fs(path)
                with filesystem.open_input_file(place) as file:
                    rows = []
                    for doc_id, ids in ShardReader(file):
                        rows.append((doc_id, start, len(ids), crc32(ids), ids.tolist() if with_ids else None))
                        start += len(ids)
                        if len(rows) == 500:
                            yield out(rows)
                            rows = []
                    if rows:
                        yield out(rows)

    def out(rows):
        columns = list(zip(*rows, strict=True))
        arrays = [pa.array(c, pa.int64()) for c in columns[:4]] + ([pa.array(columns[4], pa.list_(pa.int64()))] if with_ids else [])
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<bigint>" * with_ids
    return spread(manifest.select("path", "start").repartition(manifest.sparkSession.sparkContext.defaultParallelism)).mapInArrow(read, schema)
