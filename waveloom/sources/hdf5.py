"""HDF5 datasets of two dimensions (rows x samples) by byte ranges, without an HDF5 library.

A file's index is read where it lies: superblock, object headers, groups, and of a chunked dataset the tree of its
chunks. It gives runs of rows with the byte ranges that hold them, a few numbers each. These are dealt over the
cluster, and every task reads the ranges of its runs: one large file is many tasks, and no task holds more than a run.

Understood of the format: superblocks 0 to 3, object headers 1 and 2, groups as symbol tables or compact links, numbers
of any width and byte order, contiguous, compact and chunked layouts (version 3, indexed by trees of version 1), deflate,
shuffle and checksum filters. All else is refused by name.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: signatures, message types, filters, the address of nothing.
SIGNATURE = b"\x89HDF\r\n\x1a\n"
DATASPACE, DATATYPE, LINK, LAYOUT, FILTERS, CONTINUATION, SYMBOLS = 1, 3, 6, 8, 11, 16, 17
DEFLATE, SHUFFLE, CHECKSUM = 1, 2, 3
NOWHERE = (1 << 64) - 1
#: Bytes of rows that a task reads at a time, and of a chunk's row of chunks at least.
RUN_BYTES = 4 << 20


def open_range(uri: str):
    """read(offset, size) of a file of any store that pyarrow reaches."""
    from pyarrow import fs

    if uri.startswith(("file:", "/")):
        filesystem, path = fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    else:
        filesystem, path = fs.FileSystem.from_uri(uri)
    source = filesystem.open_input_file(path)

    def read(offset: int, size: int) -> bytes:
        data = source.read_at(size, offset)
        if len(data) < size:
            raise ValueError(f"{uri} ends within {size} bytes at {offset}")
        return data

    return read


def unpack(layout: str, data: bytes, at: int = 0):
    return struct.unpack_from("<" + layout, data, at)


@dataclass
class Dataset:
    """Where and how a dataset lies. ranges: (first row, first column, address, bytes, filters that were left out)."""

    shape: tuple[int, ...] = ()
    kind: str = ""
    layout: str = ""
    chunk: tuple[int, ...] = ()
    filters: list[tuple[int, tuple[int, ...]]] = field(default_factory=list)
    ranges: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    compact: bytes = b""

    def runs(self) -> Iterator[tuple[int, int, list[tuple[int, int, int, int]]]]:
        """(first row, rows, [(first column, address, bytes, left out)]): rows that are read together."""
        rows, columns = self.shape
        width = columns * np.dtype(self.kind).itemsize
        if self.layout == "chunked":
            held: dict[int, list] = {}
            for row, column, *where in self.ranges:
                held.setdefault(row, []).append((column, *where))
            for row in range(0, rows, self.chunk[0]):
                yield row, min(self.chunk[0], rows - row), held.get(row, [])
        elif rows:
            step = max(1, RUN_BYTES // max(1, width))
            for row in range(0, rows, step):
                n = min(step, rows - row)
                yield row, n, [(0, a + row * width, n * width, 0) for _, _, a, _, _ in self.ranges]


class Reader:
    """The index of one file."""

    def __init__(self, read):
        self.read = read
        if self.read(0, 8) != SIGNATURE:
            raise ValueError("not an HDF5 file")
        version = self.read(8, 1)[0]
        if version <= 1:
            head = self.read(0, 100)
            sizes, at = head[13:15], 24 if version == 0 else 28
            self.base = unpack("Q", head, at)[0]
            self.root = unpack("Q", head, at + 40)[0]
        elif version <= 3:
            head = self.read(0, 48)
            sizes = head[9:11]
            self.base, self.root = unpack("Q", head, 12)[0], unpack("Q", head, 36)[0]
        else:
            raise ValueError(f"superblock version {version}")
        if sizes != b"\x08\x08":
            raise ValueError("addresses of other than 8 bytes")

    def at(self, address: int, size: int) -> bytes:
        return self.read(self.base + address, size)

    def messages(self, address: int) -> list[tuple[int, bytes]]:
        """(type, data) of an object header and its continuations."""
        out: list[tuple[int, bytes]] = []
        if self.at(address, 4) == b"OHDR":
            flags = self.at(address + 5, 1)[0]
            begin = address + 6 + (16 if flags & 32 else 0) + (4 if flags & 16 else 0)
            width = 1 << (flags & 3)
            size = int.from_bytes(self.at(begin, width), "little")
            blocks, head = [(begin + width, size)], 4 + (2 if flags & 4 else 0)
        else:
            version, _, _, _, size = unpack("BBHII", self.at(address, 12))
            if version != 1:
                raise ValueError(f"object header version {version}")
            blocks, head, flags = [(address + 16, size)], 8, None
        while blocks:
            begin, size = blocks.pop(0)
            data, i = self.at(begin, size), 0
            while i + head <= size:
                kind, n = unpack("HH", data, i) if flags is None else (data[i], unpack("H", data, i + 1)[0])
                content = data[i + head : i + head + n]
                i += head + n
                if kind == CONTINUATION:
                    where, length = unpack("QQ", content)
                    blocks.append((where, length) if flags is None else (where + 4, length - 8))
                else:
                    out.append((kind, content))
        return out

    def find(self, path: str) -> int:
        """The object header of a path from the root."""
        address = self.root
        for name in path.strip("/").split("/"):
            links = self.links(address)
            if name not in links:
                raise ValueError(f"no {path} in the file; it has {', '.join(sorted(links)) or 'nothing'}")
            address = links[name]
        return address

    def links(self, address: int) -> dict[str, int]:
        out: dict[str, int] = {}
        for kind, data in self.messages(address):
            if kind == SYMBOLS:
                tree, heap = unpack("QQ", data)
                out |= self.symbols(tree, unpack("Q", self.at(heap, 32), 24)[0])
            elif kind == LINK:
                flags, i = data[1], 2
                hard = True
                if flags & 8:
                    hard, i = data[i] == 0, i + 1
                i += (8 if flags & 4 else 0) + (1 if flags & 16 else 0)
                width = 1 << (flags & 3)
                n = int.from_bytes(data[i : i + width], "little")
                name = data[i + width : i + width + n].decode()
                if hard:
                    out[name] = unpack("Q", data, i + width + n)[0]
        return out

    def symbols(self, address: int, heap: int) -> dict[str, int]:
        if address == NOWHERE:
            return {}
        head = self.at(address, 24)
        out: dict[str, int] = {}
        if head[:4] == b"TREE":
            n = unpack("H", head, 6)[0]
            entries = self.at(address + 24, 16 * n + 8)
            for i in range(n):
                out |= self.symbols(unpack("Q", entries, 16 * i + 8)[0], heap)
        elif head[:4] == b"SNOD":
            n = unpack("H", head, 6)[0]
            for i in range(n):
                name, where = unpack("QQ", self.at(address + 8 + 40 * i, 16))
                out[self.text(heap + name)] = where
        else:
            raise ValueError("a group's node is neither a tree's nor of symbols")
        return out

    def text(self, address: int) -> str:
        out = b""
        while b"\0" not in out:
            out += self.at(address + len(out), 8)
        return out.split(b"\0")[0].decode()

    def dataset(self, path: str) -> Dataset:
        d = Dataset()
        for kind, data in self.messages(self.find(path)):
            if kind == DATASPACE:
                rank, at = data[1], 8 if data[0] == 1 else 4
                d.shape = unpack(f"{rank}Q", data, at)
            elif kind == DATATYPE:
                d.kind = number_kind(data)
            elif kind == FILTERS:
                d.filters = filter_list(data)
            elif kind == LAYOUT:
                layout = data
        if len(d.shape) != 2:
            raise ValueError(f"{path} has {len(d.shape)} dimensions, not rows and samples")
        if layout[0] != 3:
            raise ValueError(f"layout version {layout[0]}")
        d.layout = ("compact", "contiguous", "chunked")[layout[1]]
        if layout[1] == 0:
            d.compact = layout[4 : 4 + unpack("H", layout, 2)[0]]
        elif layout[1] == 1:
            where, size = unpack("QQ", layout, 2)
            d.ranges = [] if where == NOWHERE else [(0, 0, where + self.base, size, 0)]
        else:
            rank, tree = layout[2], unpack("Q", layout, 3)[0]
            d.chunk = unpack(f"{rank}I", layout, 11)[:2]
            d.ranges = list(self.chunks(tree, rank))
        return d

    def chunks(self, address: int, rank: int) -> Iterator[tuple[int, int, int, int, int]]:
        if address == NOWHERE:
            return
        head = self.at(address, 24)
        if head[:5] != b"TREE\x01":
            raise ValueError("a node is none of a tree of chunks")
        level, n, key = head[5], unpack("H", head, 6)[0], 8 + 8 * rank
        entries = self.at(address + 24, (key + 8) * n)
        for i in range(n):
            size, left_out, row, column = unpack("IIQQ", entries, (key + 8) * i)
            child = unpack("Q", entries, (key + 8) * i + key)[0]
            if level:
                yield from self.chunks(child, rank)
            else:
                yield row, column, child + self.base, size, left_out


def number_kind(data: bytes) -> str:
    """A numpy type of a datatype message of integers or floating point numbers."""
    kind, bits, size = data[0] & 15, data[1], unpack("I", data, 4)[0]
    if kind not in (0, 1):
        raise ValueError(f"datatype class {kind} is not of numbers")
    return (">" if bits & 1 else "<") + ("f" if kind == 1 else "i" if bits & 8 else "u") + str(size)


def filter_list(data: bytes) -> list[tuple[int, tuple[int, ...]]]:
    """(filter, values) of a pipeline, in the order of writing."""
    version, n, at = data[0], data[1], 8 if data[0] == 1 else 2
    out = []
    for _ in range(n):
        number = unpack("H", data, at)[0]
        named = version == 1 or number >= 256
        name = unpack("H", data, at + 2)[0] if named else 0
        values = unpack("H", data, at + (6 if named else 4))[0]
        at += 8 if named else 6
        at += -(-name // 8) * 8 if version == 1 else name
        out.append((number, unpack(f"{values}I", data, at)))
        at += 4 * values + (4 if version == 1 and values % 2 else 0)
    unknown = [f for f, _ in out if f not in (DEFLATE, SHUFFLE, CHECKSUM)]
    if unknown:
        raise ValueError(f"filter {unknown[0]}")
    return out


def unfiltered(data: bytes, filters: list[tuple[int, tuple[int, ...]]], left_out: int, width: int) -> bytes:
    """A chunk's bytes, its filters undone in reverse."""
    for i in range(len(filters) - 1, -1, -1):
        if left_out >> i & 1:
            continue
        number = filters[i][0]
        if number == DEFLATE:
            data = zlib.decompress(data)
        elif number == CHECKSUM:
            data = data[:-4]
        else:
            whole = len(data) // width * width
            data = np.frombuffer(data, np.uint8, whole).reshape(width, -1).T.tobytes() + data[whole:]
    return data


SPLITS = "path string, first long, n int, columns int, kind string, chunk int, filters array<int>, ranges array<struct<column:int,address:long,size:long,left_out:int>>, held binary"


def splits(files: DataFrame, dataset: str) -> DataFrame:
    """A row per run of rows of the files (path)."""

    def run(batches):
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                d = Reader(open_range(path)).dataset(dataset)
                for first, n, ranges in d.runs():
                    held = d.compact[first * d.shape[1] * np.dtype(d.kind).itemsize :] if d.layout == "compact" else None
                    rows.append({"path": path, "first": first, "n": n, "columns": d.shape[1], "kind": d.kind, "chunk": d.chunk[1] if d.chunk else d.shape[1], "filters": [f for f, _ in d.filters], "ranges": [dict(zip(("column", "address", "size", "left_out"), r, strict=True)) for r in ranges], "held": held})
            fields = pa.schema([("path", pa.string()), ("first", pa.int64()), ("n", pa.int32()), ("columns", pa.int32()), ("kind", pa.string()), ("chunk", pa.int32()), ("filters", pa.list_(pa.int32())), ("ranges", pa.list_(pa.struct([("column", pa.int32()), ("address", pa.int64()), ("size", pa.int64()), ("left_out", pa.int32())]))), ("held", pa.binary())])
            yield pa.RecordBatch.from_pylist(rows, fields)

    return files.mapInArrow(run, SPLITS)


def read_rows(runs: DataFrame) -> DataFrame:
    """(path, lead, samples) of runs of rows."""

    def run(batches):
        path = read = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != path:
                    path, read = row["path"], open_range(row["path"])
                kind = np.dtype(row["kind"])
                out = np.zeros((row["n"], row["columns"]), np.float32)  # rows that were never written are zeros
                if row["held"] is not None:
                    out[:] = np.frombuffer(row["held"], kind, out.size).reshape(out.shape)
                for r in row["ranges"]:
                    data = unfiltered(read(r["address"], r["size"]), [(f, ()) for f in row["filters"]], r["left_out"], kind.itemsize)
                    part = np.frombuffer(data, kind).reshape(-1, row["chunk"])[: row["n"], : row["columns"] - r["column"]]
                    out[:, r["column"] : r["column"] + part.shape[1]] = part
                samples = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, max(1, row["columns"]), dtype=np.int32)[: row["n"] + 1]), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([row["path"]] * row["n"]), pa.array(np.arange(row["first"], row["first"] + row["n"], dtype=np.int32)), samples], ["path", "lead", "samples"])

    return runs.repartition("path", "first").mapInArrow(run, "path string, lead int, samples array<float>")


def signals_hdf5(spark: SparkSession, path: str, dataset: str = "data") -> DataFrame:
    """(patient_id, lead, samples) of HDF5 files that hold a matrix of leads x samples, one file per person: the name of the
    file is the person. Only the files' names come from the listing; every task reads the bytes of its rows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.h5").load(path).select("path")
    rows = read_rows(splits(files, dataset))
    return rows.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("patient_id"), "lead", "samples")
