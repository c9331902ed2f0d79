"""Files written here to the letter of the public format description, and read by byte ranges."""

import struct
import zlib

import numpy as np
import pytest

from waveloom.sources import hdf5

pack = lambda layout, *values: struct.pack("<" + layout, *values)
NOWHERE = hdf5.NOWHERE


def message(kind, data):
    data += b"\0" * (-len(data) % 8)
    return pack("HHBBH", kind, len(data), 0, 0, 0) + data


def header(messages, split=None):
    """An object header of version 1."""
    body = b"".join(messages)
    return pack("BBHIII", 1, 0, len(messages), 1, len(body), 0) + body


def datatype(kind):
    kind = np.dtype(kind)
    size, big = kind.itemsize, kind.byteorder == ">"
    if kind.kind == "f":
        bits = {4: (31, 23, 8, 0, 23, 127), 8: (63, 52, 11, 0, 52, 1023)}[size]
        return pack("BBBBI", 0x11, 0x20 | big, bits[0], 0, size) + pack("HHBBBBI", 0, 8 * size, bits[1], bits[2], bits[3], bits[4], bits[5])
    return pack("BBBBI", 0x10, (8 if kind.kind == "i" else 0) | big, 0, 0, size) + pack("HH", 0, 8 * size)


def dataspace(shape):
    return pack("BBBBI", 1, len(shape), 0, 0, 0) + pack(f"{len(shape)}Q", *shape)


def filters(names):
    out = pack("BB6x", 1, len(names))
    for number, values in names:
        out += pack("HHHH", number, 0, 1, len(values)) + pack(f"{len(values)}I", *values) + (b"\0" * 4 if len(values) % 2 else b"")
    return out


def write(path, matrix, chunk=None, level=None, shuffle=False, skip=(), compact=False, name="data", deep=False):
    """A file of superblock 0 with one dataset under the root: symbol table, local heap, layout version 3."""
    matrix = np.asarray(matrix)
    out = bytearray(96)

    def put(data):
        while len(out) % 8:
            out.append(0)
        at = len(out)
        out.extend(data)
        return at

    used = ([(hdf5.SHUFFLE, (matrix.itemsize,))] if shuffle else []) + ([(hdf5.DEFLATE, (level,))] if level else [])
    if compact:
        layout = pack("BBH", 3, 0, matrix.nbytes) + matrix.tobytes()
    elif chunk is None:
        layout = pack("BBQQ", 3, 1, put(matrix.tobytes()), matrix.nbytes)
    else:
        keys = []
        for r in range(0, matrix.shape[0], chunk[0]):
            for c in range(0, matrix.shape[1], chunk[1]):
                if (r, c) in skip:
                    continue
                block = np.zeros(chunk, matrix.dtype)
                part = matrix[r : r + chunk[0], c : c + chunk[1]]
                block[: part.shape[0], : part.shape[1]] = part
                data = block.tobytes()
                left_out = 0
                if shuffle and (r, c) == (0, 0):
                    left_out |= 1  # this chunk's shuffle was left out
                elif shuffle:
                    data = np.frombuffer(data, np.uint8).reshape(-1, matrix.itemsize).T.tobytes()
                data = zlib.compress(data, level) if level else data
                keys.append((pack("IIQQQ", len(data), left_out, r, c, 0), put(data)))
        end = pack("IIQQQ", 0, 0, matrix.shape[0], 0, 0)
        node = lambda depth, entries: put(b"TREE" + pack("BBHQQ", 1, depth, len(entries), NOWHERE, NOWHERE) + b"".join(k + pack("Q", a) for k, a in entries) + end)
        tree = node(0, keys)
        if deep:
            half = len(keys) // 2
            tree = node(1, [(keys[0][0], node(0, keys[:half])), (keys[half][0], node(0, keys[half:]))])
        layout = pack("BBBQIII", 3, 2, 3, tree, *chunk, matrix.itemsize)
    own = [message(hdf5.DATASPACE, dataspace(matrix.shape)), message(hdf5.DATATYPE, datatype(matrix.dtype)), *([message(hdf5.FILTERS, filters(used))] if used else []), message(hdf5.LAYOUT, layout)]
    # the layout stands in a continuation
    rest = put(own[-1])
    dataset = put(header([*own[:-1], message(hdf5.CONTINUATION, pack("QQ", rest, len(own[-1])))]))
    names = b"\0" * 8 + name.encode() + b"\0" * (8 - len(name) % 8)
    heap = put(b"HEAP" + pack("B3xQQQ", 0, len(names), NOWHERE, put(names)))
    symbols = put(b"SNOD" + pack("BBH", 1, 0, 1) + pack("QQII16x", 8, dataset, 0, 0))
    tree = put(b"TREE" + pack("BBHQQ", 0, 0, 1, NOWHERE, NOWHERE) + pack("QQQ", 0, symbols, 8))
    root = put(header([message(hdf5.SYMBOLS, pack("QQ", tree, heap))]))
    out[:96] = hdf5.SIGNATURE + pack("BBBBBBBBHHI", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0) + pack("QQQQ", 0, NOWHERE, len(out), NOWHERE) + pack("QQII", 0, root, 1, 0) + pack("QQ", tree, heap)
    path.write_bytes(bytes(out))


def write_new(path, matrix):
    """Superblock 2, object headers of version 2, a compact link; checksums are not looked at."""
    out = bytearray(48)

    def put(data):
        at = len(out)
        out.extend(data)
        return at

    data = put(matrix.tobytes())
    block = lambda messages: b"OHDR" + pack("BBB", 2, 0, sum(4 + len(m) for _, m in messages)) + b"".join(pack("BHB", k, len(m), 0) + m for k, m in messages) + b"\0" * 4
    space = pack("BBBB", 2, 2, 0, 1) + pack("QQ", *matrix.shape)
    dataset = put(block([(hdf5.DATASPACE, space), (hdf5.DATATYPE, datatype(matrix.dtype)), (hdf5.LAYOUT, pack("BBQQ", 3, 1, data, matrix.nbytes))]))
    root = put(block([(hdf5.LINK, pack("BBB", 1, 0, 4) + b"data" + pack("Q", dataset))]))
    out[:48] = hdf5.SIGNATURE + pack("BBBB", 2, 8, 8, 0) + pack("QQQQ", 0, NOWHERE, len(out), root) + b"\0" * 4
    path.write_bytes(bytes(out))


RNG = np.random.default_rng(4)
CASES = {
    "plain": (RNG.normal(size=(12, 50)).astype("<f4"), {}),
    "wide": (RNG.normal(size=(3, 7)).astype("<f8"), {}),
    "big": (RNG.integers(-999, 999, (5, 9)).astype(">i2"), {}),
    "held": (RNG.integers(0, 255, (2, 6)).astype("u1"), {"compact": True}),
    "chunks": (RNG.normal(size=(10, 23)).astype("<f4"), {"chunk": (4, 8)}),
    "deflated": (RNG.integers(-5, 5, (10, 23)).astype("<i4"), {"chunk": (3, 23), "level": 4}),
    "shuffled": (RNG.normal(size=(9, 20)).astype("<f4"), {"chunk": (4, 6), "level": 6, "shuffle": True, "deep": True}),
}


@pytest.mark.parametrize("name", CASES)
def test_index(tmp_path, name):
    matrix, how = CASES[name]
    write(tmp_path / "a.h5", matrix, **how)
    d = hdf5.Reader(hdf5.open_range(str(tmp_path / "a.h5"))).dataset("data")
    assert d.shape == matrix.shape and np.dtype(d.kind) == matrix.dtype
    assert sum(n for _, n, _ in d.runs()) == len(matrix)


def test_files(spark, tmp_path, monkeypatch):
    want = {}
    for name, (matrix, how) in CASES.items():
        write(tmp_path / f"{name}.h5", matrix, **how)
        want[name] = matrix.astype(np.float32)
    matrix = np.arange(80, dtype="<f4").reshape(8, 10)
    write(tmp_path / "holes.h5", matrix, chunk=(4, 5), skip={(4, 0)})
    want["holes"] = matrix.copy()
    want["holes"][4:, :5] = 0
    write_new(tmp_path / "new.h5", matrix)
    want["new"] = matrix
    write(tmp_path / "empty.h5", np.zeros((0, 4), "<f4"))
    (tmp_path / "other.txt").write_text("not read")
    got = {}
    for r in hdf5.signals_hdf5(spark, str(tmp_path)).collect():
        got.setdefault(r.patient_id, {})[r.lead] = r.samples
    assert got.keys() == want.keys()
    for name, rows in got.items():
        assert sorted(rows) == list(range(len(want[name])))
        assert (np.array([rows[i] for i in range(len(rows))], np.float32) == want[name]).all(), name


def test_a_file_is_many_tasks(spark, tmp_path, monkeypatch):
    matrix = RNG.normal(size=(40, 25)).astype("<f4")
    write(tmp_path / "a.h5", matrix)
    monkeypatch.setattr(hdf5, "RUN_BYTES", 700)
    d = hdf5.Reader(hdf5.open_range(str(tmp_path / "a.h5"))).dataset("data")
    runs = list(d.runs())
    assert [r[:2] for r in runs] == [(7 * i, 7) for i in range(5)] + [(35, 5)]
    assert [r[2][0][2] for r in runs] == [700] * 5 + [500]


def test_refusals(tmp_path):
    read = lambda: hdf5.Reader(hdf5.open_range(str(tmp_path / "a.h5"))).dataset("data")
    (tmp_path / "a.h5").write_bytes(b"x" * 200)
    with pytest.raises(ValueError, match="not an HDF5 file"):
        read()
    write(tmp_path / "a.h5", np.zeros((2, 2), "<f4"), name="other")
    with pytest.raises(ValueError, match="no data in the file; it has other"):
        read()
    with pytest.raises(ValueError, match="filter 32000"):
        hdf5.filter_list(filters([(32000, (1, 2, 3))]))
    with pytest.raises(ValueError, match="not of numbers"):
        hdf5.number_kind(pack("BBBBI", 0x13, 0, 0, 0, 8))
