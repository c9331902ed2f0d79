import hashlib
import struct
import zlib

import numpy as np
import pytest

from waveloom.llm import jpegmedia
from waveloom.llm.jpegmedia import ROW, Image, average_hash, canonical, encode_rows, payload_media, thumbnails


def brute(rows):
    out = []
    for i, t in rows:
        b = (t or "").encode()
        p = b.ljust(max(1, -(-len(b) // 192)) * 192)
        out.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    return sorted(out)


def test_payloads_against_brute_force(edge_docs, docs):
    for df in (edge_docs, docs, edge_docs.union(edge_docs)):
        got = payload_media(df).collect()
        assert sorted(tuple(r)[:5] for r in got) == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
        by = {}
        for r in got:
            assert by.setdefault(r.payload_sha256, r[5:]) == r[5:]


def test_long_texts_are_several_images(spark, monkeypatch):
    monkeypatch.setattr(jpegmedia, "TOGETHER", 1 << 20)
    text = "".join(chr(32 + i * i % 95) for i in range(2_100_000)) + "é漢🙂"
    rows = [(1, text), (2, "short")]
    got = payload_media(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted(tuple(r)[:5] for r in got) == brute(rows)
    assert {r.doc_id: r.feature.count(";") for r in got} == {1: 1, 2: 0}


def test_empty(no_docs):
    assert payload_media(no_docs).collect() == []


def test_every_byte_and_many_rows():
    rng = np.random.default_rng(1)
    samples = rng.integers(0, 256, (70, ROW), dtype=np.uint8)
    samples[3] = 255
    samples[4] = np.tile([0, 255], ROW // 2)
    images = np.array([1, 9, 60])
    files = encode_rows(samples, images)
    read = thumbnails([files[0] + files[1], files[2]])
    assert [len(r) for r in read] == [2, 1]
    assert (np.concatenate([t for r in read for _, _, t, _ in r]) == samples).all()
    assert read[1][0][:2] == (ROW * 8, 480)


def slow_encode(width, height, components, coefficients, restart, quant):
    """A baseline file bit by bit: coefficients[c][by][bx] = (dc, {k: ac}) of quantised values."""
    dc_counts, dc_symbols = [0, 1, 5, 1, 1, 1, 1, 1, 1] + [0] * 7, list(range(12))
    ac_symbols = [0, 1, 2, 3, 4, 0x11, 0x12, 0x21, 0xF0, 0x31, 0x05, 0xE1]
    ac_counts = [0, 2, 1, 3, 0, 2, 0, 4] + [0] * 8
    dc, ac = canonical(dc_counts, dc_symbols), canonical(ac_counts, ac_symbols)
    seg = lambda m, b: struct.pack(">BBH", 255, m, len(b) + 2) + b
    head = b"\xff\xd8" + seg(0xFE, b"a comment") + seg(0xDB, b"\x10" + struct.pack(">64H", *[quant] * 64))
    head += seg(0xC0, struct.pack(">BHHB", 8, height, width, len(components)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(components)))
    head += seg(0xC4, b"\0" + bytes(dc_counts) + bytes(dc_symbols) + b"\x10" + bytes(ac_counts) + bytes(ac_symbols))
    head += seg(0xDD, struct.pack(">H", restart)) if restart else b""
    head += seg(0xDA, bytes([len(components)]) + b"".join(bytes([i + 1, 0]) for i in range(len(components))) + b"\0\x3f\0")
    H, V = max(h for h, _ in components), max(v for _, v in components)
    across, down = -(-width // (8 * H)), -(-height // (8 * V))
    if len(components) == 1:
        components, across, down = [(1, 1)], -(-width // 8), -(-height // 8)
    own = lambda x: (abs(x).bit_length(), x if x >= 0 else x + (1 << abs(x).bit_length()) - 1)
    bits, body, pred, n = "", b"", [0] * len(components), 0

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")

    for m in range(across * down):
        if restart and m and m % restart == 0:
            body += flush(bits) + bytes([255, 0xD0 + n % 8])
            bits, pred, n = "", [0] * len(components), n + 1
        for c, (h, v) in enumerate(components):
            for by in range(v):
                for bx in range(h):
                    value, more = coefficients[c][m // across * v + by][m % across * h + bx]
                    size, low = own(value - pred[c])
                    pred[c] = value
                    code, k = dc[size]
                    bits += f"{code:0{k}b}" + (f"{low:0{size}b}" if size else "")
                    at = 1
                    for k in sorted(more):
                        while k - at > 15:
                            bits += "{:0{}b}".format(*ac[0xF0])
                            at += 16
                        size, low = own(more[k])
                        bits += "{:0{}b}".format(*ac[(k - at) << 4 | size]) + f"{low:0{size}b}"
                        at = k + 1
                    if at < 64:
                        bits += "{:0{}b}".format(*ac[0])
    return head + body + flush(bits) + b"\xff\xd9"


@pytest.mark.parametrize("components", [[(1, 1)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 1)] * 3])
@pytest.mark.parametrize("restart", [0, 3])
@pytest.mark.parametrize("size", [(8, 8), (50, 37), (97, 64)])
def test_files_of_other_writers(components, restart, size):
    rng = np.random.default_rng(7)
    width, height = size
    H, V = max(h for h, _ in components), max(v for _, v in components)
    across, down = -(-width // (8 * H)), -(-height // (8 * V))
    pick = [{}, {1: 1}, {1: -3, 2: 2, 20: 1}, {63: 1}, {2: 1, 4: -1, 56: -1}]
    wide = lambda h: across * h if len(components) > 1 else -(-width // 8)
    high = lambda v: down * v if len(components) > 1 else -(-height // 8)
    coefficients = [[[(int(rng.integers(-1000, 1000)), pick[rng.integers(len(pick))]) for _ in range(wide(h))] for _ in range(high(v))] for h, v in components]
    file = slow_encode(width, height, components, coefficients, restart, 3)
    ((w, h, thumb, ranked),) = thumbnails([file])[0]
    want = np.array([[b[0] for b in row] for row in coefficients[0]])[: thumb.shape[0], : thumb.shape[1]]
    assert (w, h) == size and not ranked
    assert (thumb == np.clip((want * 3 + 4 >> 3) + 128, 0, 255)).all()
    assert Image(file).end == len(file)


def test_broken_files_fail():
    good = encode_rows(np.full((2, ROW), 65, np.uint8), np.array([2]))[0]
    for bad in (b"GIF89a", good.replace(b"\xff\xc0", b"\xff\xc2"), good[:-2], good[:-30] + b"\xff\xd9"):
        with pytest.raises((ValueError, IndexError)):
            thumbnails([bad])


def test_hash_is_about_shape():
    t = np.add.outer(np.arange(64), np.arange(64)).astype(np.uint8)
    assert average_hash(t) == average_hash(t // 2 + 10) != average_hash(t[::-1])

