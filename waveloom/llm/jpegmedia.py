"""Baseline JPEG media columns: payload bytes as the DC values of 8x8 blocks, read back by parsing
markers, decoding the Huffman scan and keeping the luminance DC of each block, the image's thumbnail.

With a DC quantiser of 8 a block's mean is its DC value + 128 exactly, so a thumbnail holds one byte per
block without loss. Bytes are stored as their places in a fixed order in which those that follow one another in
text are near, as a scan codes differences; a file of ours says so in a comment. The decoder takes any baseline file: several components, sampling factors, AC
coefficients, with or without restart markers. Restart intervals are decoded in lockstep, one numpy lane
each, across all files of a batch that share tables.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waveloom.llm.common import materialize, spread
from waveloom.llm.packing import text_slices

#: Samples of a row, the unit that payloads are filled up to.
ROW = 192
#: Rows of an image at most: 8 x 8191 lines. A longer payload is several images in a row.
MOST_ROWS = 8191
#: Code lengths of our DC table by category (bits of the difference of neighbours). The AC table has one code: end
#: of block, one bit.
DC_LENGTHS = {3: 2, 2: 2, 1: 3, 4: 3, 0: 4, 7: 4, 6: 5, 5: 5, 8: 6}
#: Bytes that are frequent in text, in the order of their distance from the middle of the samples' range; all others
#: follow in their own order.
FREQUENT = b" etnaioshrdlu\xc3cm,.gpfbwvyq\nkzjx"
#: The comment of a file whose samples are places in that order.
RANKED = b"places of bytes"


def canonical(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length) of a table given as counts per length 1-16 and symbols in order."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            out[symbol] = code, length
            code += 1
        at += n
        code <<= 1
    return out


def _own_tables() -> tuple[list[int], list[int]]:
    symbols = sorted(DC_LENGTHS, key=lambda s: (DC_LENGTHS[s], s))
    return [sum(n == k for n in DC_LENGTHS.values()) for k in range(1, 17)], symbols


@lru_cache(1)
def byte_places() -> tuple[np.ndarray, np.ndarray]:
    """The sample of a byte, and the byte of a sample: 128, 129, 127, 130, 126, ... in the order of bytes."""
    order = [*FREQUENT, *(b for b in range(256) if b not in FREQUENT)]
    near = sorted(range(256), key=lambda x: (abs(2 * x - 257), -x))
    place, byte = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
    place[order], byte[near] = near, order
    return place, byte


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    counts, symbols = _own_tables()
    return (
        b"\xff\xd8"
        + _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")
        + _segment(0xFE, RANKED)
        + _segment(0xDB, b"\0" + bytes([8] + [1] * 63))
        + _segment(0xC0, struct.pack(">BHHB3B", 8, rows * 8, ROW * 8, 1, 1, 0x11, 0))
        + _segment(0xC4, b"\0" + bytes(counts) + bytes(symbols))
        + _segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\0")
        + _segment(0xDD, struct.pack(">H", ROW))
        + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    )


@lru_cache(1)
def _symbol_codes() -> tuple[np.ndarray, np.ndarray]:
    """(bits, length) of difference -255..255 with its category code, its own bits and the end of block."""
    codes = canonical(*_own_tables())
    bits, length = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        k = abs(d).bit_length()
        code, n = codes[k]
        bits[d + 255] = (code << k | (d if d >= 0 else d + (1 << k) - 1)) << 1
        length[d + 255] = n + k + 1
    return bits, length


def encode_rows(samples: np.ndarray, images: np.ndarray) -> list[bytes]:
    """Files of 8-bit samples laid out as rows x 192; images: rows of each file. Every row is a restart
    interval. All rows of a call are coded together."""
    rows = len(samples)
    diff = np.empty((rows, ROW), np.int16)
    diff[:, 0] = samples[:, 0].astype(np.int16) - 128
    np.subtract(samples[:, 1:], samples[:, :-1], out=diff[:, 1:], dtype=np.int16)
    bits_of, length_of = _symbol_codes()
    at = diff + np.int16(255)
    length = np.empty((rows, ROW + 1), np.int64)
    length[:, :ROW] = length_of[at]
    total = length[:, :ROW].sum(1)
    length[:, ROW] = -total % 8  # ones up to the byte
    bits = np.empty((rows, ROW + 1), np.uint64)
    bits[:, :ROW] = bits_of[at]
    bits[:, ROW] = (np.uint64(1) << length[:, ROW].astype(np.uint64)) - np.uint64(1)
    ends = np.cumsum(length.ravel())
    begin = ends - length.ravel()
    word = begin >> 5
    shift = (64 - (begin & 31) - length.ravel()).astype(np.uint64)
    value = bits.ravel() << shift
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    sums = np.add.reduceat(value, first)
    words = np.zeros(int(ends[-1] >> 5) + 2, np.uint64)
    words[word[first]] += sums >> np.uint64(32)
    words[word[first] + 1] += sums & np.uint64(0xFFFFFFFF)
    stream = words.astype(">u4").view(np.uint8)[: int(ends[-1] >> 3)]
    row_bytes = (total + length[:, ROW]) >> 3
    row_end = np.cumsum(row_bytes)
    # a zero after each 0xFF, a restart marker after each row but a file's last, there the end marker
    full = stream == 255
    row_of = np.repeat(np.arange(rows), row_bytes)
    place = np.arange(len(stream)) + np.cumsum(full) - full + 2 * row_of
    out = np.zeros(len(stream) + int(full.sum()) + 2 * rows, np.uint8)
    out[place] = stream
    mark = place[row_end - 1] + 1 + full[row_end - 1]
    out[mark] = 255
    last = np.cumsum(images) - 1
    nth = np.arange(rows) - np.repeat(last + 1 - images, images)
    out[mark + 1] = 0xD0 + nth % 8
    out[mark[last] + 1] = 0xD9
    cut = np.concatenate([[0], mark[last] + 2])
    return [_header(int(n)) + out[a:b].tobytes() for n, a, b in zip(images, cut[:-1], cut[1:], strict=True)]


# ---------------------------------------------------------------- decoding


class Image:
    """What the markers of one file say, and its scan's intervals (without stuffed zeros)."""

    def __init__(self, data: bytes, at: int = 0):
        self.quant, self.tables, self.restart, self.ranked = {}, {}, 0, False
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        at += 2
        while True:
            if data[at] != 0xFF:
                raise ValueError("a marker is missing")
            marker = data[at + 1]
            if marker == 0xFF:  # fill byte
                at += 1
                continue
            size = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                i = 0
                while i < len(body):
                    wide, table = body[i] >> 4, body[i] & 15
                    self.quant[table] = struct.unpack_from(">H", body, i + 1)[0] if wide else body[i + 1]
                    i += 129 if wide else 65
            elif marker in (0xC0, 0xC1):
                if body[0] != 8:
                    raise ValueError("samples are not of 8 bits")
                self.height, self.width = struct.unpack_from(">HH", body, 1)
                self.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a baseline file")
            elif marker == 0xC4:
                i = 0
                while i < len(body):
                    counts = body[i + 1 : i + 17]
                    n = sum(counts)
                    self.tables[body[i]] = bytes(counts) + body[i + 17 : i + 17 + n]
                    i += 17 + n
            elif marker == 0xFE:
                self.ranked = body == RANKED
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                if body[0] != len(self.components):
                    raise ValueError("components in scans of their own")
                chosen = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
                break
        self.coding = tuple((h, v, self.tables[chosen[c] >> 4], self.tables[16 | chosen[c] & 15]) for c, h, v, _ in self.components)
        if len(self.components) == 1:  # one component: a block is a unit of its own
            self.coding = ((1, 1, *self.coding[0][2:]),)
        across, down = max(c[1] for c in self.components), max(c[2] for c in self.components)
        if len(self.components) == 1:
            across = down = 1
        self.mcus_across, self.mcus_down = -(-self.width // (8 * across)), -(-self.height // (8 * down))
        # blocks of the luminance that hold pixels
        h, v = self.coding[0][:2]
        self.blocks_across, self.blocks_down = -(-(-(-self.width * h // across)) // 8), -(-(-(-self.height * v // down)) // 8)
        raw = np.frombuffer(data, np.uint8, offset=at)
        ff = np.flatnonzero(raw[:-1] == 255)
        after = raw[ff + 1]
        stop = ff[(after != 0) & ((after & 0xF8) != 0xD0) & (after != 255)]
        if not len(stop):
            raise ValueError("the scan has no end")
        end = int(stop[0])
        self.end = at + end + 2
        ff, after = ff[ff < end], after[ff < end]
        marks = ff[after != 0]
        keep = np.ones(end, bool)
        keep[ff[after == 0] + 1] = False
        keep[marks] = keep[marks + 1] = False
        kept = np.concatenate([[0], np.cumsum(keep)])
        self.scan = raw[:end][keep]
        self.starts = np.concatenate([[0], kept[marks + 2]]) if len(marks) else np.zeros(1, np.int64)

    def lanes(self) -> np.ndarray:
        """Units of each interval."""
        total = self.mcus_across * self.mcus_down
        if not self.restart:
            return np.array([total])
        n = -(-total // self.restart)
        if n != len(self.starts):
            raise ValueError("restart markers are missing")
        return np.minimum(self.restart, total - self.restart * np.arange(n))


@lru_cache(64)
def _lookup(table: bytes, ac: bool) -> np.ndarray:
    """By the next 16 bits: for DC tables, difference << 8 | bits used (bits used 0: longer than 16
    together); for AC tables, run << 8 | bits used with the coefficient's own bits, run 64 at a block's
    end."""
    codes = canonical(list(table[:16]), list(table[16:]))
    out = np.full(1 << 16, -1, np.int64)
    ahead = np.arange(1 << 16)
    for symbol, (code, length) in codes.items():
        span = slice(code << 16 - length, code + 1 << 16 - length)
        if ac:
            run, size = symbol >> 4, symbol & 15
            out[span] = (64 if symbol == 0 else run + 1) << 8 | length + size
        else:
            free = 16 - length - symbol
            if free >= 0:
                own = ahead[span] >> free & (1 << symbol) - 1
                value = np.where(own >> max(symbol - 1, 0) & 1, own, own - (1 << symbol) + 1) if symbol else own * 0
                out[span] = (value << 8) | length + symbol
            else:
                out[span] = (symbol << 16 | length) << 8  # bits used 0: read on
    return out


def _luminance(coding: tuple, scan: np.ndarray, start: np.ndarray, units: np.ndarray) -> np.ndarray:
    """DC values of the first component, lanes x units x its blocks in a unit."""
    padded = np.concatenate([scan, np.full(8, 255, np.uint8)])
    window = np.zeros(len(scan) + 4, np.uint32)
    for k in range(4):
        window |= padded[k : k + len(window)].astype(np.uint32) << np.uint32(24 - 8 * k)
    position, most = start.astype(np.int64) * 8, len(window) - 1
    tables = [(_lookup(dc, False), _lookup(ac, True)) for _, _, dc, ac in coding]
    blocks = [h * v for h, v, _, _ in coding]
    out = np.zeros((int(units.max()), blocks[0], len(start)), np.int16)
    order = np.argsort(-units, kind="stable")  # lanes that end first stand last
    position, ahead = position[order], np.searchsorted(-units[order], -np.arange(int(units.max())), side="left")
    before = np.zeros((len(coding), len(start)), np.int64)

    def peek(p):
        return window[np.minimum(p >> 3, most)] >> (16 - (p & 7)).astype(np.uint32) & np.uint32(0xFFFF)

    for unit in range(len(out)):
        n = int(ahead[unit])  # lanes with more than `unit` units
        p = position[:n]
        for c, (dc, ac) in enumerate(tables):
            for block in range(blocks[c]):
                got = dc[peek(p)]
                if got.min() < 0 and (got == -1).any():
                    raise ValueError("a code that the table lacks")
                used = got & 255
                value = got >> 8
                if not used.all():
                    for i in np.flatnonzero(used == 0):
                        size, length = value[i] >> 16, value[i] & 0xFFFF
                        at = int(p[i]) + int(length)
                        own = (int(peek(np.array([at]))[0]) << 16 | int(peek(np.array([at + 16]))[0])) >> 32 - size
                        value[i] = own if own >> size - 1 & 1 else own - (1 << int(size)) + 1
                        used[i] = length + size
                p += used
                before[c, :n] += value
                if c == 0:
                    out[unit, block, :n] = before[0, :n]
                got = ac[peek(p)]
                if (got < 0).any():
                    raise ValueError("a code that the table lacks")
                p += got & 255
                k = 1 + (got >> 8)
                while True:
                    going = np.flatnonzero(k < 64)
                    if not len(going):
                        break
                    got = ac[peek(p[going])]
                    if (got < 0).any():
                        raise ValueError("a code that the table lacks")
                    p[going] += got & 255
                    k[going] += got >> 8
    if (position >> 3 > len(scan)).any():
        raise ValueError("the scan is cut short")
    result = np.empty((len(start), *out.shape[:2]), np.int16)
    result[order] = out.transpose(2, 0, 1)
    return result


#: Bytes of scans that are decoded together.
TOGETHER = 4 << 20


def thumbnails(files: list[bytes]) -> list[list[tuple[int, int, np.ndarray, bool]]]:
    """For each value, of the files in a row in it: width, height, luminance thumbnail (blocks down x across, uint8) and
    whether its samples are places of bytes. Values of any length are decoded some images at a time."""
    out: list[list] = [[] for _ in files]
    images, owner, held = [], [], 0

    def flush():
        for i, image, thumb in zip(owner, images, _thumbnails(images), strict=True):
            out[i].append((image.width, image.height, thumb, image.ranked))

    for i, data in enumerate(files):
        at = 0
        while at < len(data):
            images.append(Image(data, at))
            owner.append(i)
            at = images[-1].end
            held += len(images[-1].scan)
            if held > TOGETHER:
                flush()
                images, owner, held = [], [], 0
    flush()
    return out


def _thumbnails(images: list[Image]) -> list[np.ndarray]:
    alike = defaultdict(list)
    for j, image in enumerate(images):
        alike[image.coding].append(j)
    found: list = [None] * len(images)
    for coding, members in alike.items():
        scans = [images[j].scan for j in members]
        base = np.cumsum([0, *map(len, scans)])
        units = [images[j].lanes() for j in members]
        start = np.concatenate([images[j].starts + b for j, b in zip(members, base, strict=False)])
        dc = _luminance(coding, np.concatenate(scans), start, np.concatenate(units))
        lane = 0
        h, v = coding[0][:2]
        for j, u in zip(members, units, strict=True):
            image = images[j]
            mine = dc[lane : lane + len(u)]
            lane += len(u)
            flat = mine.reshape(-1, h * v)[: int(u.sum())] if len(u) == 1 or (u == mine.shape[1]).all() else np.concatenate([m[:n] for m, n in zip(mine, u, strict=True)])
            grid = flat.reshape(image.mcus_down, image.mcus_across, v, h).transpose(0, 2, 1, 3).reshape(image.mcus_down * v, image.mcus_across * h)
            level = grid[: image.blocks_down, : image.blocks_across].astype(np.int64) * image.quant[image.components[0][3]]
            found[j] = np.clip((level + 4 >> 3) + 128, 0, 255).astype(np.uint8)
    return found


def average_hash(thumb: np.ndarray) -> str:
    """64 bits as hex: which cells of an 8 x 8 grid are above the mean of the cells. A thumbnail smaller
    than the grid repeats its rows or columns."""
    cells = thumb.astype(np.float64)
    for axis in (0, 1):
        n = cells.shape[axis]
        low = np.arange(8) * n // 8
        high = np.maximum(low + 1, np.arange(1, 9) * n // 8)
        sums = np.concatenate([np.zeros_like(cells.take([0], axis)), np.cumsum(cells, axis)], axis)
        shape = [-1 if a == axis else 1 for a in (0, 1)]
        cells = (sums.take(high, axis) - sums.take(low, axis)) / (high - low).reshape(shape)
    return np.packbits(cells > cells.mean()).tobytes().hex()


def to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media: each text's UTF-8 bytes, blanks appended to a positive multiple of 192, as the
    samples of a baseline JPEG (of several in a row beyond 8191 x 192 bytes). Null counts as empty."""
    id_field = T.StructField(id_col, df.schema[id_col].dataType)

    def encode(batches):
        for whole in batches:
            for batch in text_slices(whole, "text", 1 << 20):
                texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
                rows = [max(1, -(-len(t) // ROW)) for t in texts]
                samples = byte_places()[0][np.frombuffer(b"".join(t.ljust(n * ROW) for t, n in zip(texts, rows, strict=True)), np.uint8)].reshape(-1, ROW)
                if len(rows) == 1:  # a long text: image by image
                    media = [b"".join(encode_rows(part, np.array([len(part)]))[0] for part in (samples[a : a + MOST_ROWS] for a in range(0, rows[0], MOST_ROWS)))]
                else:
                    parts = [[min(MOST_ROWS, n - a) for a in range(0, n, MOST_ROWS)] for n in rows]
                    files = iter(encode_rows(samples, np.array([p for held in parts for p in held])))
                    media = [b"".join(next(files) for _ in held) for held in parts]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], [id_col, "n_bytes", "media"])

    schema = T.StructType([id_field, T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(encode, schema)


def media_features(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per media value: payload_bytes, payload_sha256, tail_crc32 of the samples read back, media_bytes,
    media_sha256, and feature: width x height, thumbnail size and hash of each image. A null value is
    refused; a file that is not baseline JPEG fails the job."""
    fields = [T.StructField(c, df.schema[c].dataType) for c in (id_col, *keep)]
    new = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]

    def read(batches):
        for whole in batches:
            sized = whole.rename_columns([*whole.schema.names[:-1], "media"])
            for batch in text_slices(sized, "media", 1 << 20):
                files = batch.column("media").to_pylist()
                if None in files:
                    raise ValueError("a media value is null")
                rows = []
                for data, images in zip(files, thumbnails(files), strict=True):
                    payload = b"".join((byte_places()[1][t] if ranked else t).tobytes() for _, _, t, ranked in images)
                    feature = ";".join(f"{w}x{h}:{t.shape[1]}x{t.shape[0]}:{average_hash(t)}" for w, h, t, _ in images)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature))
                columns = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(fields))), *(pa.array(c, pa.string() if isinstance(t, T.StringType) else pa.int64()) for c, (_, t) in zip(columns, new, strict=True))], [*(f.name for f in fields), *(n for n, _ in new)])

    return df.select(id_col, *keep, media_col).mapInArrow(read, T.StructType([*fields, *(T.StructField(n, t) for n, t in new)]))


def payload_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store the texts as a table of media in the shared folder and read the features back from the stored bytes. Equal
    texts give equal values; repeated rows repeated ones; an empty table an empty one; other columns are ignored."""
    return media_features(materialize(to_media(df, id_col, text_col), "media"), id_col, "media", ("n_bytes",))
