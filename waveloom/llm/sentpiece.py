"""SentencePiece encoding that keeps the byte span of every piece.

Normalisation walks the model's compiled character map: a double-array trie whose entries are replaced
longest first. Each normalised byte remembers the byte of the text it came from, and pieces, laid end to
end over the normalised bytes, are projected through that alignment to spans of the text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waveloom.llm.common import spread, worker
from waveloom.llm.packing import text_slices
from waveloom.llm.tokens import vocabulary

MARK = "▁".encode()


class CharacterMap:
    """Longest-prefix lookups in a compiled character map: u32 size of the trie, its units, and the
    replacements as zero-ended strings. Unit bits: 0-7 label, 8 has a value, 9 offset scale, 10-30 offset,
    31 this unit is a value."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack(f"<{size // 4}I", blob[4 : 4 + size])
        self.strings = blob[4 + size :]
        self.single: dict[bytes, bytes] = {}

    def first_bytes(self) -> np.ndarray:
        """Which bytes an entry begins with."""
        out = np.zeros(256, bool)
        if self.units:
            root = (self.units[0] >> 10) << ((self.units[0] & 512) >> 6)
            for b in range(1, 256):
                out[b] = (root ^ b) < len(self.units) and self.units[root ^ b] & 0x800000FF == b
        return out

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) of the longest entry that starts at ``at``."""
        units = self.units
        if not units:
            return None
        node, found = 0, None
        unit = units[0]
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if not found:
            return None
        begin = found[1]
        return found[0], self.strings[begin : self.strings.index(b"\0", begin)]


class Normaliser:
    """Normalised bytes and, for each and for their end, the byte of the text they start from."""

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        #: Bytes at which the walk stops: those with which an entry begins, and blanks if runs of them shrink.
        self.stops = self.map.first_bytes()
        self.stops[32] |= self.squeeze

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The walk: at each byte with which an entry may begin the longest one is looked up; what lies between such
        bytes is itself, a stretch at a time. An empty map has no such byte."""
        if not data:
            return b"", np.zeros(1, np.int64)
        space = MARK if self.escape else b" "
        raw = np.frombuffer(data, np.uint8)
        out, align = bytearray(), []
        blank = self.squeeze  # whether the last thing written counts as a blank
        at, first = 0, True

        def stretch(begin: int, stop: int) -> None:
            nonlocal blank, first
            if begin < stop:
                if first and self.prefix:
                    out.extend(space)
                    align.append(np.full(len(space), begin))
                first = blank = False
                out.extend(data[begin:stop].replace(b" ", space))
                width = np.where(raw[begin:stop] == 32, len(space), 1)
                align.append(np.repeat(np.arange(begin, stop), width))

        for stop in np.flatnonzero(self.stops[raw]).tolist():
            if stop < at:  # within the entry before
                continue
            stretch(at, stop)
            hit = self.map.longest(data, stop)
            b = data[stop]
            size, piece = hit or (n := 1 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4, data[stop : stop + n])
            at = stop + size
            while blank and piece[:1] == b" ":
                piece = piece[1:]
            if not piece:
                continue
            new = (space if first and self.prefix else b"") + piece.replace(b" ", space)
            first = False
            out.extend(new)
            align.append(np.full(len(new), stop))
            blank = self.squeeze and piece[-1:] == b" "
        stretch(at, len(data))
        places = np.concatenate(align) if align else np.zeros(0, np.int64)
        end = len(data)
        if self.squeeze:
            while out.endswith(space):
                end = int(places[len(out) - len(space)])
                del out[-len(space) :]
        return bytes(out), np.append(places[: len(out)], end)


class SpanEncoder:
    """Ids and byte spans of texts. Pieces of one byte each (for characters without a piece) and every
    other piece take their own bytes of the normalised text, so spans need no search."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.normalise = Normaliser(model.normalizer_spec)
        piece = model.SentencePiece
        self.own = [bytes((int(p.piece[1:-1], 16),)) if p.type == piece.BYTE else p.piece.encode() for p in model.pieces]
        self.width = np.array([len(x) for x in self.own], np.int64)
        self.unknown = np.array([p.type == piece.UNKNOWN for p in model.pieces])
        self.decimal = [str(i) for i in range(len(model.pieces))]

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.processor.encode(texts, num_threads=1, add_bos=False, add_eos=False, enable_sampling=False) if texts else []

    def spans(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) bytes in the text of every id. Bytes of one character share its span's start. The pieces' own
        bytes, put in a row, must be the normalised text, so each span is that of its piece."""
        normal, align = self.normalise(text.encode())
        ids = np.asarray(ids, np.int64)
        width = self.width[ids]
        if (odd := self.unknown[ids]).any():
            width = self._fit_unknown(normal, ids, width, odd)
        elif b"".join(map(self.own.__getitem__, ids.tolist())) != normal:
            raise ValueError("pieces are not the normalised text")
        ends = np.cumsum(width)
        if len(ends) and ends[-1] != len(normal):
            raise ValueError("pieces do not cover the normalised text")
        return align[ends - width], align[ends]

    def _fit_unknown(self, normal, ids, width, odd):
        """A run of characters without a piece reaches to where the next piece stands."""
        at, width = 0, width.copy()
        for i in range(len(ids)):
            if odd[i]:
                after = i + 1
                if after < len(ids):
                    piece = self.processor.id_to_piece(int(ids[after])).encode()
                    width[i] = normal.index(piece, at + 1) - at
                else:
                    width[i] = len(normal) - at
            at += width[i]
        return width


def encode_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, digests: bool = False) -> DataFrame:
    """id, ids, starts, ends: the ids of every whole text without begin or end ids, and the byte span of
    each. With ``digests``: id, n_tokens, ids_sha256, decoded_sha256, spans_crc32 in their place (decoded:
    of decode(ids); spans: of all starts, then all ends, as little-endian 32-bit integers), so that long
    lists need not leave the task.

    Null counts as empty; an empty text has no ids. Rows are taken one by one: repeated rows give repeated
    results, an empty table an empty one, other columns are ignored.
    """
    model = model or vocabulary("piece_bpe_32k.model")
    id_field = T.StructField(id_col, df.schema[id_col].dataType)
    ints = T.ArrayType(T.IntegerType())
    more = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()), ("spans_crc32", T.LongType())] if digests else [("ids", ints), ("starts", ints), ("ends", ints)]

    @worker
    def encode(batches):
        encoder = SpanEncoder(model)
        for whole in batches:
            for batch in text_slices(whole, "text", 2 << 20):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                ids = encoder.ids(texts)
                spans = [encoder.spans(t, i) for t, i in zip(texts, ids, strict=True)]
                if digests:
                    decoded = encoder.processor.decode(ids, num_threads=1)
                    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
                    arrays = [
                        pa.array(map(len, ids), pa.int64()),
                        pa.array([sha(",".join(map(encoder.decimal.__getitem__, i))) for i in ids], pa.string()),
                        pa.array(map(sha, decoded), pa.string()),
                        pa.array([zlib.crc32(e.astype("<i4").tobytes(), zlib.crc32(s.astype("<i4").tobytes())) for s, e in spans], pa.int64()),
                    ]
                else:
                    arrays = [pa.array(ids, pa.list_(pa.int32())), *(pa.array([s[k].astype(np.int32) for s in spans], pa.list_(pa.int32())) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], [id_col, *(n for n, _ in more)])

    schema = T.StructType([id_field, *(T.StructField(n, t) for n, t in more)])
    return spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(encode, schema)


def decode_ids(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """id, text: the library's decoding of lists of ids. A null list decodes to an empty text."""
    model = model or vocabulary("piece_bpe_32k.model")

    def decode(batches):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=model)
        for batch in batches:
            ids = [i or [] for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(processor.decode(ids, num_threads=1) if ids else [], pa.string())], [id_col, "text"])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("text", T.StringType())])
    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(decode, schema)
