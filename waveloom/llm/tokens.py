"""Batch encoding with the tokenizers library: each distinct word of a batch is encoded once.

Both vocabularies cut a text into pretokens before any merge, and a cut always falls before the last
blank of a run that a word follows. So a text may be split at single blanks, and the ids of its words
put in a row are the ids of the text. Texts with other blanks in these places are encoded whole, and so are texts
that hold the string of a special token: the library finds those before it cuts.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from waveloom.llm.common import kept_in_process


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Empty, or a blank of any kind (control separators too) at either end.
BLANK_EDGE = r"^$|^[\s\pZ\x0b\x1c-\x1f\x85]|[\s\pZ\x0b\x1c-\x1f\x85]$"


#: Words of these letters only are one pretoken, and lower case is told letter by letter.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


class WordMerges:
    """Ids of many words at once by the vocabulary's merges. A word is its bytes; the pair of the best rank is
    merged until none is left, in all words of a call together, one pair a word and round."""

    LEVELS = (20, 15, 12, 12)

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        # bytes are named by printable characters, others by those from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        name = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.inner = np.array([vocab[name[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[name[b] + self.end] for b in range(256)], np.int32)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        a, b = (np.array([vocab[m[k]] for m in merges], np.uint64) for k in (0, 1))
        self.made = np.array([*(vocab[x + y] for x, y in merges), 0], np.int32)
        self.none = len(merges)
        # tables of merge numbers by a hash of the pair; pairs whose slot is taken go to the next table
        self.tables, keys, left = [], a << np.uint64(32) | b, np.arange(len(merges))
        self.keys = np.concatenate([keys, np.full(1, 1 << 63, np.uint64)])
        for bits in self.LEVELS:
            slots, first = np.unique(self._slot(keys[left], bits), return_index=True)
            table = np.full(1 << bits, self.none, np.int32)
            table[slots] = left[first]
            self.tables.append(table)
            left = np.delete(left, first)
        if len(left):
            raise ValueError("the merges do not fit the tables")

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15 + 2 * bits) >> np.uint64(64 - bits)).astype(np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers of the merges of pairs; ``none`` where there is none."""
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        out = np.full(len(keys), self.none, np.int32)
        for bits, table in zip(self.LEVELS, self.tables, strict=True):
            found = table[self._slot(keys, bits)]
            np.copyto(out, found, where=self.keys[found] == keys)
        return out

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids) of words without line ends, none of them empty."""
        data = np.frombuffer(("\n".join(words) + "\n").encode(), np.uint8)
        ends = np.flatnonzero(data == 10)
        keep = data != 10
        ids = self.inner[data]
        ids[ends - 1] = self.last[data[ends - 1]]
        word = np.repeat(np.arange(len(words)), np.diff(ends, prepend=-1))[keep]
        ids = ids[keep]
        rank = np.full(len(ids), self.none, np.int32)
        same = np.flatnonzero(word[1:] == word[:-1])
        rank[same] = self._ranks(ids[same], ids[same + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            new = np.concatenate([[True], word[1:] != word[:-1]])
            first = np.flatnonzero(new)
            best = np.minimum.reduceat(rank, first)
            of = np.cumsum(new) - 1
            over = (best == self.none)[of]
            done.append((word[over], ids[over]))
            at = np.flatnonzero((rank == best[of]) & ~over)
            at = at[np.concatenate([[True], of[at[1:]] != of[at[:-1]]])] if len(at) else at
            ids[at] = self.made[rank[at]]
            keep = ~over
            keep[at + 1] = False
            # ranks of the pairs that the new token stands in
            behind = at + 2
            right = behind < len(ids)
            right[right] = word[behind[right]] == word[at[right]]
            rank[at] = self.none
            rank[at[right]] = self._ranks(ids[at[right]], ids[behind[right]])
            before = at[(at > 0) & ~new[at]]
            rank[before - 1] = self._ranks(ids[before - 1], ids[before])
            ids, word, rank = ids[keep], word[keep], rank[keep]
        word, ids = (np.concatenate([x[k] for x in done]) if done else np.zeros(0, np.int64) for k in (0, 1))
        return np.bincount(word, minlength=len(words)), ids[np.argsort(word, kind="stable")]


class BatchEncoder:
    """Ids of many texts at once.

    blanks_dropped: the vocabulary drops blanks (words with ends); else a word takes the blank before it.
    cache_words: words kept from batch to batch; beyond it the store starts anew, so memory is bounded.
    """

    def __init__(self, path: str, blanks_dropped: bool, cache_words: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = "|".join(special)
        self.blanks_dropped, self.cache_words, self.merges = blanks_dropped, cache_words, WordMerges(path)
        #: Between words encoded together: a control character, or a line end where a word takes its blank.
        self.mark = "\x01" if blanks_dropped else "\n"
        (self.mark_id,) = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self._reset()

    def _reset(self) -> None:
        self.spaced: dict[str, int] = {}
        self.bare: dict[str, int] = {}
        self.stored = 0
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _append(self, words: list[str], lengths: np.ndarray, ids: np.ndarray, index: dict[str, int]) -> None:
        n, total = self.stored, len(ids)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(words) > len(self.start):
            self.start, self.length = (np.concatenate([a, np.zeros_like(a)]) for a in (self.start, self.length))
        self.flat[self.used : self.used + total] = ids
        self.start[n : n + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.length[n : n + len(words)] = lengths
        self.used += total
        self.stored += len(words)
        index.update(zip(words, range(n, n + len(words)), strict=True))

    def _gather(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids) of stored words put in a row."""
        lengths = self.length[place]
        ends = np.cumsum(lengths)
        return lengths, self.flat[np.repeat(self.start[place] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]

    def _learn(self, words: list[str], lead: str, index: dict[str, int]) -> None:
        """Encode words that are not stored. Many are put in one text with a mark between them that is a
        pretoken of its own; the ids between marks are the words'. A letter before a last comma or stop
        is a cut between pretokens, so such a word is its stem and that sign. Words of letters only are merged here."""
        letters, others = [], []
        for w in words:
            (letters if w.isalpha() and (w.isascii() or LETTERS.fullmatch(w)) else others).append(w)
        if letters:
            self._append(letters, *self.merges.encode([w.lower() for w in letters] if self.blanks_dropped else [lead + w for w in letters]), index)
        signed = [w for w in others if len(w) > 1 and w[-1] in ".," and w[-2].lower().isalpha()]
        if signed:
            place = np.empty(2 * len(signed), np.int64)
            place[::2] = self._places([w[:-1] for w in signed], lead)
            place[1::2] = self._places([".", ","])[np.fromiter((w[-1] == "," for w in signed), np.int64, len(signed))]
            lengths, ids = self._gather(place)
            self._append(signed, lengths[::2] + lengths[1::2], ids, index)
        words = [w for w in others if w not in index]
        tidy = [w for w in words if w and not (w[0].isspace() or w[-1].isspace() or self.mark in w)]
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        between = f" {self.mark} " if self.blanks_dropped else self.mark
        joined = ["".join(lead + w + between for w in tidy[i : i + 500]) for i in range(0, len(tidy), 500)]
        ids = np.fromiter(chain.from_iterable(x.ids for x in encode(joined, add_special_tokens=False)), np.int32)
        marks = np.flatnonzero(ids == self.mark_id)
        if len(marks) == len(tidy):
            lengths = np.diff(marks, prepend=-1) - 1
            self._append(tidy, lengths, np.delete(ids, marks), index)
        else:
            tidy = []
        told = set(tidy)
        rest = [w for w in words if w not in told]
        ids = [x.ids for x in encode([lead + w for w in rest], add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self._append(rest, lengths, np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum())), index)

    def _places(self, words: list[str], lead: str = "") -> np.ndarray:
        index = self.spaced if lead else self.bare
        place = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new = [words[i] for i in missing]
            self._learn(list(dict.fromkeys(new)), lead, index)
            place[missing] = np.fromiter(map(index.__getitem__, new), np.int64, len(new))
        return place

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the ids of text i are ids[offsets[i]:offsets[i + 1]]; null counts as empty."""
        texts = pc.fill_null(texts, "")
        if not self.special or not (marked := pc.match_substring_regex(texts, self.special)).true_count:
            return self._encode(texts)
        offsets, ids = self._encode(texts.filter(pc.invert(marked)))
        plain = iter(np.split(ids, offsets[1:-1]))
        parts = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.int32) if m else next(plain) for t, m in zip(texts.to_pylist(), marked.to_pylist(), strict=True)]
        return np.cumsum([0, *map(len, parts)]), np.concatenate(parts)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.stored > self.cache_words:
            self._reset()
        # a line end between two words is a pretoken of its own, and the word after it has no blank
        cut = pc.replace_substring(texts, "\n", " " if self.blanks_dropped else " \n ")
        lists = pc.split_pattern(cut, " ")
        bounds = np.asarray(lists.offsets, np.int64)
        first, last = bounds[:-1], bounds[1:]
        coded = lists.values.dictionary_encode()
        codes, words = np.asarray(coded.indices, np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.blanks_dropped:
            place = self._places(words)[codes]
        else:
            line_end = pc.equal(coded.dictionary, "\n").to_numpy(zero_copy_only=False)
            place = self._places(words, " ")[codes]
            ends = line_end[codes]
            if ends.any():
                place[ends] = self._places(["\n"])[0]
            bare = np.zeros(len(codes), bool)
            bare[1:] = line_end[codes[:-1]]
            bare[first] = True
            at = np.flatnonzero(bare)
            lead, back = np.unique(codes[at], return_inverse=True)
            place[at] = self._places([words[i] for i in lead])[back]
            blank = pc.match_substring_regex(coded.dictionary, BLANK_EDGE).to_numpy(zero_copy_only=False)
            odd = (blank & ~line_end)[codes]
            odd |= line_end[codes] & bare  # a line end at a text's start or after another
            odd[last[line_end[codes[last - 1]]] - 1] = True  # or at its end
            odd[first[(last - first == 1)]] = False
            whole = np.flatnonzero(np.add.reduceat(odd, first) > 0)
            if len(whole):  # other runs of blanks: such texts are one word each
                strings = [texts[int(i)].as_py() for i in whole]
                keep = np.ones(len(codes), bool)
                for i, at in zip(whole, self._places(strings), strict=True):
                    keep[first[i] + 1 : last[i]] = False
                    place[first[i]] = at
                place = place[keep]
                sizes = last - first
                sizes[whole] = 1
                last = np.cumsum(sizes)
        lengths, ids = self._gather(place)
        ends = np.cumsum(lengths)
        return np.concatenate([[0], ends[last - 1]]) if len(last) else np.zeros(1, np.int64), ids


@lru_cache(1)
def shared_encoder(path: str, blanks_dropped: bool) -> BatchEncoder:
    """One encoder per worker process: the words that a task has met serve the next task of its kind."""
    return BatchEncoder(path, blanks_dropped)


kept_in_process.append(shared_encoder.cache_clear)


def with_end(offsets: np.ndarray, ids: np.ndarray, end: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The same with the id ``end`` after each text."""
    n = len(offsets) - 1
    return offsets + np.arange(n + 1), np.insert(ids, offsets[1:], end) if n else ids


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
