"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

A token's probability is that of its class, given what stands before it, times its own within the class. Classes are
the most frequent words, each alone, and a fixed number of classes by the last two bytes of a word. The class is
predicted by maximum entropy over hashed features: the word before, the two words before, and the second last word
alone. Weights begin at damped log ratios of counts and are moved by gradient updates, each summed over a third of the
training documents by all tasks. Within a class a word has its share of the class's tokens, less a discount that is left
to words that were never seen.

Counts are kept for every word of the training documents, as a table of word hashes that grows with the corpus and
never leaves the executors. Words that are a 2^17th of all tokens or more, so at most 2^17, are broadcast to the scan,
as is the table of weights, whose size is bounded. All other words of a document go through one join with the counts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waveloom.llm.common import byte_slices, materialize, spread, worker
from waveloom.llm.shingles import _byte_table, _powers, mix

#: Documents whose crc32 modulo FOLDS is 0 are held out; the others are dealt to UPDATES gradient updates.
FOLDS, UPDATES = 10, 3
#: A word with this share of the training tokens is a class of its own, and classes of all other words.
HEAD_SHARE, TAILS = 256, 32
#: Words that this share of the tokens are, are broadcast with their counts.
FREQUENT_SHARE = 1 << 17
#: Rows of the weight table: twice the root of the training tokens or more, within these bounds. The table has at most
#: HEAD_SHARE + TAILS columns, so 150 MB of it are broadcast at the very most, and a sixth of that on natural text.
LEAST_BUCKETS, MOST_BUCKETS = 1 << 8, 1 << 17
#: Smoothing of the base score, discount within a class, weight of the prior in log ratios, their damping, step size.
BASE, DISCOUNT, PRIOR, DAMPING, RATE = 0.1, 0.5, 2.0, 0.5, 0.5
#: Bytes of text that are taken together, and tokens whose classes are predicted together.
SLICE, TOKENS = 1 << 16, 4096
#: Words of a task that are summed before they are handed on.
HELD = 1 << 20
BEGIN, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
BLANK = re.compile(rb"[\x20\x09-\x0D]")


@dataclass
class Tokens:
    """Tokens of some texts in order: the row of each, its hash, the class of its last bytes, and the two before it."""

    row: np.ndarray
    word: np.ndarray
    tail: np.ndarray
    before: np.ndarray
    second: np.ndarray


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each word, hash, tail class). A-Z count as a-z."""
    sizes = np.array([len(t) + 1 for t in texts])
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    table, blanks = _byte_table()
    power, inverse = _powers(max(SLICE * 2, 1 << int(len(data)).bit_length()))
    inside = ~blanks[data]
    change = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = change[::2], change[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[data] * power[: len(data)])])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    last = table[data[ends - 1]]
    last = last + np.where(ends - starts > 1, table[data[np.maximum(ends - 2, 0)]], np.uint64(0)) * BEGIN
    of = np.searchsorted(np.cumsum(sizes), starts, side="right")
    return of, hashes, (mix(last) % np.uint64(TAILS)).astype(np.uint8)


def _sequence(texts: list[bytes], rows: np.ndarray, before, second, final: bool) -> Tokens:
    """Tokens of texts that follow (second, before), each with an end if final."""
    of, hashes, tails = _words(texts)
    counts = np.bincount(of, minlength=len(texts))
    lengths = counts + 2 + final
    begin = np.cumsum(lengths) - lengths
    n = int(lengths.sum())
    word, tail, target = np.empty(n, np.uint64), np.zeros(n, np.uint8), np.ones(n, bool)
    at = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts) + begin[of] + 2
    word[at], tail[at] = hashes, tails
    word[begin], word[begin + 1] = second, before
    target[begin] = target[begin + 1] = False
    if final:
        word[begin + lengths - 1] = END
    places = np.flatnonzero(target)
    return Tokens(np.repeat(rows, counts + final), word[places], tail[places], word[places - 1], word[places - 2])


def token_slices(texts: list[bytes]) -> Iterator[Tokens]:
    """Tokens of all texts, a slice of them at a time. A text longer than a slice comes in parts, cut at blanks."""
    for a, b in byte_slices([len(t) for t in texts], SLICE):
        if b - a > 1 or len(texts[a]) <= SLICE:
            yield _sequence(texts[a:b], np.arange(a, b), BEGIN, BEGIN, True)
            continue
        text, at, before, second = texts[a], 0, BEGIN, BEGIN
        while at < len(text):
            found = BLANK.search(text, at + SLICE)
            stop = found.end() if found else len(text)
            part = _sequence([text[at:stop]], np.array([a]), before, second, stop == len(text))
            for word in part.word[-2:]:
                before, second = word, before
            yield part
            at = stop


def keep_freed_memory() -> None:
    """Let this process reuse the memory of one slice's arrays for the next's: fresh pages cost more than what is
    computed on them. The end of the task gives it back."""
    import ctypes

    with suppress(AttributeError, OSError):  # another C library
        libc = ctypes.CDLL(None)
        libc.mallopt(-1, 128 << 20)  # free memory at the end of the heap that is kept
        libc.mallopt(-3, 32 << 20)  # smaller arrays come from the heap


def _bytes(column: pa.Array) -> list[bytes]:
    return pc.fill_null(column, "").cast(pa.binary()).to_pylist()


def _training_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, fold) with fold 0 for rows that are held out; rows without an id are not."""
    fold = F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS, F.lit(1)).cast("int")
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), fold.alias("fold"))


def count_words(texts: DataFrame) -> DataFrame:
    """(word, tail, n) of every token of ``texts`` (text): summed in each task, then by word."""

    @worker
    def run(batches):
        keep_freed_memory()
        held, n = [], 0

        def merged():
            word, tail, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            word, first, place = np.unique(word, return_index=True, return_inverse=True)
            return word, tail[first], np.bincount(place, counts, len(word)).astype(np.int64)

        def out(word, tail, counts):
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(tail.astype(np.int32)), pa.array(counts)], ["word", "tail", "n"])

        for batch in batches:
            for tokens in token_slices(_bytes(batch.column("text"))):
                word, first, counts = np.unique(tokens.word, return_index=True, return_counts=True)
                held.append((word, tokens.tail[first], counts))
                n += len(word)
                if n >= HELD:
                    held = [merged()]
                    n = len(held[0][0])
                    if 2 * n >= HELD:
                        yield out(*held[0])
                        held, n = [], 0
        if held:
            yield out(*merged())

    partial = texts.mapInArrow(run, "word long, tail int, n long")
    return partial.groupBy("word").agg(F.max("tail").alias("tail"), F.sum("n").alias("n"))


@dataclass(frozen=True)
class ClassModel:
    """Classes of words and the weights that predict them: a row per bucket, the last one the bias, a column per class."""

    heads: np.ndarray
    weights: np.ndarray

    @property
    def buckets(self) -> int:
        return len(self.weights) - 1

    def classes(self, word: np.ndarray, tail: np.ndarray) -> np.ndarray:
        if not len(self.heads):
            return tail.astype(np.int64)
        at = np.minimum(np.searchsorted(self.heads, word), len(self.heads) - 1)
        return np.where(self.heads[at] == word, at, len(self.heads) + tail)

    def features(self, tokens: Tokens) -> list[np.ndarray]:
        """Buckets of the word before, of the two before, and of the second last alone."""
        one, two = tokens.before * BEGIN, tokens.second * END
        return [(mix(h + np.uint64(k)) & np.uint64(self.buckets - 1)).astype(np.int64) for k, h in enumerate((one, one + two, two), 1)]

    @cached_property
    def tops(self) -> np.ndarray:
        """Largest weight of every bucket: their sum bounds the logits, so powers of differences to it never overflow."""
        return self.weights.max(1)

    def powers(self, features: list[np.ndarray], held: np.ndarray, more: np.ndarray) -> np.ndarray:
        """Logits less their bound, in the first rows of ``held``."""
        n = len(features[0])
        out, next_ = held[:n], more[:n]
        np.take(self.weights, features[0], axis=0, out=out, mode="clip")
        for f in features[1:]:
            np.take(self.weights, f, axis=0, out=next_, mode="clip")
            out += next_
        out += self.weights[self.buckets]
        out -= (self.tops[self.buckets] + sum(self.tops[f] for f in features))[:, None]
        return out

    def _space(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # by the type, not the dtype: that of unpickled weights is another object, for which numpy has no fast sums
        k, kind = self.weights.shape[1], self.weights.dtype.type
        return np.empty((TOKENS, k), kind), np.empty((TOKENS, k), kind), np.ones(k, kind)

    def log_probability(self, tokens: Tokens) -> np.ndarray:
        """Natural logarithm of the probability of every token's class."""
        features, classes, out = self.features(tokens), self.classes(tokens.word, tokens.tail), np.empty(len(tokens.word))
        held, more, ones = self._space()
        for a in range(0, len(out), TOKENS):
            part = slice(a, a + TOKENS)
            x = self.powers([f[part] for f in features], held, more)
            own = x[np.arange(len(x)), classes[part]].astype(np.float64)
            np.exp(x, out=x)
            out[part] = own - np.log((x @ ones).astype(np.float64))
        return out

    def add_gradient(self, tokens: Tokens, total: np.ndarray) -> None:
        """Add to ``total``, shaped as the weights, what tokens have of each class less what is expected."""
        features, classes = self.features(tokens), self.classes(tokens.word, tokens.tail)
        held, more, ones = self._space()
        flat, k = total.reshape(-1), total.shape[1]
        columns = np.arange(k)
        for a in range(0, len(tokens.word), TOKENS):
            now = [f[a : a + TOKENS] for f in features]
            x = self.powers(now, held, more)
            np.exp(x, out=x)
            x /= -(x @ ones)[:, None]
            x[np.arange(len(x)), classes[a : a + TOKENS]] += 1
            total[self.buckets] += x.sum(0)
            for f in now:
                np.add.at(flat, ((f * k)[:, None] + columns).ravel(), x.ravel())

    def add_counts(self, tokens: Tokens, total: np.ndarray) -> None:
        """Add to ``total`` how often each class stands with each bucket."""
        classes, flat, k = self.classes(tokens.word, tokens.tail), total.reshape(-1), total.shape[1]
        ones = np.ones(len(classes), total.dtype)
        for f in self.features(tokens):
            np.add.at(flat, f * k + classes, ones)
        total[self.buckets] += np.bincount(classes, minlength=k).astype(total.dtype)


def summed(texts: DataFrame, model: ClassModel, gradient: bool) -> np.ndarray:
    """Gradient, or counts, of all ``texts``: every task sums its own, and rows of buckets are summed over tasks. As many
    numbers as the weights come to the driver, whatever the corpus. A task's sum is of the size of the weights, so
    input splits are taken together, without a shuffle, to two tasks a core."""
    texts = texts.coalesce(2 * texts.sparkSession.sparkContext.defaultParallelism)
    shared = texts.sparkSession.sparkContext.broadcast(model)
    kind = np.float32

    @worker
    def run(batches):
        keep_freed_memory()
        own = shared.value
        total = np.zeros(own.weights.shape, kind)
        add = own.add_gradient if gradient else own.add_counts
        for batch in batches:
            for tokens in token_slices(_bytes(batch.column("text"))):
                if len(tokens.word):
                    add(tokens, total)
        touched = np.flatnonzero(total.any(1))
        if len(touched):
            yield pa.RecordBatch.from_arrays([pa.array(touched.astype(np.int32)), pa.array([total[i].tobytes() for i in touched], pa.binary())], ["bucket", "numbers"])

    @worker
    def add_up(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for bucket, numbers in zip(batch.column("bucket").to_pylist(), batch.column("numbers").to_pylist(), strict=True):
                row = np.frombuffer(numbers, kind).astype(np.float64)
                sums[bucket] = sums[bucket] + row if bucket in sums else row
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.astype(kind).tobytes() for x in sums.values()], pa.binary())], ["bucket", "numbers"])

    fields = "bucket int, numbers binary"
    rows = texts.mapInArrow(run, fields).repartition("bucket").mapInArrow(add_up, fields).toArrow()
    out = np.zeros(model.weights.shape)
    if rows.num_rows:
        out[rows.column("bucket").to_numpy()] = np.stack([np.frombuffer(x, kind) for x in rows.column("numbers").to_pylist()])
    shared.destroy()
    return out


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """Weights from counts: the bias has the classes' logarithms, a bucket its damped log ratios to them."""
    own = counts[-1] + 1
    share = own / own.sum()
    ratio = (counts + PRIOR * share) / (counts.sum(1, keepdims=True) + PRIOR) / share
    out = DAMPING * np.log(ratio)
    out[-1] = np.log(share)
    return out.astype(np.float32)


def updated(model: ClassModel, gradient: np.ndarray, counts: np.ndarray) -> ClassModel:
    """Weights after one step up the gradient, each scaled by the larger of what it has and what was expected."""
    scale = np.maximum(np.maximum(counts, counts - gradient), 0) + PRIOR
    return ClassModel(model.heads, (model.weights + RATE * gradient / scale).astype(np.float32))


@dataclass
class LanguageModel:
    """The class model; counts of all training words; of the classes by last bytes tokens and words; frequent words."""

    classes: ClassModel
    vocabulary: DataFrame
    tokens: int
    words: int
    tail_tokens: np.ndarray
    tail_words: np.ndarray
    frequent: tuple[np.ndarray, np.ndarray]

    def unknown(self) -> np.ndarray:
        """Of each class by last bytes log10 of the probability of an unseen word; of an empty class 0."""
        some = self.tail_tokens > 0
        return np.where(some, np.log10(np.maximum(DISCOUNT * self.tail_words, 1e-300) / np.maximum(self.tail_tokens, 1)), 0.0)


def bucket_count(tokens: int) -> int:
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (2 * math.isqrt(max(1, tokens))).bit_length()))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LanguageModel:
    """The model of all documents that are not held out."""
    rows = _training_rows(df, id_col, text_col).where("fold <> 0")
    texts = spread(rows.select("text"))
    vocabulary = materialize(count_words(texts), "lm-words")
    whole = vocabulary.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).first()
    tokens = whole.n or 0
    often = vocabulary.where(F.col("n") * FREQUENT_SHARE >= tokens).select("word", "n").toArrow()
    word, n = often.column("word").to_numpy().view(np.uint64), often.column("n").to_numpy()
    order = np.argsort(word)
    word, n = word[order], n[order]
    heads = word[n * HEAD_SHARE >= tokens]
    tails = np.zeros((2, TAILS))
    for r in vocabulary.where(F.col("n") * HEAD_SHARE < tokens).groupBy("tail").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect():  # TAILS rows
        tails[:, r.tail] = r.n, r.words
    model = ClassModel(heads, np.zeros((bucket_count(tokens) + 1, len(heads) + TAILS), np.float32))
    if tokens:
        counts = summed(texts, model, False)
        model = ClassModel(heads, log_ratios(counts))
        for turn in range(UPDATES):
            some = spread(rows.where(F.col("fold") % UPDATES == turn).select("text"))
            gradient = summed(some, model, True)
            model = updated(model, gradient, counts / UPDATES)
    return LanguageModel(model, vocabulary, tokens, whole.words, *tails, (word, n))


def scan_scores(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """A row per text: tokens, and of its frequent ones known tokens, log10 of counts for the base score, log10 of the
    probability within the class; of all the classes' probability; and its other words, with their number and class in one."""
    own = (model.classes, *model.frequent, model.tail_tokens)
    shared = rows.sparkSession.sparkContext.broadcast(own)

    @worker
    def run(batches):
        keep_freed_memory()
        classes, frequent, counts, tail_tokens = shared.value
        base_of = np.log10(counts + BASE)
        within_of = np.log10(counts - DISCOUNT)
        tail_log = np.log10(np.maximum(tail_tokens, 1))
        key = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = _bytes(batch.column("text"))
            n, sums = np.zeros((2, len(texts)), np.int64), np.zeros((2, len(texts)))
            base, within = sums
            predicted, rest = np.zeros(len(texts)), []
            for t in token_slices(texts):
                if not len(t.word):
                    continue
                n[0] += np.bincount(t.row, minlength=len(texts))
                predicted += np.bincount(t.row, classes.log_probability(t), len(texts))
                head = classes.classes(t.word, t.tail) < len(classes.heads)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, t.word), len(frequent) - 1)
                    found = frequent[at] == t.word
                    at, row = at[found], t.row[found]
                    n[1] += np.bincount(row, minlength=len(texts))
                    base += np.bincount(row, base_of[at], len(texts))
                    within += np.bincount(row, np.where(head[found], 0.0, within_of[at] - tail_log[t.tail[found]]), len(texts))
                    rest.append((t.row[~found], t.word[~found], t.tail[~found]))
                else:
                    rest.append((t.row, t.word, t.tail))
            row, word, tail = (np.concatenate(x) for x in zip(*rest, strict=True)) if rest else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint8))
            order = np.lexsort((word, row))
            row, word, tail = row[order], word[order], tail[order]
            first = np.flatnonzero(np.concatenate([np.ones(min(1, len(row)), bool), (row[1:] != row[:-1]) | (word[1:] != word[:-1])]))
            times = np.diff(np.append(first, len(row)))
            offsets = pa.array(np.searchsorted(row[first], np.arange(len(texts) + 1)).astype(np.int32))
            arrays = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (word[first].view(np.int64), times * TAILS + tail[first])]
            keys = key + np.arange(len(texts))
            key += len(texts)
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column("id"), batch.column("fold"), *map(pa.array, (n[0], n[1], base, within + predicted / math.log(10))), *arrays], ["row", "id", "fold", "n_tokens", "n_known", "base", "score", "words", "packed"])

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"row long, id {id_type}, fold int, n_tokens long, n_known long, base double, score double, words array<long>, packed array<long>")


def score(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Tokens are words of ``[^\\x20\\x09-\\x0D]+`` with A-Z as a-z, and one end. Words are told apart by 64-bit hashes. A
    null text is empty: one token, the end. Rows that repeat an id or a text are scored each; a row without an id
    trains. Without training documents all words are unknown. Other columns are ignored; an empty table gives an empty
    result.
    """
    rows = spread(_training_rows(df, id_col, text_col))
    scanned = materialize(scan_scores(rows, model), "lm-scores")
    rare = scanned.select("row", F.explode(F.arrays_zip("words", "packed")).alias("w")).select("row", F.col("w.words").alias("word"), "w.packed")
    joined = rare.join(model.vocabulary.where(F.col("n") * FREQUENT_SHARE < model.tokens).select("word", "n"), "word", "left")
    times, tail, seen = F.expr(f"packed div {TAILS}"), F.expr(f"cast(packed % {TAILS} as int)"), F.col("n").isNotNull()
    of_tail = lambda values: F.array(*[F.lit(float(v)) for v in values])[tail]
    within = F.when(seen, F.log10(F.col("n") - DISCOUNT) - of_tail(np.log10(np.maximum(model.tail_tokens, 1)))).otherwise(of_tail(model.unknown()))
    parts = joined.select("row", F.when(seen, times).otherwise(0).alias("n_known"), (times * F.log10(F.coalesce("n", F.lit(0)) + BASE)).alias("base"), (times * within).alias("score"))
    sums = parts.groupBy("row").agg(*[F.sum(c).alias(f"more_{c}") for c in ("n_known", "base", "score")])
    plus = lambda c: (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c)
    whole = scanned.select("row", "id", "fold", "n_tokens", "n_known", "base", "score").join(sums, "row", "left").select("id", "fold", "n_tokens", *map(plus, ("n_known", "base", "score")))
    return whole.select(
        F.col("id").alias(id_col), (F.col("fold") == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * math.log10(model.tokens + BASE * (model.words + 1))).alias("base_score"), "score",
    )


def score_held_out(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`score` of all rows by the model that those train which are not held out."""
    return score(df, fit(df, id_col, text_col), id_col, text_col)
