"""Language identification by inference of multilingual mixtures.

A document is a bag of letter n-grams drawn from a mixture of languages. Expectation-maximisation estimates
the mixture's proportions from n-gram likelihoods; the set of languages is chosen by penalised likelihood:
starting from the likeliest language, languages join while the gain in log-likelihood beats the price of a
parameter. A background that knows no language takes up what fits none.

n-grams are of one to four UTF-8 bytes of lower-cased letters, blanks around words included, hashed to a
fixed number of bins, so a model is languages x bins whatever it is trained on, and a document is a row of
counts. Training counts are sums over all labelled rows, made map-side.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waveloom.llm.common import spread, worker
from waveloom.llm.packing import text_slices
from waveloom.llm.shingles import mix

BINS = 1024
ORDERS = (2, 3, 4)
#: Languages that a model holds: the training table is languages x bins on the driver, of 8 KB a language. Of more
#: labels than that those with the most n-grams are learned.
MOST_LANGUAGES = 4096
#: Bytes of text that are counted together. A longer text is counted in parts, cut at blanks.
PART = 1 << 19
#: A language joins the set if it wins so much log-likelihood for each doubling of the n-grams.
PRICE = 3.0
ROUNDS = 10
#: Share of the probability that each language leaves to n-grams that it has not shown.
SMOOTHING = 0.5

@lru_cache(1)
def _byte_codes() -> np.ndarray:
    """Code of a byte: a-z and bytes beyond ASCII as they are, all else a blank (0)."""
    code = np.zeros(256, np.uint64)
    code[97:123] = np.arange(97, 123)
    code[128:] = np.arange(128, 256)
    return code


def gram_counts(texts: list[str]) -> np.ndarray:
    """Counts of the n-grams of texts, texts x BINS. Inner bytes are letters; a blank may stand at either
    end, so starts and ends of words tell."""
    data = [b" %s " % t.lower().encode() for t in texts]
    bounds = np.cumsum([0, *map(len, data)])
    code = _byte_codes()[np.frombuffer(b"".join(data), np.uint8)]
    letter = code > 0
    places = []
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    for n in ORDERS:
        size = max(0, len(code) - n + 1)
        ok = letter[:size] | letter[1 : 1 + size] if n == 2 else letter[1 : 1 + size].copy()
        for k in range(2, n - 1):
            ok &= letter[k : k + size]
        ok &= owner[:size] == owner[n - 1 : n - 1 + size]
        at = np.flatnonzero(ok)
        h = np.full(len(at), np.uint64(n))
        for k in range(n):
            h = h << np.uint64(8) | code[at + k]
        places.append((mix(h) >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64) + owner[at] * BINS)
    return np.bincount(np.concatenate(places), minlength=BINS * len(texts)).reshape(len(texts), BINS).astype(np.float32)


def counts_of(texts: list[str]) -> np.ndarray:
    """:func:`gram_counts` of texts of any length. A blank between parts stands at the ends of both, as in the
    whole; a run of letters longer than a part is cut in it."""
    if len(texts) > 1 or not texts or len(texts[0]) <= PART:
        return gram_counts(texts)
    text, at, total = texts[0], 0, np.zeros((1, BINS), np.float32)
    while at < len(text):
        cut = text.rfind(" ", at, at + PART) if at + PART < len(text) else len(text)
        cut = cut if cut > at else min(at + PART, len(text))
        total += gram_counts([text[at:cut]])
        at = cut
    return total


@dataclass(frozen=True)
class LanguageModel:
    """Probabilities, bins x languages, the last column the background; and the languages' shares."""

    languages: tuple[str, ...]
    probability: np.ndarray
    prior: np.ndarray

    def mixtures(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(proportions of the languages and the background, whether any n-gram was there) per row."""
        n, k = len(counts), self.probability.shape[1]
        p = self.probability
        total = counts.sum(1)
        alone = counts @ np.log(p)
        background = k - 1
        chosen = np.zeros((n, k), bool)
        chosen[:, background] = True
        price = PRICE * np.log(np.maximum(total, 2))
        if background:
            chosen[np.arange(n), (alone[:, :background] + np.log(self.prior)).argmax(1)] = True
        weights, fit = self._em(counts, chosen)
        active = np.flatnonzero(total > 0) if background > 1 else np.zeros(0, np.int64)
        while len(active):
            # the language whose n-grams gain most where the present mixture explains them least
            ratio = counts[active] / np.maximum(weights[active] @ p.T, 1e-30)
            gain = ratio @ p
            gain[chosen[active]] = -np.inf
            gain[:, background] = -np.inf
            best = gain.argmax(1)
            open_ = gain[np.arange(len(active)), best] > total[active]  # more of it would raise the likelihood
            active, best = active[open_], best[open_]
            if not len(active):
                break
            wider = chosen[active].copy()
            wider[np.arange(len(active)), best] = True
            new_weights, new_fit = self._em(counts[active], wider)
            better = new_fit - fit[active] > price[active]
            active = active[better]
            chosen[active], weights[active], fit[active] = wider[better], new_weights[better], new_fit[better]
            active = active[chosen[active].sum(1) < k]
        return weights, total > 0

    def _em(self, counts: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions over each row's chosen languages, and the log-likelihood."""
        p = self.probability
        weights = chosen / chosen.sum(1, keepdims=True)
        weights = weights.astype(np.float32)
        total = np.maximum(counts.sum(1, keepdims=True), 1)
        for _ in range(ROUNDS):
            weights = weights * ((counts / np.maximum(weights @ p.T, 1e-30)) @ p) / total
        return weights, (counts * np.log(np.maximum(weights @ p.T, 1e-30))).sum(1)


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """A model of all labelled rows of ``df``. Rows without text or language teach nothing. Each task sends
    a row of counts per language. The most frequent MOST_LANGUAGES labels are learned."""

    @worker
    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in text_slices(whole, "text", PART):
                langs = batch.column("lang").to_pylist()
                counts = counts_of(batch.column("text").to_pylist())
                for lang in set(langs):
                    held = counts[[i for i, x in enumerate(langs) if x == lang]].sum(0, dtype=np.float64)
                    sums[lang] = sums[lang] + held if lang in sums else held
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))], ["lang", "counts"])

    rows = df.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    sums = spread(rows).mapInArrow(count, "lang string, counts array<double>")
    long = sums.select("lang", F.posexplode("counts").alias("bin", "n")).groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    per = long.groupBy("lang").agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("held"))
    per = per.orderBy(F.desc("total"), "lang").limit(MOST_LANGUAGES).select("lang", F.transform("held", lambda x: x.n).alias("held")).toArrow()
    table = {lang: np.array(held.values) for lang, held in zip(per.column("lang").to_pylist(), per.column("held"), strict=True)}
    languages = tuple(sorted(lang for lang, c in table.items() if c.sum() > 0))
    everything = sum((table[x] for x in languages), np.zeros(BINS)) + 1
    common = everything / everything.sum()
    columns = [(table[x] + SMOOTHING * 1000 * common) / (table[x].sum() + SMOOTHING * 1000) for x in languages]
    background = np.full(BINS, 1 / BINS)
    shares = np.array([table[x].sum() for x in languages])
    return LanguageModel(languages, np.stack([*columns, background], 1).astype(np.float32), shares / max(shares.sum(), 1))


def identify(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, lang_pred, score, mixture per row, and the columns ``keep``. lang_pred is the language with the
    largest share, score its share among everything (0 to 1), mixture the shares of the chosen languages
    (without the background).

    A text that is null or has no letter is ``und`` with score 0 and no mixture; so is every text if the
    model has no language. A tie goes to the first language by name. Rows are taken one by one.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    fields = [df.schema[c] for c in dict.fromkeys((id_col, *keep))]
    names = [f.name for f in fields]

    @worker
    def predict(batches):
        m = shared.value
        for whole in batches:
            sized = whole.rename_columns([*names, "__text"])
            for batch in text_slices(sized, "__text", PART):
                texts = [t or "" for t in batch.column("__text").to_pylist()]
                pred, score, mixture = [], [], []
                weights, any_ = m.mixtures(counts_of(texts)) if m.languages and texts else (np.zeros((len(texts), 1)), np.zeros(len(texts), bool))
                for text, w, ok in zip(texts, weights, any_, strict=True):
                    if not ok or not any(map(str.isalpha, text)):
                        pred.append("und")
                        score.append(0.0)
                        mixture.append([])
                        continue
                    own = w[:-1]
                    top = int(own.argmax())
                    pred.append(m.languages[top])
                    score.append(float(min(max(own[top], 0.0), 1.0)))
                    mixture.append([(m.languages[i], float(own[i])) for i in np.flatnonzero(own > 1e-4)])
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mixture, pa.map_(pa.string(), pa.float64()))], [*names, "lang_pred", "score", "mixture"])

    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("mixture", T.MapType(T.StringType(), T.DoubleType()))]
    source = df.select(*names, F.col(text_col).alias("__text"))
    return spread(source).mapInArrow(predict, T.StructType([*fields, *new]))


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: crc32 of its id as text leaves 2 by 4. A null id trains."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify_held_out(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, held_out, lang_pred, score, mixture of every row, by a model of the rows that are not held out."""
    model = train(df.where(~held_out(id_col)), text_col, lang_col)
    return identify(df, model, id_col, text_col).withColumn("held_out", held_out(id_col)).select(id_col, "held_out", "lang_pred", "score", "mixture")
