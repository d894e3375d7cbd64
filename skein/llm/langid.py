"""Language identification by a mixture over languages.

Each language has log-probabilities of hashed letter trigrams. A word's likelihood in a language is
the product over its trigrams, and a text is a mixture: every word comes from one of its languages,
with the text's language proportions as weights. Expectation-maximisation estimates the proportions;
the set of languages grows by one, in the order of their proportions, as long as the likelihood gains
more than a penalty for each (BIC). The prediction is the language with the largest proportion in the
chosen set, the score that proportion.

Any number of languages is learned: the model holds the trigrams that each was seen with, and one
number for all others, and words are worked on in blocks of bounded size.

Null texts and texts without a letter are ``und`` with score 0; so is every text if no row can be
learned from. Letters alone count, so white space, digits and marks are no evidence. Languages that
tie are taken in alphabetical order. Texts of any length are read whole. Repeated rows get equal
results. Training looks at doc_id (to hold out), text and lang only; prediction at text only, whatever
other columns are called. An empty table gives an empty result.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import common

#: Training reads at most about this many labelled rows of each language, those of the smallest hashes.
TRAIN_ROWS = 3000
#: Slots of the trigram table, and the count that is added to each.
SLOTS, SMOOTHING = 1 << 16, 0.05
#: EM rounds at most, and the change of a proportion that ends it.
ROUNDS, STEADY = 25, 1e-3
#: A word's log-likelihood counts by this much: its trigrams overlap, so they aren't independent evidence.
TEMPER = 0.5
UNKNOWN = "und"
#: Likelihoods (words x languages) that are held at once.
CELLS = 1 << 22
#: Entries of the model, at most (16 bytes each, so 256 MB): a table whose languages need more is refused, as the model is broadcast.
MOST_ENTRIES = 1 << 24
#: Letters beyond this code point don't exist.
CODES = 0x40000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Of each code point: its lower-case letter, or 0 if it is none."""
    out = np.zeros(CODES, np.int64)
    for code in range(len(out)):
        c = chr(code)
        if unicodedata.category(c)[0] == "L":
            low = c.lower()
            out[code] = ord(low) if len(low) == 1 else code
    return out


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the trigrams of all words (runs of letters, with a border on each side), and where each word's begin."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    letters = np.zeros(len(codes) + 2, np.int64)
    letters[1:-1] = np.where(codes < CODES, _letters()[np.minimum(codes, CODES - 1)], 0)
    middle = np.flatnonzero(letters)
    if not len(middle):
        return middle, middle
    mixed = letters[middle - 1] * 0x9E3779B1 + letters[middle] * 0x85EBCA77 + letters[middle + 1] * 0xC2B2AE3D
    slots = (mixed ^ (mixed >> 17)) * 0x27D4EB2F >> 11 & (SLOTS - 1)
    starts = np.flatnonzero(letters[middle - 1] == 0)
    return slots, starts


class Words:
    """The words of a text, and their log-likelihoods in each language."""

    def __init__(self, model: Model, slots: np.ndarray, starts: np.ndarray):
        self.model, self.slots, self.number = model, slots, len(starts)
        self.ends = np.append(starts, len(slots))
        self.step = max(1, CELLS // max(1, len(model.langs)))
        self.kept = [self._likely(0, self.number)] if self.number <= self.step else None

    def _likely(self, lo: int, hi: int) -> np.ndarray:
        first, last = self.ends[lo], self.ends[hi]
        return np.add.reduceat(self.model.rows(self.slots[first:last]), self.ends[lo:hi] - first, axis=0).astype(np.float64) * TEMPER

    def blocks(self):
        """Words x languages, in blocks; those of a long text in many languages are made anew each time."""
        if self.kept is not None:
            return self.kept
        return (self._likely(lo, min(lo + self.step, self.number)) for lo in range(0, self.number, self.step))


def _em(words: Words, which: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the languages ``which``, and the log-likelihood."""
    share = np.full(len(which), 1.0 / len(which))

    def weighed(likely):
        own = likely[:, which]
        top = own.max(axis=1, keepdims=True)
        return np.exp(own - top), top

    held = [weighed(x) for x in words.kept] if words.kept is not None else None
    weights = lambda: held if held is not None else map(weighed, words.blocks())
    for _ in range(ROUNDS):
        new = np.zeros(len(which))
        for weight, _ in weights():
            joint = weight * share
            new += (joint / joint.sum(axis=1, keepdims=True)).sum(axis=0)
        new /= words.number
        done = np.abs(new - share).max() < STEADY
        share = new
        if done:
            break
    return share, float(sum(np.log((weight * share).sum(axis=1)).sum() + top.sum() for weight, top in weights()))


def mixture(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The chosen languages and their proportions, largest first."""
    single = sum(likely.sum(axis=0) for likely in words.blocks())
    k = len(single)
    best = np.array([int(single.argmax())])
    chosen, shares, value = best, np.ones(1), single[best[0]]
    if k > 1:
        every, _ = _em(words, np.arange(k))
        order = [best[0], *(x for x in np.argsort(-every, kind="stable") if x != best[0])]
        for m in range(2, k + 1):
            tried = np.array(order[:m])
            found, gained = _em(words, tried)
            if gained - value <= 0.5 * np.log(max(words.number, 2)) + 1:
                break
            chosen, shares, value = tried, found, gained
    by = np.argsort(-shares, kind="stable")
    return chosen[by], shares[by]


class Model:
    """Log-probabilities by language: ``least`` for all trigrams but those of the entries (slot, language, log above the least)."""

    def __init__(self, langs: list[str], least: np.ndarray, slots: np.ndarray, which: np.ndarray, above: np.ndarray):
        self.langs, self.least = langs, least
        order = np.argsort(slots, kind="stable")
        self.which, self.above = which[order], above[order]
        self.starts = np.searchsorted(slots[order], np.arange(SLOTS + 1))
        self.parts = langs, least, slots, which, above
        self.dense = None
        if SLOTS * len(langs) <= CELLS:
            self.dense = self._rows(np.arange(SLOTS))

    def _rows(self, slots: np.ndarray) -> np.ndarray:
        out = np.tile(self.least, (len(slots), 1))
        sizes = self.starts[slots + 1] - self.starts[slots]
        row = np.repeat(np.arange(len(slots)), sizes)
        at = np.repeat(self.starts[slots] - np.cumsum(sizes) + sizes, sizes) + np.arange(len(row))
        out[row, self.which[at]] += self.above[at]
        return out

    def rows(self, slots: np.ndarray) -> np.ndarray:
        """Log-probabilities, slots x languages."""
        return self._rows(slots) if self.dense is None else self.dense[slots]

    def predict(self, text: str | None) -> tuple[str, float, str]:
        slots, starts = trigrams(text or "")
        if not len(slots) or not self.langs:
            return UNKNOWN, 0.0, ""
        which, shares = mixture(Words(self, slots, starts))
        return self.langs[which[0]], float(shares[0]), ",".join(f"{self.langs[i]}:{s:.3f}" for i, s in zip(which, shares))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def _counted(batches):
    """Partial counts of trigram slots by language, from one task's rows."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            slots, _ = trigrams(text)
            own = sums.setdefault(lang, np.zeros(SLOTS, np.int64))
            own += np.bincount(slots, minlength=SLOTS)
    for lang, own in sums.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(own[at], pa.int64())], ["lang", "slot", "n"])


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learns every value of lang from the labelled rows that aren't held out.

    Of a language with more than ``rows`` of them, those whose hash is under a threshold are read:
    about ``rows``, and the same ones in every run.
    """
    spark = docs.sparkSession
    known = docs.where(~F.coalesce(held_out(), F.lit(False)) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), F.monotonically_increasing_id().alias("row_no"))
    shares = known.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(rows)) / F.count("*")).alias("share"))
    with common.scratch():
        sample = known.join(common.staged(shares, "shares"), "lang").where(common.unit_hash() < F.col("share")).select("text", "lang")
        parts = common.mapped(sample, _counted, "lang string, slot bigint, n bigint", "trigrams")
        sums = common.staged(parts.groupBy("lang", "slot").agg(F.sum("n").alias("n")), "trigram_counts")
        entries = sums.count()
        if entries > MOST_ENTRIES:
            raise ValueError(f"the languages of this table need {entries} entries, above {MOST_ENTRIES}; none is left out silently")
        langs = sorted(r[0] for r in sums.select("lang").distinct().collect())
        if not langs:
            return Model([], np.zeros(0, np.float32), *(np.zeros(0, t) for t in (np.int64, np.int32, np.float32)))
        numbers = spark.createDataFrame(list(enumerate(langs)), "which int, lang string")
        found = sums.join(numbers, "lang").select("which", F.col("slot").cast("int").alias("slot"), "n").orderBy("which", "slot").toArrow()
    which, slots, counts = (found.column(c).to_numpy() for c in ("which", "slot", "n"))
    total = np.bincount(which, counts, len(langs)) + SMOOTHING * SLOTS
    above = np.log(counts + SMOOTHING) - np.log(SMOOTHING)
    return Model(langs, (np.log(SMOOTHING) - np.log(total)).astype(np.float32), slots, which, above.astype(np.float32))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and the proportions of every row; staged."""
    shared = docs.sparkSession.sparkContext.broadcast(model.parts)  # MOST_ENTRIES entries at most

    def run(batches):
        own = Model(*shared.value)
        for batch in batches:
            found = [own.predict(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "lang_pred", "score", "languages"])

    kind = dict(docs.dtypes)["doc_id"]
    return common.mapped(docs.select("doc_id", "text"), run, f"doc_id {kind}, lang_pred string, score double, languages string", "languages")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.ship(spark)
    docs = common.table(spark, sf_dir, "documents")
    out = predict(docs, train(docs))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "languages")


assert sys.byteorder == "little"
