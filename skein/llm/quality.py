"""Quality rules: how far a document's histograms are from its language's reference.

Each document is counted once: the base counts, a histogram of character classes and one of the
common words of its language. The references are the sums of these histograms over all documents
of a language that pass the base rules, so they follow the corpus. A document is dropped if the
Jensen-Shannon distance (base 2, from 0 to 1) of either histogram is too large; histograms of
documents under a minimum length are too noisy and are not judged.

The language is ``lang``. Where that is null or blank, it is the list with most hits in the text
if a fifth of its words at least are hits and no other list has half as many: related languages share
short words. A text whose language has no list, or is unsure, has no reference: it isn't judged, and the base rules alone decide. Null and
empty texts have no words, so the base rules drop them. Texts of any length are read whole. Repeated
rows count as often as they are there. An empty table gives an empty result. Only doc_id, text and
lang are read, whatever other columns are called.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import common

#: Frequent words of four languages.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "en": "the of and to in a is that it for on was with as be by this are from or at not have but which they you were an his".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me sin".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son lui".split(),
}
#: Words of a text at least for its histogram to be judged.
CLASS_GUARD, WORD_GUARD = 20, 40
#: The largest distances: a constant, and a part that shrinks with the square root of the words, as a sample's distance does.
CLASS_LIMIT, WORD_LIMIT = (0.10, 1.5), (0.15, 1.35)

#: Where ``lang`` names none: the share of a text's words that its list must hold, and of these hits, what another one may have.
LEAST_HITS, OTHER_HITS = 0.2, 0.5
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "line", "stop", "symbol", "mark", "accented lower", "accented upper", "other")
WORD_BINS = max(map(len, COMMON_WORDS.values())) + 1
LANGS = sorted(COMMON_WORDS)
_PUNCTUATION = b".,;:!?\"'()-"


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each code point of plane 0; those beyond are 'other'."""
    out = np.full(0x10000, CLASSES.index("other"), np.uint8)
    for code in range(0x10000):
        c, kind = chr(code), unicodedata.category(chr(code))
        if c == "\n":
            name = "line"
        elif c in common.SPACE or kind == "Zs":
            name = "space"
        elif code < 128 and code in SYMBOLS:
            name = "symbol"
        elif code < 128 and code in _PUNCTUATION:
            name = "mark" if c in "!?" else "stop"
        elif kind in ("Ll", "Lo"):
            name = "lower" if code < 128 else "accented lower"
        elif kind == "Lu":
            name = "upper" if code < 128 else "accented upper"
        elif kind == "Nd":
            name = "digit"
        else:
            name = "other"
        out[code] = CLASSES.index(name)
    return out


def class_histogram(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    return np.bincount(_classes()[np.minimum(codes, 0xFFFF)], minlength=len(CLASSES))


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of eight that are found twice or more, the first one included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    if len(numbers) == len(words):
        return 0
    for step in (1, 2, 4):  # windows of 2, 4 and 8 words, numbered exactly
        pairs = ids[:-step] * (int(ids.max()) + 1) + ids[step:]
        _, ids, counts = np.unique(pairs, return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[ids] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + WINDOW, -1)
    return int((np.cumsum(edges) > 0).sum())


_WORD_AT = {lang: {w.encode(): i for i, w in enumerate(words)} for lang, words in COMMON_WORDS.items()}
_TRIM = b".,;:!?\"'()"


def measure(text: str, lang: str | None) -> tuple:
    data = text.encode("utf-8", "replace")
    words = data.split()  # bytes.split() cuts at space and U+0009 to U+000D only
    lines = [x for x in data.split(b"\n") if x.strip()]
    chars = len(text) - sum(map(text.count, common.SPACE))
    counted = Counter(w.strip(_TRIM).lower() for w in words)
    if lang is None or not lang.strip():
        hits = {x: sum(counted[w] for w in _WORD_AT[x]) for x in LANGS}
        other, lang = sorted(LANGS, key=hits.get)[-2:]
        if hits[lang] < LEAST_HITS * len(words) or hits[other] >= OTHER_HITS * hits[lang]:
            lang = None
    elif lang not in _WORD_AT:
        lang = None
    hist = [0] * WORD_BINS
    for w, i in _WORD_AT.get(lang, {}).items():
        hist[i] = counted.get(w, 0)
    hist[-1] = len(words) - sum(hist)
    return len(words), chars, sum(data.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), lang, class_histogram(text), hist


_FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
           ("ref_lang", pa.string()), ("classes", pa.list_(pa.int32())), ("common", pa.list_(pa.int32()))]


def _measured(batches):
    for batch in batches:
        texts, langs = (batch.column(i).to_pylist() for i in (-2, -1))
        found = [measure(t, lang) for t, lang in zip(texts, langs)]
        columns = [pa.array([f[i] for f in found], kind) for i, (_, kind) in enumerate(_FIELDS)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *columns], [*batch.schema.names[:-2], *(n for n, _ in _FIELDS)])


def measures(docs: DataFrame) -> DataFrame:
    """Counts and histograms of every row, staged."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", common.id_key().alias(common.ID_KEY), common.text_key().alias(common.TEXT_KEY), common.text_or_empty().alias("text"), lang.alias("lang"))
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, {common.ID_KEY} string, {common.TEXT_KEY} bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, ref_lang string, classes array<int>, common array<int>"
    out = common.mapped(rows, _measured, schema, "measures")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def references(measured: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Of each language, the shares of the classes and of the common words in all its documents that pass the base rules.

    There is a row for each word list, so what comes to the driver is of fixed size.
    """
    sums = [F.sum(F.col(c)[i].cast("double")).alias(f"{c}{i}") for c, n in (("classes", len(CLASSES)), ("common", WORD_BINS)) for i in range(n)]
    out = {}
    for row in measured.where("NOT base_failed AND ref_lang IS NOT NULL").groupBy("ref_lang").agg(*sums).collect():
        values = [v or 0.0 for v in row[1:]]
        parts = values[: len(CLASSES)], values[len(CLASSES) :]
        out[row[0]] = tuple([v / max(1.0, sum(p)) for v in p] for p in parts)
    return out


def _entropy(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.log2(x)).otherwise(0.0))


def distance(hist: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of a histogram of counts from a distribution; null if there are no counts."""
    total = F.aggregate(hist, F.lit(0.0), lambda s, x: s + x)
    p = F.transform(hist, lambda x: x / total)
    middle = F.zip_with(p, reference, lambda a, b: (a + b) / 2)
    return F.when(total > 0, F.sqrt(F.greatest(F.lit(0.0), _entropy(middle) - (_entropy(p) + _entropy(reference)) / 2)))


def _judged(measured: DataFrame, known: dict) -> DataFrame:
    def reference(part: int) -> Column:
        out = F.lit(None).cast("array<double>")
        for lang in sorted(known):
            out = F.when(F.col("ref_lang") == lang, F.array(*map(F.lit, known[lang][part]))).otherwise(out)
        return out

    out = measured.withColumns({"class_distance": distance(F.col("classes"), reference(0)), "word_distance": distance(F.col("common"), reference(1))})
    far = F.lit(False)
    for guard, (limit, spread), c in ((CLASS_GUARD, CLASS_LIMIT, "class_distance"), (WORD_GUARD, WORD_LIMIT, "word_distance")):
        far = far | ((F.col("n_words") >= guard) & (F.coalesce(F.col(c), F.lit(0.0)) > limit + spread / F.sqrt(F.greatest("n_words", F.lit(1)))))
    return out.withColumn("kept", ~(F.col("base_failed") | far))


def judge(measured: DataFrame) -> DataFrame:
    """Adds class_distance, word_distance and kept.

    The first references contain what the base rules miss; the second ones are the sums over all
    documents that the first ones keep.
    """
    first = _judged(measured, references(measured)).where("kept").select(measured.columns)
    return _judged(measured, references(first))


def quality(docs: DataFrame) -> DataFrame:
    return judge(measures(docs))


def passed(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep."""
    return common.rows_of(docs, quality(docs).where("kept").select(common.ID_KEY, common.TEXT_KEY).distinct(), distinct=False)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.ship(spark)
    out = quality(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")
