"""Near copies by five-word Jaccard similarity: groups of another search and MinHash bands, then exact verification.

Texts link if the sets of their five-word shingles have a Jaccard similarity of 0.8 at least. The
groups handed in (the near stage gives the SimHash components that the Golay keys retrieve) are
candidates like a band's: each stands for one key more of its members. SimHash distances of texts
that resemble each other by 0.8 run far beyond the three bits of those keys, so bands find the rest.
With 40 bands of 7 MinHashes a pair
at just 0.8 is missed with probability (1 - 0.8^7)^40 < 0.0001, one at 0.9 with less than 10^-11;
nothing else is left to chance, as every candidate is verified by its words.

Words are those of the SimHash fingerprints: ASCII letters in lower case, cut at white space. A
text of fewer than five words has one shingle, all of it; texts without words are alike.

Texts of the same words collapse first. Bands are then joined to one member each, which is
linear. What the links found so far leave apart in a common band is searched exactly by prefixes:
with shingles ordered from rare to frequent among these texts, two sets of 0.8 share a shingle
within the first 0.2 of the larger set and the first 1/9 of the smaller one, at places that leave
room for the overlap they need. Texts that are merely related, however many, have rare shingles of
their own there and don't meet, where bands alone would pair them all.

Null texts and texts without words are alike. Null doc_ids are a value like any other, repeated rows
share their root, an empty table gives an empty result, and other columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm import common
from skein.llm.components import components

SHINGLE, SIMILARITY = 5, Fraction(4, 5)
BANDS, EACH = 40, 7
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_RANDOM = np.random.default_rng(8)
_FACTORS = (_RANDOM.integers(0, 1 << 31, BANDS * EACH, np.uint32) << np.uint32(1)) | np.uint32(1)
_MIX = _RANDOM.integers(0, 1 << 63, EACH, np.uint64) * np.uint64(2) + np.uint64(1)
#: Shingles that are worked on at once.
PIECE = 256


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


def shingles_of(words: list[bytes]) -> set[bytes]:
    """The text's shingles; words hold no spaces, so joining keeps them apart."""
    if len(words) < SHINGLE:
        return {b" ".join(words)}
    return set(map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))))


def bands_of(shingles: set[bytes]) -> list[int]:
    """A signed 64-bit key for each band."""
    hashes = np.fromiter((h >> 32 for h in map(xxhash.xxh3_64_intdigest, shingles)), np.uint32, len(shingles))
    least = np.full(BANDS * EACH, np.iinfo(np.uint32).max, np.uint32)
    for lo in range(0, len(hashes), PIECE):
        np.minimum(least, (hashes[None, lo : lo + PIECE] * _FACTORS[:, None]).min(axis=1), out=least)
    mixed = (least.reshape(BANDS, EACH).astype(np.uint64) * _MIX).sum(axis=1, dtype=np.uint64) ^ np.arange(BANDS, dtype=np.uint64)
    mixed ^= mixed >> np.uint64(31)
    return (mixed * _MIX[0] + np.arange(BANDS, dtype=np.uint64)).view(np.int64).tolist()


def alike(a: set[bytes], b: set[bytes]) -> bool:
    both = len(a & b)
    return both * SIMILARITY.denominator >= (len(a) + len(b) - both) * SIMILARITY.numerator


def _prints(batches):
    for batch in batches:
        names, columns = batch.schema.names[:-1], batch.columns[:-1]
        prints, sizes, bands = [], [], []
        for text in batch.column(len(names)).to_pylist():
            words = words_of(text)
            shingles = shingles_of(words)
            prints.append(xxhash.xxh3_64_intdigest(b" ".join(words)))
            sizes.append(len(shingles))
            bands.append(bands_of(shingles))
        columns = [*columns, pa.array(np.array(prints, np.uint64).view(np.int64), pa.int64()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, [*names, "fp", "size", "bands"])


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, keys, fp (of the words), size (shingles) and bands of every row; staged."""
    rows = docs.select("doc_id", common.id_key().alias(common.ID_KEY), common.text_key().alias(common.TEXT_KEY), common.text_or_empty().cast("binary").alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    return common.mapped(rows, _prints, f"doc_id {kind}, {common.ID_KEY} string, {common.TEXT_KEY} bigint, fp bigint, size bigint, bands array<bigint>", "prints")


def _verified(batches):
    for batch in batches:
        keep = []
        for i, (a, b) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            if alike(shingles_of(words_of(a)), shingles_of(words_of(b))):
                keep.append(i)
        yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))


def texts_of(nodes: DataFrame, docs: DataFrame, members: DataFrame) -> DataFrame:
    """fp and text of each fp of nodes; staged. members has the keys of one row for each fp."""
    asked = common.staged(common.joined(members, nodes, "fp", "left_semi").select("fp", common.ID_KEY, common.TEXT_KEY), "asked")
    marked = docs.select(common.id_key().alias(common.ID_KEY), common.text_key().alias(common.TEXT_KEY), common.text_or_empty().cast("binary").alias("text"))
    found = common.joined(marked, asked.select(common.ID_KEY, common.TEXT_KEY), [common.ID_KEY, common.TEXT_KEY], "left_semi").dropDuplicates([common.ID_KEY, common.TEXT_KEY])
    return common.staged(common.joined(found, asked, [common.ID_KEY, common.TEXT_KEY]).select("fp", "text"), "texts")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (a, b) of fp, those whose texts (fp, text) are alike."""
    pairs = common.staged(pairs.distinct(), "candidates")
    one = common.staged(common.joined(pairs, texts.toDF("a", "text_a"), "a"), "half")
    both = common.joined(one, texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")
    return common.mapped(both, _verified, "a bigint, b bigint", "alike")


def _fits(a: str, b: str):
    """Sets that differ more in size can't be alike."""
    return F.least(a, b) * SIMILARITY.denominator >= F.greatest(a, b) * SIMILARITY.numerator


def _shingled(batches):
    for batch in batches:
        for fp, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            hashes = np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, shingles_of(words_of(text))), np.uint64)).view(np.int64)
            for lo in range(0, len(hashes), 8192):
                part = hashes[lo : lo + 8192]
                yield pa.RecordBatch.from_arrays([pa.array([fp] * len(part), pa.int64()), pa.array(part)], ["fp", "shingle"])


def prefix_pairs(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) of fp with different labels that may be alike by their prefixes; none that is alike is left out.

    texts: fp, text. A shingle that one text alone has can't be shared, but takes its place in the order.
    """
    t, more = SIMILARITY.numerator, SIMILARITY.denominator
    rows = common.mapped(texts, _shingled, "fp bigint, shingle bigint", "shingles")
    sizes = common.staged(common.joined(rows.groupBy("fp").agg(F.count("*").alias("size")), labels, "fp"), "sizes")
    shared = common.staged(rows.groupBy("shingle").agg(F.count("*").alias("texts")).where("texts > 1"), "frequencies")
    met = common.staged(common.joined(rows, shared, "shingle"), "shared_shingles")
    order = Window.partitionBy("fp").orderBy("texts", "shingle")
    # From the end, as the shingles of one text alone come first: their number needs no rows.
    met = common.joined(met.withColumn("rest", F.count("*").over(Window.partitionBy("fp")) - F.row_number().over(order) + 1), sizes, "fp")
    # The longest prefix has size - ceil(t size) + 1 shingles: the first at which t size or more are left, itself included.
    probe = common.staged(met.where(F.col("rest") * more >= F.col("size") * t), "prefixes").select("shingle", "fp", "label", "size", "rest")
    # The smaller set's need only have size - ceil(2 t / (1 + t) size) + 1.
    index = probe.where(F.col("rest") * (more + t) >= F.col("size") * 2 * t).toDF("shingle", "fp2", "label2", "size2", "rest2")
    later = (F.col("size") > F.col("size2")) | ((F.col("size") == F.col("size2")) & (F.col("fp") > F.col("fp2")))
    room = F.least("rest", "rest2") * (more + t) >= (F.col("size") + F.col("size2")) * t
    pairs = common.joined(probe, index, "shingle").where((F.col("label") != F.col("label2")) & later & _fits("size", "size2") & room)
    return pairs.select(F.col("fp").alias("a"), F.col("fp2").alias("b"))


def near_roots(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """doc_id, keys and root of every row: rows that links lead to one another have the same root.

    groups: ID_KEY, TEXT_KEY and root of rows that another search has put together. All links within
    a group are found, as within a band.
    """
    with common.scratch() as keep:
        rows = prints(docs)
        first = F.min(F.struct(common.ID_KEY, common.TEXT_KEY)).alias("first")
        members = common.staged(rows.groupBy("fp").agg(F.count("*").alias("copies"), first, F.min("size").alias("size"), F.min("bands").alias("bands")).select("fp", "copies", "size", "bands", "first.*"), "members")
        keyed = members.select(F.explode("bands").alias("key"), "fp", "size", "copies")
        if groups is not None:
            # Rows with the same keys have the same text, so the first of them speaks for its words. Numbered apart from the bands, whose hashes name them.
            own = groups.groupBy(common.ID_KEY, common.TEXT_KEY).agg(F.min("root").alias("root"))
            own = common.joined(members, own, [common.ID_KEY, common.TEXT_KEY])
            keyed = keyed.unionByName(own.select(F.xxhash64(F.lit("group"), "root").alias("key"), "fp", "size", "copies"))
        keyed = common.staged(keyed, "keyed")
        tops = keyed.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("copies", "fp", "size")).alias("top")).where("n > 1")
        tops = common.staged(tops.select("key", F.col("top.fp").alias("top"), F.col("top.size").alias("top_size")), "tops")
        # Keys of a single member lead nowhere. The texts of the others are looked up once.
        met = common.staged(common.joined(keyed, tops, "key").select("key", "fp", "size", "top", "top_size"), "met")
        texts = texts_of(met.select("fp").distinct(), docs, members)
        stars = components(verified(met.where((F.col("fp") != F.col("top")) & _fits("size", "top_size")).select(F.col("fp").alias("a"), F.col("top").alias("b")), texts))
        labels = common.staged(common.joined(members, stars.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("label")), "labels")
        # What the stars left apart asks again.
        shared = common.staged(common.joined(met.select("key", "fp"), labels, "fp").select("key", "fp", "label"), "shared")
        apart = shared.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
        asked = common.staged(common.joined(shared, common.staged(apart, "apart"), "key", "left_semi").select("fp").distinct(), "apart_members")
        links = verified(prefix_pairs(common.joined(texts, asked, "fp", "left_semi"), labels), texts)
        # The stars as links of their own join what the pairs lead to.
        whole = components(links.unionByName(labels.where("fp <> label").select(F.col("fp").alias("a"), F.col("label").alias("b"))))
        roots = common.staged(common.joined(members, whole.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "near_roots")
        return keep(common.joined(rows, roots, "fp").select("doc_id", common.ID_KEY, common.TEXT_KEY, "root"), "near")
