"""SimHash near-dedup with Golay-code keys.

A fingerprint is cut into three segments A, B, C of 22, 21 and 21 bits. The perfect Golay code
maps every segment value to the one codeword within three bits of it, and a value together with
its one-bit neighbours to one or a few codewords. So two values that differ in at most one bit
share a codeword index if one side looks up its neighbourhood and the other stores its own.

With at most three differing bits, the errors of the segments, in order, are e1 <= e2 <= e3 with
e2 <= 1. Either e1 = 0: one segment is equal and another is within one bit (keys: the exact
segment and a codeword index of the other, for the six ordered pairs). Or each has exactly one
error: codeword indices of A and B with an error-free half of C (two keys); the fingerprints then
differ in parity, so only even ones look up and only odd ones store. No link can be missed; every
candidate is verified by its bit count.

Copies collapse to one distinct fingerprint first. A bucket of many fingerprints close to each
other is first joined to its most copied member only, which is linear; the exact search then asks
just for links between what is still apart, so its output doesn't grow with a group's square. Nothing
that grows with the input is broadcast, so the driver holds no table.

Null texts and texts without words have fingerprint zero and link like any other; texts of any
length are read whole. Null doc_ids count as largest. Repeated rows share their fingerprint. An
empty table gives an empty result. Only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import common, resemblance
from skein.llm.components import components

SEED, SHINGLE, DISTANCE = 42, 3, 3
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_LANES = np.uint64(0x0101010101010101)

# ---------------------------------------------------------------- fingerprints


def fingerprint(text: bytes) -> int:
    words = text.translate(_LOWER).split()  # bytes.split() cuts at space and U+0009 to U+000D only
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles, n = [b" ".join(words)], 1
    else:
        shingles, n = map(b" ".join, zip(words, words[1:], words[2:])), len(words) - SHINGLE + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    starts = np.arange(0, n, 255)  # sums of 255 rows fit a byte lane
    out = 0
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, starts)
        ones = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)  # of bits bit, bit + 8, ...
        for byte in np.flatnonzero(2 * ones > n):
            out |= 1 << (bit + 8 * int(byte))
    return out


def _fingerprints(batches):
    for batch in batches:
        prints = [fingerprint(t) for t in batch.column(len(batch.columns) - 1).to_pylist()]
        columns = [*batch.columns[:-1], pa.array(np.array(prints, np.uint64).view(np.int64), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, keys and fp (the 64 bits as a signed long) of every row; staged."""
    rows = docs.select("doc_id", common.id_key().alias(common.ID_KEY), common.text_key().alias(common.TEXT_KEY), common.text_or_empty().cast("binary").alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    return common.mapped(rows, _fingerprints, f"doc_id {kind}, {common.ID_KEY} string, {common.TEXT_KEY} bigint, fp bigint", "fingerprints")


# ---------------------------------------------------------------- Golay keys

#: The generator polynomial of the binary Golay code [23, 12, 7].
GOLAY = 0b110001110101
#: Offset and width of the segments, and of the halves of C.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
HALVES = ((43, 10), (53, 11))
PAIRS = [(x, y) for x in range(3) for y in range(3) if x != y]


def _remainders() -> np.ndarray:
    """x^11 * m modulo the generator, for every 12-bit m."""
    out = np.arange(4096, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        out = np.where(out >> bit & 1, out ^ (GOLAY << (bit - 11)), out)
    return out


def _errors(remainders: np.ndarray) -> np.ndarray:
    """The error pattern of at most three bits for each of the 2048 syndromes."""
    one = np.concatenate([[0], 1 << np.arange(23)])
    a, b, c = np.meshgrid(one, one, one, indexing="ij")
    words = np.unique((a | b | c).ravel())
    out = np.zeros(2048, np.int64)
    out[remainders[words >> 11] ^ (words & 2047)] = words
    return out


_REMAINDERS = _remainders()
_ERRORS = _errors(_REMAINDERS)


def codeword_index(values: np.ndarray) -> np.ndarray:
    """The 12 message bits of the codeword within three bits of each 23-bit value."""
    return (values ^ _ERRORS[_REMAINDERS[values >> 11] ^ (values & 2047)]) >> 11


def _segment(prints: np.ndarray, offset: int, width: int) -> np.ndarray:
    return (prints >> np.uint64(offset) & np.uint64((1 << width) - 1)).astype(np.int64)


def _near(values: np.ndarray, width: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions and codeword indices, each once, of the one-bit neighbours (own: and of the value)."""
    flips = 1 << np.arange(width)
    around = values[:, None] ^ np.concatenate([[0], flips] if own else [flips])[None, :]
    indices = np.sort(codeword_index(around), axis=1)
    first = np.ones(indices.shape, bool)
    first[:, 1:] = indices[:, 1:] != indices[:, :-1]
    at = np.nonzero(first)
    return at[0], indices[at]


def _pack(family: int, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (np.int64(family) << np.int64(48)) | (high << np.int64(12)) | low


def _odd(prints: np.ndarray) -> np.ndarray:
    return (np.bitwise_count(prints) & 1).astype(bool)


def stored_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in prints, and the keys under which they are stored."""
    parts = [_segment(prints, *s) for s in SEGMENTS]
    golay = [codeword_index(p) for p in parts]
    every = np.arange(len(prints))
    at, keys = [every] * 6, [_pack(k, parts[x], golay[y]) for k, (x, y) in enumerate(PAIRS)]
    odd = np.flatnonzero(_odd(prints))
    for k, half in enumerate(HALVES):
        at.append(odd)
        keys.append(_pack(6 + k, (_segment(prints[odd], *half) << 12) | golay[0][odd], golay[1][odd]))
    return np.concatenate(at), np.concatenate(keys)


def looked_up_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in prints, and the keys under which they look for others."""
    parts = [_segment(prints, *s) for s in SEGMENTS]
    around = [_near(p, width, True) for p, (_, width) in zip(parts, SEGMENTS)]
    at, keys = [], []
    for k, (x, y) in enumerate(PAIRS):
        rows, golay = around[y]
        at.append(rows)
        keys.append(_pack(k, parts[x][rows], golay))
    even = np.flatnonzero(~_odd(prints))
    (rows_a, a), (rows_b, b) = (_near(parts[s][even], SEGMENTS[s][1], False) for s in (0, 1))
    # all pairs of an index of A and one of B of the same fingerprint
    starts, counts = np.searchsorted(rows_b, rows_a), np.bincount(rows_b, minlength=len(even))[rows_a] if len(even) else np.zeros(0, np.int64)
    left = np.repeat(np.arange(len(rows_a)), counts)
    right = np.arange(len(left)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
    rows = even[rows_a[left]]
    for k, half in enumerate(HALVES):
        at.append(rows)
        keys.append(_pack(6 + k, (_segment(prints[rows], *half) << 12) | a[left], b[right]))
    return np.concatenate(at), np.concatenate(keys)


def _keys(kind):
    def run(batches):
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(prints):
                continue
            for lo in range(0, len(prints), 4096):
                part = prints[lo : lo + 4096]
                at, keys = kind(part)
                columns = [pa.array(keys, pa.int64()), *(c.take(pa.array(at + lo)) for c in batch.columns)]
                yield pa.RecordBatch.from_arrays(columns, ["key", *batch.schema.names])

    return run


def keyed(prints: DataFrame, kind) -> DataFrame:
    """prints (fp, label) with a row for each key of each."""
    return prints.select("fp", "label").mapInArrow(_keys(kind), "key bigint, fp bigint, label bigint")


# ---------------------------------------------------------------- links and components


def _close(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= DISTANCE


def star_links(prints: DataFrame) -> DataFrame:
    """Links from the members of a bucket to its most copied member: as many as there are keys, at most."""
    stored = keyed(prints.select("fp", F.col("copies").alias("label")), stored_keys)
    top = F.max(F.struct("label", "fp"))
    tops = stored.groupBy("key").agg(F.count("*").alias("n"), top.alias("top")).where("n > 1").select("key", F.col("top.fp").alias("top"))
    links = common.joined(stored, common.staged(tops, "tops"), "key").where((F.col("fp") != F.col("top")) & _close("fp", "top"))
    return links.select(F.col("fp").alias("a"), F.col("top").alias("b"))


def cross_links(labelled: DataFrame) -> DataFrame:
    """Of prints (fp, label): the pairs of labels between which fingerprints link.

    Only keys under which another label is stored are asked any further, so that a bucket whose
    members are together already makes no pairs. Both sides of the last join are staged, so that the
    planner can split what is left of a large bucket.
    """
    stored = common.staged(keyed(labelled, stored_keys), "stored")
    asked = keyed(labelled, looked_up_keys).toDF("key", "fp2", "label2")
    there = stored.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    asked = common.joined(asked, there, "key").where((F.col("label2") != F.col("low")) | (F.col("label2") != F.col("high")))
    asked = common.staged(asked.select("key", "fp2", "label2"), "asked")
    stored = common.staged(common.joined(stored, asked.select("key").distinct(), "key", "left_semi"), "stored")
    met = common.joined(asked, stored, "key").where((F.col("label") != F.col("label2")) & _close("fp", "fp2"))
    return met.select(F.least("label", "label2").alias("a"), F.greatest("label", "label2").alias("b")).distinct()


def components_of(rows: DataFrame) -> DataFrame:
    """rows (doc_id, fp) -> fp, component_id: the smallest doc_id that links lead to, and root: the component's own fingerprint."""
    with common.scratch() as keep:
        prints = common.staged(rows.groupBy("fp").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")), "prints")
        stars = components(star_links(prints))
        labelled = common.joined(prints, stars.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("label"), "first_id")
        labelled = common.staged(labelled, "labelled")
        roots = components(cross_links(labelled))
        joined = common.joined(labelled, roots.withColumnRenamed("node", "label"), "label", "left").select("fp", F.coalesce("root", "label").alias("root"), "first_id")
        joined = common.staged(joined, "rooted")
        least = common.staged(joined.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
        return keep(common.joined(joined, least, "root").select("fp", "component_id", "root"), "components")


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keys, fp, component_id and root of every row; staged."""
    with common.scratch() as keep:
        rows = fingerprints(docs)
        return keep(common.joined(rows, components_of(rows), "fp").select("doc_id", "fp", "component_id", "root", common.ID_KEY, common.TEXT_KEY), "near")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of docs from each group of near copies, with all its columns: that of its smallest doc_id.

    The components that the Golay keys retrieve are searched for texts that are 0.8 alike by their
    five-word shingles. Three bits are too few to bring all of these together, so MinHash bands are
    searched as well (resemblance). A group is known by its root, as groups may share a doc_id or have none.
    """
    # Null doc_ids come last; where rows share that doc_id, the least text key stands for them.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnumbered"), "doc_id", common.TEXT_KEY, common.ID_KEY)).alias("first")
    with common.scratch() as keep:
        kept = keep(resemblance.near_roots(docs, near_dedup(docs)).groupBy("root").agg(first).select("first.*"), "firsts")
    return common.rows_of(docs, kept, distinct=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.ship(spark)
    out = near_dedup(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
