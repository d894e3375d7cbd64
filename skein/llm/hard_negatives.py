"""Hard-negative mining: exact windows of inner products through product quantisation.

Components become integers, and a score is an integer inner product. Rows are quantised: each part of
a vector is known by its nearest centroid (of whole numbers), and the norm of what is left is stored.
An anchor's score of a row then lies within a bound of the sum that its lookup table gives: the norms
of the anchor's parts times the stored ones. What the bounds leave open is scored exactly on the
integers: the first pass finds each anchor's positives, the best rows of its own label; the second one,
for each positive, the best rows of other labels whose score stands in a window below the positive's.
As the bounds hold for every row, the result doesn't depend on the centroids.

Rows are dealt to parts of bounded size by a hash of their number. Anchors go to all parts, which they
stream through; a part gives each anchor no more rows than it can keep, and what the parts give is
ranked by anchor. No pair of a row and an anchor is ever a row of a table.

Rows with a null label, a null vector, or a null or non-finite component take no part. Of vectors of
different lengths, the shorter ones count as continued by zeros. A null vec_id is no anchor, keeps its
label, and comes last among equal scores; rows that share a vec_id are rows of their own, each an
anchor if that number is one, and what is equal in all that is returned is returned as often. An empty
table gives an empty result. Scores beyond 64 bits are refused. Only the named columns are read,
whatever other columns are called.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm import common

SCALE = 256
#: Rows whose vec_id these numbers divide: anchors, and rows whose label first goes up by one.
ANCHORS, SHIFTED, LABELS = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
#: The window: LOW * positive <= 100 * negative <= HIGH * positive.
LOW, HIGH = 50, 95
#: Rows of a part, at most about so many; and parts for each core, so that all have work.
PART_ROWS, PARTS_A_CORE = 1 << 16, 3
#: Components that are quantised together, centroids of each such part, and rows (about) that these are fitted on.
PART_WIDTH, CENTROIDS, FIT_ROWS, FIT_ROUNDS = 2, 256, 8192, 6
#: Bounds (rows x anchors) that are held at once, and pairs that are scored at once.
CELLS, PAIRS = 1 << 20, 1 << 15


def prepared(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """row_no, vec_id, label and the integer vector v of the rows that take part; staged."""
    values = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall(values, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    moved = F.coalesce(F.col("vec_id") % SHIFTED == 0, F.lit(False))
    label = F.when(moved, (F.col("label") + 1) % LABELS).otherwise(F.col("label")).cast("bigint")
    rows = vectors.where(F.col("label").isNotNull() & F.col(vector).isNotNull()).where(finite)
    whole = F.transform(values, lambda x: F.floor(x * SCALE))
    return common.staged(rows.select(F.monotonically_increasing_id().alias("row_no"), F.col("vec_id").cast("bigint").alias("vec_id"), label.alias("label"), whole.cast("array<bigint>").alias("v")), "vectors")


def fit(rows: DataFrame, width: int, n: int) -> list[np.ndarray]:
    """Centroids of whole numbers for each part of the vectors, from about FIT_ROWS rows (a bounded sample, by a hash of the row's number)."""
    unit = F.pmod(F.xxhash64("row_no"), F.lit(1 << 30)) / float(1 << 30)
    sample = np.array([_filled(r.v, width) for r in rows.where(unit < FIT_ROWS / max(n, 1)).select("v").collect()], np.float64).reshape(-1, width)
    books = []
    for part in _parts(sample):
        points = np.unique(part, axis=0)
        book = points[np.linspace(0, len(points) - 1, min(CENTROIDS, len(points))).astype(int)] if len(points) else np.zeros((1, part.shape[1]))
        for _ in range(FIT_ROUNDS):
            near = _nearest(part, book)
            size = np.bincount(near, minlength=len(book))
            sums = np.zeros_like(book)
            np.add.at(sums, near, part)
            book = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], book)
        books.append(np.rint(book))
    return books


def _filled(v: list[int], width: int) -> list[int]:
    return [*v, *[0] * (width - len(v))]


def _parts(matrix: np.ndarray) -> list[np.ndarray]:
    return np.array_split(matrix, max(1, math.ceil(matrix.shape[1] / PART_WIDTH)), axis=1)


def _nearest(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book**2).sum(axis=1) - 2 * points @ book.T).argmin(axis=1) if len(points) else np.zeros(0, np.int64)


class Part:
    """Some of the rows, quantised, and in the order of their labels."""

    def __init__(self, books: list[np.ndarray], row_no, vec_id, label, vectors):
        order = np.argsort(label, kind="stable")
        self.row_no, self.vec_id, self.label, self.vectors = row_no[order], vec_id[order], label[order], vectors[order]
        self.books, self.codes, norms = books, [], []
        for part, book in zip(_parts(self.vectors.astype(np.float64)), books):
            code = _nearest(part, book)
            self.codes.append(code)
            norms.append(np.sqrt(((part - book[code]) ** 2).sum(axis=1)))
        self.norms = np.array(norms)  # parts x rows

    def bounds(self, anchors: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest score that each of the rows lo to hi can have with each anchor."""
        middle = np.zeros((len(anchors), hi - lo))
        sizes = np.empty((len(anchors), len(self.books)))
        for k, (part, book, code) in enumerate(zip(_parts(anchors.astype(np.float64)), self.books, self.codes)):
            middle += np.take(part @ book.T, code[lo:hi], axis=1)
            sizes[:, k] = np.sqrt((part**2).sum(axis=1))
        # A little wider than the sums in doubles can err.
        slack = (sizes @ self.norms[:, lo:hi]) * (1 + 1e-9) + np.abs(middle) * 1e-12 + 1e-3
        return middle - slack, middle + slack

    def scores(self, anchors: np.ndarray, a: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Exact scores of pairs of an anchor and a row."""
        out = np.empty(len(a), np.int64)
        for at in range(0, len(a), PAIRS):
            some = slice(at, at + PAIRS)
            out[some] = np.einsum("ij,ij->i", anchors[a[some]], self.vectors[r[some]])
        return out


def _sorted(score: np.ndarray, vec_id: np.ndarray, row_no: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order of each group, the groups one after another: higher scores first, then smaller vec_ids."""
    return np.lexsort((row_no, vec_id, -score, group))


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... as often as sizes[0] says, and so on."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, for small k; minus infinity where there are fewer. Works in ``values`` itself."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    rows = np.arange(len(values))
    for _ in range(k - 1):
        values[rows, values.argmax(axis=1)] = -np.inf
    return values.max(axis=1)


#: Stands for a null vec_id, behind all others.
NO_ID = np.iinfo(np.int64).max


def positives_in(part: Part, anchors: dict) -> dict:
    """For each anchor (group: its place) the part's best rows of its label."""
    found = []
    for label in np.unique(anchors["label"]):
        lo, hi = np.searchsorted(part.label, [label, label + 1])
        own = np.flatnonzero(anchors["label"] == label)
        if lo == hi:
            continue
        step = max(1, CELLS // (hi - lo))
        for at in range(0, len(own), step):
            some = own[at : at + step]
            least, most = part.bounds(anchors["v"][some], lo, hi)
            itself = anchors["row_no"][some][:, None] == part.row_no[None, lo:hi]
            least[itself] = most[itself] = -np.inf
            a, r = np.nonzero((most >= _kth(least, POSITIVES)[:, None]) & ~itself)
            a, r, score, begin = _scored(part, anchors, some, a, r + lo)
            which = _runs(begin[:-1], np.minimum(np.diff(begin), POSITIVES))
            found.append({"group": some[a[which]], "row": r[which], "score": score[which]})
    return _together(found)


def negatives_in(part: Part, anchors: dict) -> dict:
    """For each window (group; rows of an anchor's place, the lowest and the highest score) the part's best rows of other labels inside."""
    found, windows = [], anchors["windows"]
    step = max(1, CELLS // max(1, len(part.row_no)))
    first, last = (np.searchsorted(windows[:, 0], np.arange(len(anchors["row_no"])), side) for side in ("left", "right"))
    for at in range(0, len(anchors["row_no"]), step):
        some = np.arange(at, min(at + step, len(anchors["row_no"])))
        least, most = part.bounds(anchors["v"][some], 0, len(part.row_no))
        same = part.label[None, :] == anchors["label"][some][:, None]
        least[same] = most[same] = -np.inf
        nth = [np.flatnonzero(first[some] + n < last[some]) for n in range(int((last - first)[some].max()))]
        open_ones = np.zeros(least.shape, bool)
        for n, have in enumerate(nth):  # each anchor's n-th window
            low, high = (windows[first[some][have] + n, k][:, None] for k in (1, 2))
            under, over = least[have], most[have]
            surely = np.where((under >= low) & (over <= high), under, -np.inf)
            open_ones[have] |= (over >= np.maximum(low, _kth(surely, NEGATIVES)[:, None])) & (under <= high)
        a, r = np.nonzero(open_ones & ~same)
        a, r, score, begin = _scored(part, anchors, some, a, r)
        for n, have in enumerate(nth):
            w = first[some][have] + n
            low, high = (np.full(len(some), bound) for bound in (1, 0))
            low[have], high[have] = windows[w, 1], windows[w, 2]
            # Scores fall within an anchor's run, so those inside its window stand together.
            above, inside = (np.bincount(a[x], minlength=len(some)) for x in (score > high[a], (score <= high[a]) & (score >= low[a])))
            taken = np.minimum(inside, NEGATIVES)[have]
            which = _runs((begin[:-1] + above)[have], taken)
            found.append({"group": np.repeat(w, taken), "row": r[which], "score": score[which]})
    return _together(found)


def _scored(part: Part, anchors: dict, some: np.ndarray, a: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs in each anchor's order with their exact scores, and where each anchor's begin."""
    score = part.scores(anchors["v"][some], a, r)
    order = _sorted(score, part.vec_id[r], part.row_no[r], a)
    return a[order], r[order], score[order], np.searchsorted(a[order], np.arange(len(some) + 1))


def _together(found: list[dict]) -> dict:
    return {k: np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in ("group", "row", "score")}


def window(score: int) -> tuple[int, int]:
    """The lowest and the highest score that a negative of a positive may have."""
    return -(-LOW * score // 100), HIGH * score // 100


def _matrix(column, width: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(lists.offsets.to_numpy())
    if (sizes == width).all():
        return values.astype(np.int64).reshape(-1, width)
    out = np.zeros((len(lists), width), np.int64)
    rows = np.repeat(np.arange(len(lists)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _searched(shared, width: int, negatives: bool):
    """Streams parts: the rows of a part, then the anchors that ask it."""

    def run(batches):
        books = shared.value
        number, held, part = None, [], None
        for batch in batches:
            kinds, numbers = batch.column("asks").to_numpy(zero_copy_only=False), batch.column("part").to_numpy()
            cuts = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(kinds.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(numbers)]):
                if lo == hi:
                    continue
                some = pa.Table.from_batches([batch.slice(lo, hi - lo)])
                if numbers[lo] != number:
                    number, held, part = numbers[lo], [], None
                if not kinds[lo]:
                    held.append(some)
                    continue
                if not held and part is None:
                    continue
                if part is None:
                    rows = pa.concat_tables(held)
                    held = []
                    part = Part(books, *(_numbers(rows, c) for c in ("row_no", "vec_id", "label")), _matrix(rows.column("v"), width))
                yield _answers(part, some, width, negatives)

    return run


def _numbers(rows, column: str) -> np.ndarray:
    return rows.column(column).combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _answers(part: Part, some, width: int, negatives: bool):
    anchors = {c: _numbers(some, c) for c in ("row_no", "label")} | {"v": _matrix(some.column("v"), width)}
    if negatives:
        lists = some.column("scores").to_pylist()
        anchors["windows"] = np.array([(i, *window(s)) for i, own in enumerate(lists) for s in own], np.int64).reshape(-1, 3)
        nth = np.array([n for own in lists for n in range(len(own))], np.int64)
        got = negatives_in(part, anchors)
        asked, place = anchors["windows"][got["group"], 0], nth[got["group"]]
    else:
        got = positives_in(part, anchors)
        asked, place = got["group"], np.zeros(len(got["group"]), np.int64)
    ids = part.vec_id[got["row"]]
    columns = [pa.array(anchors["row_no"][asked]), pa.array(place, pa.int32()), pa.array(part.row_no[got["row"]]), pa.array(ids, mask=ids == NO_ID), pa.array(got["score"])]
    return pa.RecordBatch.from_arrays(columns, ["anchor_no", "nth", "row_no", "vec_id", "score"])


def _search(rows: DataFrame, anchors: DataFrame, parts: int, books, width: int, negatives: bool) -> DataFrame:
    """(anchor_no, nth, row_no, vec_id, score): what each part has for each anchor; staged."""
    spark = rows.sparkSession
    own = F.pmod(F.xxhash64("row_no"), F.lit(parts)).cast("int").alias("part")
    scores = F.col("scores") if negatives else F.array().cast("array<bigint>")
    held = rows.select(own, F.lit(False).alias("asks"), "row_no", "vec_id", "label", "v", F.array().cast("array<bigint>").alias("scores"))
    asking = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(True).alias("asks"), "row_no", "vec_id", "label", "v", scores.alias("scores"))
    dealt = held.unionByName(asking).repartition(parts, "part").sortWithinPartitions("part", "asks")
    return common.mapped(dealt, _searched(spark.sparkContext.broadcast(books), width, negatives), "anchor_no bigint, nth int, row_no bigint, vec_id bigint, score bigint", "answers", batch_rows=2000)


def _ranked(answers: DataFrame, most: int) -> DataFrame:
    by = Window.partitionBy("anchor_no", "nth").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row_no")
    return answers.withColumn("place", F.row_number().over(by)).where(F.col("place") <= most)


def mine(vectors: DataFrame, vector: str = "embedding", part_rows: int = PART_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; staged."""
    spark = vectors.sparkSession
    with common.scratch() as keep:
        rows = prepared(vectors, vector)
        size = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        n, width, largest = rows.agg(F.count("*"), F.max(F.size("v")), F.max(size)).first()
        if largest is not None and largest >= 2.0**60:
            raise ValueError("scores of these vectors don't fit into 64 bits")
        width = max(1, width or 0)
        parts = max(PARTS_A_CORE * spark.sparkContext.defaultParallelism, math.ceil(n / part_rows))
        books = fit(rows, width, n)  # CENTROIDS x width numbers
        anchors = common.staged(rows.where(F.coalesce(F.col("vec_id") % ANCHORS == 0, F.lit(False))), "anchors")
        best = common.staged(_ranked(_search(rows, anchors, parts, books, width, False), POSITIVES), "positives")
        # POSITIVES of them at most for each anchor.
        lists = best.groupBy(F.col("anchor_no").alias("row_no")).agg(F.sort_array(F.collect_list(F.struct("place", "score", "vec_id"))).alias("best"))
        asking = anchors.join(lists, "row_no").withColumn("scores", F.col("best.score"))
        asking = common.staged(asking, "asking")
        found = _ranked(_search(rows, asking, parts, books, width, True), NEGATIVES)
        out = found.withColumnsRenamed({"row_no": "negative_no", "vec_id": "negative_id", "score": "negative_score"})
        positive = F.element_at("best", F.col("nth") + 1)
        out = out.join(asking.select(F.col("row_no").alias("anchor_no"), F.col("vec_id").alias("anchor_id"), "best"), "anchor_no")
        return keep(out.select("anchor_id", positive["vec_id"].alias("positive_id"), F.col("place").cast("int").alias("rank"), "negative_id", positive["score"].alias("positive_score"), "negative_score"), "hard_negatives")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.ship(spark)
    return mine(common.table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.r <> b.r
), p AS (
  SELECT a, anchor_id, b, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST, b) <= 5
), n AS (
  SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.vec_id NULLS LAST, s.b) AS rank
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
