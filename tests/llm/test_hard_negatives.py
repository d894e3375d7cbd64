import math

import duckdb
import numpy as np
import pytest

from skein.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, embedding array<float>, label int, v string, part int, asks string"


def plainly(rows):
    """What the contract says, by every pair."""
    taken = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        taken.append((vec_id, [math.floor(256 * float(x)) for x in vector], label))
    key = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for i, (a, v, label) in enumerate(taken):
        if a is None or a % 50:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), b, other == label) for j, (b, w, other) in enumerate(taken) if j != i]
        for score, b, _ in sorted((s for s in scored if s[2]), key=key)[:5]:
            inside = sorted((s for s in scored if not s[2] and 50 * score <= 100 * s[0] <= 95 * score), key=key)[:3]
            out += [(a, b, n + 1, s[1], score, s[0]) for n, s in enumerate(inside)]
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 5, "x") for r in rows], SCHEMA)


def floats(matrix):
    return [[float(x) for x in row] for row in np.asarray(matrix, np.float32)]


def test_against_brute_force(spark):
    r = np.random.default_rng(4)
    labels = r.integers(0, 4, 600)
    vectors = floats(r.normal(size=(4, 20))[labels] * 0.4 + r.normal(size=(600, 20)) * 0.3)
    rows = [(i * 5, v, int(x)) for i, (v, x) in enumerate(zip(vectors, labels))]
    want = plainly(rows)
    assert len(want) > 200
    assert sorted(map(tuple, hn.mine(table(spark, rows)).collect()), key=str) == want
    assert sorted(map(tuple, hn.mine(table(spark, rows), part_rows=9).collect()), key=str) == want


def test_odd_rows(spark):
    one = [1.0, 0.5, -0.25]
    rows = [(0, one, 1), (50, one, 1), (50, one, 1), (100, None, 1), (150, one, None), (200, [1.0, None, 2.0], 1), (250, [float("nan"), 1.0, 1.0], 1), (300, [float("inf"), 1.0, 1.0], 1),
            (350, [0.9, 0.5], 9), (400, [], 2), (None, [0.8, 0.5, 0.0], 3), (None, one, 1), (3, [0.7, 0.4, 0.1], 2), (3, [0.7, 0.4, 0.1], 2), (4, [0.6, 0.6, 0.6, 0.9], 2), (9, [-1.0, 0.0, 0.0], 1), (8, [0.0, 0.0, 0.0], 1)]
    rows += [(1000 + i, [0.7, 0.3, 0.0], 5) for i in range(40)] + [(2000 + i, one, 1) for i in range(40)]  # ties
    got = sorted(map(tuple, hn.mine(table(spark, rows)).collect()), key=str)
    assert got == plainly(rows) and got
    assert hn.mine(table(spark, rows).limit(0)).count() == 0
    assert hn.mine(table(spark, [(50, one, 1)])).count() == 0
    with pytest.raises(ValueError, match="64 bits"):
        hn.mine(table(spark, [(50, [3e38], 1)]))


def test_bounds_hold_for_every_pair():
    r = np.random.default_rng(7)
    vectors, anchors = r.integers(-900, 900, (500, 19)), r.integers(-900, 900, (30, 19))
    books = [np.rint(r.normal(size=(5, p.shape[1])) * 500) for p in hn._parts(vectors)]
    part = hn.Part(books, np.arange(500), np.arange(500), r.integers(0, 3, 500), vectors)
    least, most = part.bounds(anchors, 0, 500)
    exact = anchors @ part.vectors.T
    assert (least <= exact).all() and (exact <= most).all()


def test_centroids_and_blocks_change_nothing(spark, monkeypatch):
    rows = [(i * 10, v, i % 3) for i, v in enumerate(floats(np.random.default_rng(9).normal(size=(200, 11)) + 0.5))]
    want = plainly(rows)
    monkeypatch.setattr(hn, "CENTROIDS", 1)
    monkeypatch.setattr(hn, "CELLS", 50)
    assert sorted(map(tuple, hn.mine(table(spark, rows)).collect()), key=str) == want


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(db.execute(hn.SQL).fetchall(), key=str)
    assert sorted(map(tuple, hn.query(spark, sf).collect()), key=str) == want and want
