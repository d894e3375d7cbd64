import glob
import math
import os

import duckdb
import pytest

from skein.operators import maze_queries, queries
from skein.operators.registered import QUERIES, SQL
from skein.sources import staging

SF = "/root/testdata/sf0.001"

def rows(frame):
    frame = frame[sorted(frame.columns)]
    show = lambda v: "null" if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) == "<NA>" else f"{v:.9g}" if isinstance(v, float) else str(v)
    return list(frame.columns), sorted(tuple(map(show, r)) for r in frame.itertuples(index=False))


def oracle(sql, sf=SF):
    db = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return db.execute(sql).df()


@pytest.fixture(scope="module", autouse=True)
def crawls():
    """Queries over one and the same crawl share it here; each still reads its own result from it."""
    kept, patch = {}, pytest.MonkeyPatch()

    def sharing(crawled):
        def run(spark, sf_dir, *args, **config):
            if "robots" in config or "clock" in config:
                return crawled(spark, sf_dir, *args, **config)
            key = crawled.__module__, sf_dir, args, tuple(sorted(config.items()))
            if key not in kept:
                # A query deletes what it staged; a shared crawl must outlive it.
                scratches, staging._SCRATCH[:] = staging._SCRATCH[:], []
                try:
                    kept[key] = crawled(spark, sf_dir, *args, **config)
                finally:
                    staging._SCRATCH[:] = scratches
            return kept[key]

        return run

    for module in (queries, maze_queries):
        patch.setattr(module, "_crawled", sharing(module._crawled))
    yield
    patch.undo()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(oracle(SQL[name]))
