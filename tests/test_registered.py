import os

import pytest
from test_queries import SF, oracle, rows

from skein.operators.registered import QUERIES, SQL
from skein.sources import staging


@pytest.mark.parametrize("name", ["q_bfs_depth_limit", "q_odd_links", "q_robots_by_origin", "q_stream_first_seen"])
def test_a_query_as_registered_leaves_its_result_alone(spark, name):
    """One query of each module runs as the driver runs it; of what it staged only its result stays."""
    folder = staging.shared_dir(spark)
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    got = QUERIES[name](spark, SF)
    assert [x.split("-")[0] for x in set(os.listdir(folder)) - before] == [name]
    assert rows(got.toPandas()) == rows(oracle(SQL[name]))
