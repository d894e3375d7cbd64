"""All registered queries of the crawl, with their SQL."""

from skein.operators import maze_queries, robots_queries, rule_queries, stream_queries  # noqa: F401
from skein.operators.queries import QUERIES, SQL  # noqa: F401
