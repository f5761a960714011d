"""One query for each operator over the given tables, and its twin in DuckDB SQL where SQL can express it."""

from parlance.queries import core, discovery, search, sources, state, upkeep  # noqa: F401  they register themselves
from parlance.queries.base import ORACLES, QUERIES  # noqa: F401
from parlance.queries.search import hybrid_search  # noqa: F401
