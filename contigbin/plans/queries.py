"""All registered queries of the operators, with their SQL oracles."""

from __future__ import annotations

from . import feature_queries, graph_queries, label_queries, neighbour_queries, partition_queries, source_queries  # noqa: F401  (they register)
from .feature_queries import ORACLES, QUERIES  # noqa: F401
from .neighbour_queries import flagship  # noqa: F401
