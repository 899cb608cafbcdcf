"""Table operators: projections, joins, aggregations, windows, set operations."""

from . import agg, joins, project, ranking, setops, windows  # noqa: F401
