"""Queries over the given tables, one or more per operator, with SQL twins where SQL can say the same."""

from . import (  # noqa: F401
    charts,
    columns,
    evaluation,
    features,
    joins,
    models,
    profiling,
    rows,
    selection,
    sources,
    splits,
    streams,
)
from .catalog import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
