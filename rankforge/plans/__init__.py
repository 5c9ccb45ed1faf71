"""Registered queries; importing the modules fills the registry."""

from rankforge.plans.registry import ORACLE, QUERIES
from rankforge.plans import (  # noqa: F401
    chunks,
    dense_search,
    diagnosing,
    experiments,
    files,
    incremental,
    judging,
    lexical_search,
    parsing,
    records,
    statistics,
)
