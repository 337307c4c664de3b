"""The queries of the evidence engine by name, and their SQL."""

from . import assembly, catalog, evidence, identity, imports, intervals, layers, nearest, parsing, phrases, projections, rules, scoring, search, signals, spots, stats, streams, trust
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "assembly", "catalog", "evidence", "identity", "imports", "intervals", "layers", "nearest", "parsing", "phrases", "projections", "rules", "scoring", "search", "signals", "spots", "stats", "streams", "trust"]
