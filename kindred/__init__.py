"""Approximate string matching and record linkage on Spark DataFrames."""

from kindred.functions.namespace import fuzzy
from kindred.functions.registry import Algorithm
from kindred.operators.dedupe import dedupe, dedupe_snm, find_pairs, match_pairs
from kindred.operators.index import EditIndex, FuzzyIndex, HybridIndex, NgramIndex
from kindred.operators.join import fuzzy_join, match_records
from kindred.operators.schema import MatchSchema, SchemaIndex

__all__ = ["Algorithm", "EditIndex", "FuzzyIndex", "HybridIndex", "MatchSchema", "NgramIndex", "SchemaIndex", "dedupe", "dedupe_snm", "find_pairs", "fuzzy", "fuzzy_join", "match_pairs", "match_records"]
