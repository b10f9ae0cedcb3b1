"""The Jaro family, in Arrow batches. Nulls give null."""

from __future__ import annotations

from pyspark.sql import Column

from kindred.errors import check_distance, check_prefix_weight
from kindred.functions import batches, kernels
from kindred.functions.batches import over
from kindred.functions.normalize import normalize_pair
from kindred.functions.vectorised import pair_udf


def jaro_similarity(a: Column, b: Column, normalize: str | None = None) -> Column:
    return pair_udf(over(batches.jaro, kernels.jaro), "double")(*normalize_pair(a, b, normalize))


def jaro_distance(a: Column, b: Column) -> Column:
    return 1 - jaro_similarity(a, b)


def jaro_winkler_similarity(a: Column, b: Column, prefix_weight: float = 0.1, max_prefix_length: int = 4, normalize: str | None = None) -> Column:
    """The prefix counts at any Jaro similarity, low ones too."""
    w, n = check_prefix_weight(prefix_weight), check_distance(max_prefix_length, "max_prefix_length")
    return pair_udf(over(lambda *x: batches.jaro_winkler(*x, w, n), lambda x, y: kernels.jaro_winkler(x, y, w, n)), "double")(*normalize_pair(a, b, normalize))


similarity = jaro_winkler_similarity


def jaro_winkler_distance(a: Column, b: Column) -> Column:
    return 1 - jaro_winkler_similarity(a, b)


def jaro_similarity_grapheme(a: Column, b: Column) -> Column:
    """Over grapheme clusters, where an odd number of transposed ones counts a half."""
    return pair_udf(over(lambda *x: batches.jaro(*x, False), lambda x, y: kernels.jaro(x, y, False), True), "double")(a, b)


def jaro_winkler_similarity_grapheme(a: Column, b: Column, prefix_weight: float = 0.1, max_prefix_length: int = 4) -> Column:
    w, n = check_prefix_weight(prefix_weight), check_distance(max_prefix_length, "max_prefix_length")
    return pair_udf(over(lambda *x: batches.jaro_winkler(*x, w, n, False), lambda x, y: kernels.jaro_winkler(x, y, w, n, False), True), "double")(a, b)
