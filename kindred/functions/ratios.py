"""Fuzzy ratios: over whole strings, windows of them, and their words. Nulls give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions.edit import levenshtein_similarity
from kindred.functions.normalize import nfc, normalize_pair, words


def ratio(a: Column, b: Column, normalize: str | None = None) -> Column:
    return levenshtein_similarity(a, b, normalize)


def partial_ratio(a: Column, b: Column, normalize: str | None = None) -> Column:
    """The best similarity of the shorter string and a stretch of the longer one that is as long."""
    a, b = normalize_pair(a, b, normalize)
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    n, m = F.length(short), F.length(long)
    best = F.array_max(F.transform(F.sequence(F.lit(1), m - n + 1), lambda i: 1.0 - F.levenshtein(short, F.substring(long, i, n)) / n))
    return F.when((n == 0) & (m == 0), F.lit(1.0)).when(n == 0, F.lit(0.0)).when(F.contains(long, short), F.lit(1.0)).otherwise(best)


def token_sort_ratio(a: Column, b: Column, normalize: str | None = None) -> Column:
    """Words in order of their bytes, case and all."""
    a, b = normalize_pair(a, b, normalize)
    in_order = lambda s: F.array_join(F.array_sort(words(s)), " ")
    return levenshtein_similarity(in_order(a), in_order(b))


def token_set_ratio(a: Column, b: Column, normalize: str | None = None) -> Column:
    """Over lower-cased distinct words: what both share against what each has besides.

    What is shared comes first and is followed by a space even if it's empty; words are in order.
    """
    a, b = normalize_pair(a, b, normalize)
    sets = [F.array_sort(F.array_distinct(words(F.lower(s)))) for s in (a, b)]
    x, y = sets
    joined = lambda w: F.array_join(F.array_sort(w), " ")
    both, left, right = joined(F.array_intersect(x, y)), joined(F.array_except(x, y)), joined(F.array_except(y, x))
    with_left = F.when(left == "", both).otherwise(F.concat(both, F.lit(" "), left))
    with_right = F.when(right == "", both).otherwise(F.concat(both, F.lit(" "), right))
    some = F.greatest(levenshtein_similarity(both, with_left), levenshtein_similarity(both, with_right), levenshtein_similarity(with_left, with_right), levenshtein_similarity(joined(x), joined(y)))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), F.lit(1.0)).when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).when(a.isNotNull() & b.isNotNull(), some)


def wratio(a: Column, b: Column, partial_weight: float = 0.9, token_weight: float = 0.95, normalize: str | None = None) -> Column:
    """The best of the weighed ratios; a part counts less where lengths differ more."""
    a, b = normalize_pair(a, b, normalize)
    n, m = F.length(a).cast("double"), F.length(b).cast("double")
    ratio_ = F.greatest(n, m) / F.greatest(F.lit(1.0), F.least(n, m))
    # fixed values: how much a part counts at which ratio of lengths
    penalty = F.when(ratio_ > 8.0, F.lit(0.67)).when(ratio_ > 1.5, F.lit(1.0)).otherwise(F.lit(1.056))
    weight = F.least(F.lit(1.0), F.lit(float(partial_weight)) * penalty)
    best = F.greatest(ratio(a, b), partial_ratio(a, b) * weight, token_sort_ratio(a, b) * float(token_weight), token_set_ratio(a, b) * float(token_weight))
    return F.when((a == "") & (b == ""), F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).when(a.isNotNull() & b.isNotNull(), best)


def over_nfc(a: Column, b: Column, rule) -> Column:
    """``rule`` of the NFC forms, which are worked out once, outside of the functions inside ``rule``."""
    pair = F.array(F.struct(nfc(a).alias("a"), nfc(b).alias("b")))
    return F.element_at(F.transform(pair, lambda p: rule(p["a"], p["b"])), 1)


def qratio(a: Column, b: Column, normalize: str | None = None) -> Column:
    """``ratio`` of the NFC forms."""
    return over_nfc(*normalize_pair(a, b, normalize), ratio)


def qwratio(a: Column, b: Column, partial_weight: float = 0.9, token_weight: float = 0.95) -> Column:
    return over_nfc(a, b, lambda x, y: wratio(x, y, partial_weight, token_weight))
