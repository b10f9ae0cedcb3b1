"""Edit distances and similarities as column expressions.

Levenshtein and Hamming stay inside the JVM; the Damerau family runs in Arrow batches. Nulls give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.errors import check_distance
from kindred.functions import batches, kernels
from kindred.functions.batches import over
from kindred.functions.normalize import normalize_pair
from kindred.functions.vectorised import pair_udf

#: Stand-ins for grapheme clusters: one character for each distinct cluster of a pair, up to this many.
STAND_INS = "".join(map(chr, range(0x4E00, 0x4E00 + 20_000)))


def per_length(distance: Column, a: Column, b: Column, length=F.length) -> Column:
    """1 - distance / length of the longer side; 1 if both are empty."""
    longest = F.greatest(length(a), length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - distance / longest)


def levenshtein(a: Column, b: Column, max_distance: int | None = None, normalize: str | None = None) -> Column:
    """Over ``max_distance`` the result is ``max_distance + 1``."""
    a, b = normalize_pair(a, b, normalize)
    if max_distance is None:
        return F.levenshtein(a, b)
    k = check_distance(max_distance)
    d = F.levenshtein(a, b, k)
    return F.when(d == -1, F.lit(k + 1)).otherwise(d)


edit_distance = levenshtein


def levenshtein_bounded(a: Column, b: Column, max_distance: int, normalize: str | None = None) -> Column:
    """Null over ``max_distance``."""
    a, b = normalize_pair(a, b, normalize)
    return F.nullif(F.levenshtein(a, b, check_distance(max_distance)), F.lit(-1))


def levenshtein_similarity(a: Column, b: Column, normalize: str | None = None) -> Column:
    a, b = normalize_pair(a, b, normalize)
    return per_length(F.levenshtein(a, b), a, b)


def as_bytes(s: Column) -> Column:
    """A character for each UTF-8 byte."""
    return F.decode(F.encode(s, "UTF-8"), "ISO-8859-1")


def levenshtein_bytes(a: Column, b: Column, max_distance: int | None = None) -> Column:
    return levenshtein(as_bytes(a), as_bytes(b), max_distance)


def levenshtein_bytes_bounded(a: Column, b: Column, max_distance: int) -> Column:
    return levenshtein_bounded(as_bytes(a), as_bytes(b), max_distance)


def levenshtein_bytes_similarity(a: Column, b: Column) -> Column:
    """Byte distance over the number of characters, kept in [0, 1]."""
    s = per_length(levenshtein_bytes(a, b), a, b)
    return F.when(s < 0, F.lit(0.0)).otherwise(s)


def clusters(s: Column) -> Column:
    """Extended grapheme clusters."""
    return F.regexp_extract_all(s, F.lit(r"\X"), F.lit(0))


def stood_in(a: Column, b: Column) -> tuple[Column, Column]:
    known = F.array_union(clusters(a), clusters(b))
    one = lambda s: F.array_join(F.transform(clusters(s), lambda g: F.substring(F.lit(STAND_INS), F.array_position(known, g).cast("int"), F.lit(1))), "")
    return one(a), one(b)


def levenshtein_grapheme(a: Column, b: Column) -> Column:
    x, y = stood_in(a, b)
    return F.levenshtein(x, y)


def levenshtein_similarity_grapheme(a: Column, b: Column) -> Column:
    return per_length(levenshtein_grapheme(a, b), a, b, lambda s: F.size(clusters(s)))


def capped(d: Column, most: int | None) -> Column:
    """``most + 1`` for what is over ``most``; null stays null."""
    return d if most is None else F.when(d > check_distance(most), F.lit(most + 1)).otherwise(d)


def damerau_levenshtein(a: Column, b: Column, max_distance: int | None = None, normalize: str | None = None) -> Column:
    """Unrestricted; over ``max_distance`` the result is ``max_distance + 1``."""
    a, b = normalize_pair(a, b, normalize)
    return capped(pair_udf(over(batches.damerau, kernels.damerau), "int")(a, b), max_distance)


def damerau_levenshtein_checked(a: Column, b: Column) -> Column:
    """``damerau_levenshtein``, but an error where a side is longer than the unrestricted distance is computed for."""
    long = (F.length(a) > kernels.LONG) | (F.length(b) > kernels.LONG)
    error = F.raise_error(F.lit(f"damerau_levenshtein_checked takes up to {kernels.LONG} characters")).cast("int")
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.length(a) + F.length(b)).when(long, error).otherwise(damerau_levenshtein(a, b))


def damerau_levenshtein_bounded(a: Column, b: Column, max_distance: int, normalize: str | None = None) -> Column:
    d = damerau_levenshtein(a, b, None, normalize)
    return F.when(d <= check_distance(max_distance), d)


def damerau_levenshtein_similarity(a: Column, b: Column, normalize: str | None = None) -> Column:
    a, b = normalize_pair(a, b, normalize)
    return per_length(damerau_levenshtein(a, b), a, b)


def optimal_string_alignment(a: Column, b: Column, max_distance: int | None = None, normalize: str | None = None) -> Column:
    a, b = normalize_pair(a, b, normalize)
    return capped(pair_udf(over(batches.osa, kernels.osa), "int")(a, b), max_distance)


def optimal_string_alignment_similarity(a: Column, b: Column, normalize: str | None = None) -> Column:
    a, b = normalize_pair(a, b, normalize)
    return per_length(optimal_string_alignment(a, b), a, b)


def differing(a: Column, b: Column) -> Column:
    """Places at which two strings differ; those that only the longer has count."""
    letters = lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ""))
    pairs = F.zip_with(letters(a), letters(b), lambda x, y: (~x.eqNullSafe(y)).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda n, x: n + x)


def hamming(a: Column, b: Column, strict: bool = False) -> Column:
    """Null where lengths differ; an error there if ``strict``."""
    other = F.raise_error(F.lit("hamming takes strings of equal length")).cast("int") if strict else F.lit(None).cast("int")
    return F.when(F.length(a) == F.length(b), differing(a, b)).when(a.isNotNull() & b.isNotNull(), other)


def hamming_distance_padded(a: Column, b: Column) -> Column:
    return differing(a, b)


def hamming_similarity(a: Column, b: Column) -> Column:
    """0 where lengths differ."""
    return F.when(F.length(a) == F.length(b), per_length(differing(a, b), a, b)).when(a.isNotNull() & b.isNotNull(), F.lit(0.0))
