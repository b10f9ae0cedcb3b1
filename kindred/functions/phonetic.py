"""Phonetic codes and their comparison. Soundex stays inside the JVM. Nulls give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.errors import check_positive
from kindred.functions import sounds
from kindred.functions.vectorised import frame_udf, text_udf


def soundex(s: Column) -> Column:
    """Over A-Z only; empty if there are none."""
    return F.soundex(F.regexp_replace(F.upper(F.trim(s)), "[^A-Z]", ""))


def soundex_match(a: Column, b: Column) -> Column:
    return soundex(a) == soundex(b)


def soundex_similarity(a: Column, b: Column) -> Column:
    """The share of the four places at which the codes agree."""
    x, y = soundex(a), soundex(b)
    same = sum(((F.substring(x, k, 1) == F.substring(y, k, 1)).cast("int") for k in range(2, 5)), (F.substring(x, 1, 1) == F.substring(y, 1, 1)).cast("int"))
    return F.when(x == y, F.lit(1.0)).when((x == "") | (y == ""), F.lit(0.0)).otherwise(same / 4)


def metaphone(s: Column, max_length: int = 4) -> Column:
    n = check_positive(max_length, "max_length")
    return text_udf(lambda x: sounds.metaphone(x, n), "string")(s)


def metaphone_match(a: Column, b: Column, max_length: int = 4) -> Column:
    return metaphone(a, max_length) == metaphone(b, max_length)


def metaphone_similarity(a: Column, b: Column, max_length: int = 4) -> Column:
    n = check_positive(max_length, "max_length")
    return text_udf(lambda x, y: sounds.metaphone_similarity(x, y, n), "double")(a, b)


def double_metaphone(s: Column, max_length: int = 4) -> Column:
    """struct<primary, alternate>; the alternate is empty if it's the same."""
    n = check_positive(max_length, "max_length")
    return frame_udf(lambda x: dict(zip(("primary", "alternate"), sounds.double_metaphone(x, n))), "struct<primary:string,alternate:string>")(s)


def double_metaphone_match(a: Column, b: Column) -> Column:
    return text_udf(sounds.double_metaphone_match, "boolean")(a, b)


def double_metaphone_similarity(a: Column, b: Column, max_length: int = 4) -> Column:
    n = check_positive(max_length, "max_length")
    return text_udf(lambda x, y: sounds.double_metaphone_similarity(x, y, n), "double")(a, b)
