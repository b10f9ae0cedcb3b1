"""Normalisation of strings before they are compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.errors import ValidationError

#: The modes, and the 32 ASCII punctuation characters.
MODES = ("lowercase", "unicode_nfkd", "nfkd", "remove_punctuation", "remove_whitespace", "strict")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPACES = r"(?U)\s+"


def unicode_form(form: str):
    from kindred.functions.vectorised import text_udf

    import unicodedata

    return text_udf(lambda s: unicodedata.normalize(form, s), "string")


def normalize_string(s: Column, mode: str) -> Column:
    """lowercase, unicode_nfkd (or nfkd), remove_punctuation (ASCII), remove_whitespace (Unicode), or strict: NFKD, lower case, then without both."""
    if mode not in MODES:
        raise ValidationError(f"unknown normalisation {mode!r}; there are {', '.join(MODES)}")
    if mode == "lowercase":
        return F.lower(s)
    if mode in ("unicode_nfkd", "nfkd"):
        return F.when(ascii_only(s), s).otherwise(unicode_form("NFKD")(s))
    if mode == "remove_punctuation":
        return F.translate(s, PUNCTUATION, "")
    if mode == "remove_whitespace":
        return F.regexp_replace(s, SPACES, "")
    return normalize_string(normalize_string(F.lower(normalize_string(s, "nfkd")), "remove_punctuation"), "remove_whitespace")


def normalize_pair(a: Column, b: Column, mode: str | None) -> tuple[Column, Column]:
    return (a, b) if mode is None else (normalize_string(a, mode), normalize_string(b, mode))


def ascii_only(s: Column) -> Column:
    return F.octet_length(s) == F.length(s)


def nfc(s: Column) -> Column:
    """ASCII is NFC already, so only other strings go to Python."""
    return F.when(ascii_only(s), s).otherwise(unicode_form("NFC")(s))


def words(s: Column) -> Column:
    """Split at Unicode white space, without empty words."""
    return F.filter(F.split(s, SPACES), lambda w: w != "")
