"""Algorithms by name: what turns two string columns into a similarity."""

from __future__ import annotations

from collections.abc import Callable
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.errors import AlgorithmError
from kindred.functions import edit, jaro, ngrams

Scorer = Callable[[Column, Column], Column]


class Algorithm(str, Enum):
    """Names that are accepted wherever an algorithm is asked for; so are their values and the aliases below."""

    LEVENSHTEIN = "levenshtein"
    DAMERAU_LEVENSHTEIN = "damerau_levenshtein"
    OSA = "osa"
    JARO = "jaro"
    JARO_WINKLER = "jaro_winkler"
    NGRAM = "ngram"
    BIGRAM = "bigram"
    TRIGRAM = "trigram"
    JACCARD = "jaccard"
    COSINE = "cosine"
    LCS = "lcs"
    HAMMING = "hamming"
    EXACT_MATCH = "exact_match"


ALIASES = {"damerau": "damerau_levenshtein", "cosine_chars": "cosine", "exact": "exact_match"}


def resolve(algorithm: str | Algorithm) -> str:
    if isinstance(algorithm, Algorithm):
        return algorithm.value
    if not isinstance(algorithm, str):
        raise AlgorithmError(f"an algorithm is a name or an Algorithm, not {algorithm!r}")
    name = ALIASES.get(algorithm.lower(), algorithm.lower())
    if name not in {a.value for a in Algorithm}:
        raise AlgorithmError(f"unknown algorithm {algorithm!r}; there are {', '.join(a.value for a in Algorithm)}")
    return name


def scorer(algorithm: str | Algorithm | Scorer, ngram_size: int = 3) -> Scorer:
    """The similarity function of a name; a callable is taken as it is."""
    if callable(algorithm) and not isinstance(algorithm, (str, Algorithm)):
        return algorithm
    return {
        "levenshtein": edit.levenshtein_similarity,
        "damerau_levenshtein": edit.damerau_levenshtein_similarity,
        "osa": edit.optimal_string_alignment_similarity,
        "jaro": jaro.jaro_similarity,
        "jaro_winkler": jaro.jaro_winkler_similarity,
        "ngram": lambda a, b: ngrams.ngram_similarity(a, b, ngram_size),
        "bigram": ngrams.bigram_similarity,
        "trigram": ngrams.trigram_similarity,
        "jaccard": lambda a, b: ngrams.ngram_jaccard(a, b, ngram_size),
        "cosine": ngrams.cosine_similarity_chars,
        "lcs": ngrams.lcs_similarity,
        "hamming": edit.hamming_similarity,
        "exact_match": lambda a, b: (a == b).cast("double"),
    }[resolve(algorithm)]


def lengths_allow(algorithm: str | Algorithm | Scorer, least: float, a: Column, b: Column) -> Column | None:
    """A cheap condition that every pair with a similarity of ``least`` meets, from lengths alone; None if there is none."""
    if callable(algorithm) and not isinstance(algorithm, (str, Algorithm)):
        return None
    name, n, m = resolve(algorithm), F.length(a), F.length(b)
    short, long = F.least(n, m), F.greatest(n, m)
    slack = 1e-9
    if name in ("levenshtein", "damerau_levenshtein", "osa"):
        return long - short <= (1 - least) * long + slack
    if name == "lcs":
        return (long == 0) | (2.0 * short >= least * (short + long) - slack)
    if name in ("hamming", "exact_match"):
        return F.lit(True) if least <= 0 else n == m
    if name in ("jaro", "jaro_winkler"):
        # at best all of the shorter string is matched in order; the prefix then adds up to 0.4 of what is missing
        jaro_ = (1.0 + short / F.greatest(long, F.lit(1)) + 1.0) / 3.0
        best = jaro_ if name == "jaro" else jaro_ + 0.4 * (1.0 - jaro_)
        return (long == 0) | (best >= least - slack)
    return None
