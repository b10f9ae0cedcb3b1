"""``fuzzy(column)``: the column functions as methods of a column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.errors import AlgorithmError, check_similarity
from kindred.functions import edit, ngrams, phonetic
from kindred.functions.normalize import normalize_string
from kindred.functions.registry import lengths_allow, resolve, scorer


def as_column(x: Column | str) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


class Fuzzy:
    def __init__(self, column: Column | str):
        self.column = column if isinstance(column, Column) else F.col(column)

    def sides(self, other: Column | str, case_insensitive: bool) -> tuple[Column, Column]:
        a, b = self.column, as_column(other)
        return (F.lower(a), F.lower(b)) if case_insensitive else (a, b)

    def similarity(self, other: Column | str, algorithm: str = "jaro_winkler", ngram_size: int = 3, case_insensitive: bool = False) -> Column:
        """0 to 1; a string is a literal, a Column another column. Null if either side is."""
        return scorer(algorithm, ngram_size)(*self.sides(other, case_insensitive))

    def is_similar(self, other: Column | str, min_similarity: float = 0.8, algorithm: str = "jaro_winkler", ngram_size: int = 3, case_insensitive: bool = False) -> Column:
        t, (a, b) = check_similarity(min_similarity), self.sides(other, case_insensitive)
        full, cheap = scorer(algorithm, ngram_size)(a, b) >= t, lengths_allow(algorithm, t, a, b)
        return full if cheap is None else F.when(cheap, full).when(a.isNotNull() & b.isNotNull(), F.lit(False))

    def best_match_score(self, choices: Sequence[str], algorithm: str = "jaro_winkler", min_similarity: float = 0.0, ngram_size: int = 3, case_insensitive: bool = False) -> Column:
        """struct<match, score> of the first best choice; null if none reaches ``min_similarity``. Every choice is scored.

        Choices are an argument and so as many as a plan can hold; join a table of them with ``match_records`` instead.
        """
        t = check_similarity(min_similarity)
        score = scorer(algorithm, ngram_size)
        scored = [F.struct(score(*self.sides(c, case_insensitive)).alias("score"), F.lit(-k).alias("at"), F.lit(c).alias("match")) for k, c in enumerate(choices) if c is not None]
        if not scored:
            return F.lit(None).cast("struct<match:string,score:double>")
        best = F.array_max(F.array(*scored))
        return F.when(self.column.isNotNull() & (best["score"] >= t), F.struct(best["match"].alias("match"), best["score"].alias("score")))

    def best_match(self, choices: Sequence[str], algorithm: str = "jaro_winkler", min_similarity: float = 0.0, ngram_size: int = 3, case_insensitive: bool = False) -> Column:
        return self.best_match_score(choices, algorithm, min_similarity, ngram_size, case_insensitive)["match"]

    def normalize(self, mode: str = "lowercase") -> Column:
        return normalize_string(self.column, mode)

    def phonetic(self, algorithm: str = "soundex") -> Column:
        if algorithm not in ("soundex", "metaphone"):
            raise AlgorithmError(f"unknown phonetic algorithm {algorithm!r}; there are soundex and metaphone")
        return self.soundex() if algorithm == "soundex" else self.metaphone()

    def soundex(self) -> Column:
        return phonetic.soundex(self.column)

    def metaphone(self, max_length: int = 4) -> Column:
        return phonetic.metaphone(self.column, max_length)

    def distance(self, other: Column | str, algorithm: str = "levenshtein") -> Column:
        """levenshtein, damerau_levenshtein, hamming (null where lengths differ) or lcs (longer length less common subsequence)."""
        a, b, name = self.column, as_column(other), resolve(algorithm)
        if name == "lcs":
            return F.greatest(F.length(a), F.length(b)) - ngrams.lcs_length(a, b)
        kinds = {"levenshtein": edit.levenshtein, "damerau_levenshtein": edit.damerau_levenshtein, "osa": edit.optimal_string_alignment, "hamming": edit.hamming}
        if name not in kinds:
            raise AlgorithmError(f"{name} is no distance; there are {', '.join([*kinds, 'lcs'])}")
        return kinds[name](a, b)


def fuzzy(column: Column | str) -> Fuzzy:
    return Fuzzy(column)
