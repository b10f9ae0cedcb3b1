"""Reading the arguments that the table operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.errors import ValidationError
from kindred.functions.registry import Algorithm, Scorer, resolve
from kindred.plans.similarity_join import Field

Algo = str | Algorithm | Scorer


def check_weights(columns: list[str], weights: dict[str, float] | None, algorithms: dict[str, Algo] | None) -> None:
    for name, given in (("weights", weights), ("algorithms", algorithms)):
        unknown = set(given or {}) - set(columns)
        if unknown:
            raise ValidationError(f"{name} names columns that aren't compared: {sorted(unknown)}")
    if any(w < 0 for w in (weights or {}).values()):
        raise ValidationError("weights aren't negative")


def fields_of(columns: list[str], algorithm: Algo, weights: dict[str, float] | None, algorithms: dict[str, Algo] | None) -> list[Field]:
    check_weights(columns, weights, algorithms)
    out = []
    for c in columns:
        a = (algorithms or {}).get(c, algorithm)
        if isinstance(a, (str, Algorithm)):
            resolve(a)
        out.append(Field(c, c, a, float((weights or {}).get(c, 1.0))))
    return out


def as_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """The compared columns as strings, null as empty: nothing is similar to an empty value by grams."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns})


def key_rows(df: DataFrame, columns: list[str], row_id: str, into: str) -> DataFrame:
    """One row for each combination of the compared columns, with its smallest row id: equal rows are compared once."""
    return as_text(df.select(row_id, *columns), columns).groupBy(*columns).agg(F.min(row_id).alias(into))
