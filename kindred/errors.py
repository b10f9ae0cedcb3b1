"""Errors and argument checks; all checks run while a plan is built, not while it runs."""

from __future__ import annotations

import math


class KindredError(Exception):
    """Base of this library's errors."""


class ValidationError(KindredError, ValueError):
    """An argument is out of range."""


class AlgorithmError(KindredError, ValueError):
    """An algorithm is unknown, or doesn't work here."""


class IndexError_(KindredError):
    """An index is used in a way it can't serve."""


class SchemaError(KindredError, ValueError):
    """A match schema, or a record, is malformed."""


def check_similarity(value: float, name: str = "min_similarity") -> float:
    if not isinstance(value, (int, float)) or not math.isfinite(value) or not 0 <= value <= 1:
        raise ValidationError(f"{name} is a number from 0 to 1, not {value!r}")
    return float(value)


def check_positive(value: int, name: str) -> int:
    if not isinstance(value, int) or isinstance(value, bool) or value < 1:
        raise ValidationError(f"{name} is a whole number from 1 on, not {value!r}")
    return value


def check_distance(value: int, name: str = "max_distance") -> int:
    if not isinstance(value, int) or isinstance(value, bool) or value < 0:
        raise ValidationError(f"{name} is a whole number from 0 on, not {value!r}")
    return value


def check_prefix_weight(value: float) -> float:
    if not isinstance(value, (int, float)) or not math.isfinite(value) or not 0 <= value <= 0.25:
        raise ValidationError(f"prefix_weight is a number from 0 to 0.25, not {value!r}")
    return float(value)


def check_columns(df, columns: list[str]) -> list[str]:
    missing = [c for c in columns if c not in df.columns]
    if not columns or missing:
        raise ValidationError(f"unknown columns {missing}; there are {df.columns}" if missing else "no columns are given")
    return columns
