"""Python kernels as Arrow-batched functions that remember the pairs of a batch they have met."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def pair_udf(kernel: Callable[[list, list], list], returns: str) -> Callable[[Column, Column], Column]:
    """``kernel`` over lists, here of the distinct pairs of a batch; null if an argument is null."""

    @F.pandas_udf(returns)
    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict = {}
        at = [None if x is None or y is None else known.setdefault((x, y), len(known)) for x, y in zip(a, b)]
        got = kernel([x for x, _ in known], [y for _, y in known])
        return pd.Series([None if k is None else got[k] for k in at], dtype=object)

    return two


def text_udf(kernel: Callable, returns: str) -> Callable[..., Column]:
    """``kernel`` over one or two string columns; null if an argument is null."""

    @F.pandas_udf(returns)
    def one(a: pd.Series) -> pd.Series:
        known: dict = {}
        return pd.Series([None if x is None else known[x] if x in known else known.setdefault(x, kernel(x)) for x in a], dtype=object)

    @F.pandas_udf(returns)
    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict = {}
        return pd.Series([None if x is None or y is None else known[x, y] if (x, y) in known else known.setdefault((x, y), kernel(x, y)) for x, y in zip(a, b)], dtype=object)

    return lambda *columns: (one if len(columns) == 1 else two)(*columns)


def frame_udf(kernel: Callable[[str], dict], returns: str) -> Callable[[Column], Column]:
    """``kernel`` gives a struct for a string; null for null."""

    @F.pandas_udf(returns)
    def run(a: pd.Series) -> pd.DataFrame:
        known: dict = {}
        return pd.DataFrame([dict.fromkeys(fields) if x is None else known[x] if x in known else known.setdefault(x, kernel(x)) for x in a], columns=fields)

    fields = [f.split()[0] for f in returns.removeprefix("struct<").rstrip(">").replace(":", " ").split(",")]
    return run
