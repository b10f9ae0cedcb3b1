"""Python kernels registered by name for SQL text."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kindred.functions import kernels, sounds

KERNELS = {
    "jaro_similarity": (kernels.jaro, "double"),
    "jaro_winkler_similarity": (kernels.jaro_winkler, "double"),
    "damerau_levenshtein": (kernels.damerau, "int"),
    "optimal_string_alignment": (kernels.osa, "int"),
    "lcs_length": (kernels.lcs_length, "int"),
    "lcs_string": (kernels.lcs_string, "string"),
    "longest_common_substring": (kernels.common_substring, "string"),
    "double_metaphone_match": (sounds.double_metaphone_match, "boolean"),
}


def pairs(kernel: Callable) -> Callable:
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else kernel(x, y) for x, y in zip(a, b)], dtype=object)

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return run


def singles(kernel: Callable) -> Callable:
    def run(a: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else kernel(x) for x in a], dtype=object)

    run.__annotations__ = {"a": pd.Series, "return": pd.Series}
    return run


def register(spark: SparkSession) -> list[str]:
    """Makes the kernels callable from ``spark.sql``; returns their names."""
    for name, (kernel, returns) in KERNELS.items():
        spark.udf.register(name, F.pandas_udf(pairs(kernel), returns))
    spark.udf.register("metaphone", F.pandas_udf(singles(sounds.metaphone), "string"))
    return [*KERNELS, "metaphone"]
