"""What the operators of this package share: reading tables, shared scratch space, sizing."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType
from pyspark.sql.window import Window

from kindred.plans.scratch import KEYS_BITS, fresh, hot_bound, join_counted, spool  # noqa: F401

#: What splits words: ASCII white space only, the same class everywhere in this package.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that other columns can't clash with those an operator adds."""
    return docs.select(*[F.col(n) for n in names])


def mark(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What tells rows apart where ids repeat: a hash of id and text."""
    return F.xxhash64(doc_id, text)


def mark_of_row(docs: DataFrame) -> Column:
    """What tells rows apart that differ in any column: a hash of all of them."""
    plain = {f.name: F.col(f"`{f.name}`") for f in docs.schema.fields}
    nested = {f.name for f in docs.schema.fields if isinstance(f.dataType, (ArrayType, MapType, StructType))}
    # maps can't be hashed; a tag for each null, as hashes skip nulls
    return F.xxhash64(*[F.to_json(F.struct(c)) if n in nested else c for n, c in plain.items()], F.concat(*[c.isNull().cast("string") for c in plain.values()]))


def with_rows(docs: DataFrame, chosen: DataFrame, marked: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that ``chosen`` (doc_id, mark, times) names, each ``times`` times.

    ``marked`` is the mark that ``chosen`` has, by default ``mark()``. Of rows that share id and mark, one stands for
    all, so ``marked`` should tell apart rows that differ. Whole rows move once, by id and mark; of rows that share
    them a task sends only one on, as the filter on their number is applied before the shuffle, too.
    """
    key = F.coalesce("doc_id", F.lit(0))
    names, taken = docs.columns, set(docs.columns)
    k, m, n, t = (next(x for x in (f"{y}{i or ''}" for i in range(99)) if x not in taken) for y in ("_key", "_mark", "_nth", "_times"))
    totals = chosen.select(key.alias(k), F.col("mark").alias(m), F.col("times").alias(t)).groupBy(k, m).agg(F.sum(t).alias(t)).where(F.col(t) > 0)
    once = docs.withColumn(k, key).withColumn(m, mark() if marked is None else marked).withColumn(n, F.row_number().over(Window.partitionBy(k, m).orderBy(k))).where(F.col(n) == 1)
    joined = once.join(totals, [k, m])
    return joined.withColumn(t, F.explode(F.sequence(F.lit(1).cast("long"), F.col(t)))).select(*names)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def blocks_for(total_bytes: int, each: int, least: int = 12) -> int:
    """How many blocks of about ``each`` bytes hold ``total_bytes``, however many these are."""
    return int(max(least, -(-total_bytes // each)))


def trim() -> None:
    """Gives memory that was freed back to the system, where the C library can: Python workers live on after a task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if free is not None:
        free(0)
