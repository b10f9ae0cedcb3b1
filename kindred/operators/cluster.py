"""Clusters: connected components of match edges, their numbers, and the row of each that stands for it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.errors import ValidationError
from kindred.plans.scratch import join_counted, numbered, spool


def pull_to_least(edges: DataFrame, larger_only: bool, total: int) -> DataFrame:
    """For each u: its larger neighbours (large-star) or smaller ones and itself (small-star) point to the smallest node around u.

    The smallest node is an aggregate joined back, and broadcast for nodes with very many neighbours, so these are never
    gathered in one place. There are at most ``total`` neighbours of all nodes.
    """
    if larger_only:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    joined = join_counted(both, least, "u", "n", total)
    if larger_only:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


#: Edges up to which components are found in one task: some 20 MB of numbers.
ONE_TASK = 1 << 20


def least_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges, and the smallest node of the component of each: hooks and shortcuts until nothing changes."""
    node, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    top = np.arange(len(node))
    while True:
        x, y = top[a], top[b]
        low = np.minimum(x, y)
        if (x == y).all():
            return node, node[top]
        np.minimum.at(top, np.maximum(x, y), low)
        while (top != top[top]).any():
            top = top[top]


def in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
        if got:
            node, least = least_of(*(np.concatenate(x) for x in zip(*got)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(least)], ["node", "component"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "node long, component long")


def connected_components(edges: DataFrame, name: str = "edges", one_task: int = ONE_TASK) -> DataFrame:
    """``node, component`` (its smallest node) for all nodes of ``u, v``; the number of rounds is about the logarithm of a chain's length.

    Up to ``one_task`` edges, as counted, need no rounds: one task finds the same components.
    """
    now = spool(edges.where("u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).distinct(), name)
    before, k = None, 0
    while True:
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())
        if 0 < seen[0] <= one_task and before is None:
            return in_one_task(now)
        if seen == before or not seen[0]:
            break
        before, k = seen, k + 1
        now = spool(pull_to_least(pull_to_least(now, True, 2 * seen[0]), False, 2 * seen[0]), f"{name}{k}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def with_groups(df: DataFrame, row_id: str, groups: DataFrame, keep: str) -> DataFrame:
    """``df`` with ``_group_id`` and ``_is_canonical``, from ``row_id, component`` of the rows that have partners.

    Groups are numbered by their smallest row; rows without partners have no group and stand for themselves. The
    row to keep is found by an aggregate, so a very large group isn't sorted in one task.
    """
    columns = [c for c in df.columns if c != row_id]
    if keep not in ("first", "last", "most_complete"):
        raise ValidationError(f"keep is first, last or most_complete, not {keep!r}")
    joined = df.join(groups.select(F.col("row").alias(row_id), "component"), row_id, "left")
    if keep == "most_complete":
        filled = [F.when(F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) != "", 1).otherwise(0) for c in columns]
        best = F.max(F.struct(sum(filled[1:], filled[0]).alias("n"), (-F.col(row_id)).alias("r")))
        kept = joined.where("component is not null").groupBy("component").agg(best.alias("b")).select("component", (-F.col("b.r")).alias("_kept"))
    else:
        kept = joined.where("component is not null").groupBy("component").agg((F.min if keep == "first" else F.max)(row_id).alias("_kept"))
    first = joined.where("component is not null").groupBy("component").agg(F.min(row_id).alias("_first"))
    ids = numbered(first.join(kept, "component"), ["_first"], "_group_id").select("component", "_kept", "_group_id")
    out = joined.join(ids, "component", "left").withColumn("_is_canonical", F.coalesce(F.col(row_id) == F.col("_kept"), F.lit(True)))
    return out.select(*df.columns, "_group_id", "_is_canonical")
