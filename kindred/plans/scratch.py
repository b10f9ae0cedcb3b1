"""Tables that cut lineage, in the folder that driver and executors share, and numbering that needs them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.errors import ValidationError


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is unset and Spark runs on this machine alone, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValidationError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="kindred-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path below this application's folder in the shared one."""
    return f"{shared_dir(spark)}/kindred-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"


def spool(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: an executor that is lost costs a re-read."""
    at = fresh(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def clear(spark: SparkSession) -> None:
    """Deletes what this application has spooled. Results that were made from it can't be read after that."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/kindred-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of one key that one task may join, at least; and the power of two of keys that are broadcast at most.
HOT, KEYS_BITS = 256, 16


def hot_bound(total: int) -> int:
    """Fewer than 2^KEYS_BITS keys can have more than this many of ``total`` rows each."""
    return max(HOT, total >> KEYS_BITS)


def join_counted(rows: DataFrame, found: DataFrame, key: str | list[str], count: str, total: int | None = None) -> DataFrame:
    """``rows`` joined to ``found``, which has a row for each ``key`` and in ``count`` how many of ``rows`` have it.

    The keys that have more than a 2^16th of all ``total`` rows are fewer than 2^16: their rows of ``found`` are
    broadcast, so the rows that share such a key stay where they are. The others are joined by key. Both tables are
    read twice.
    """
    keys = [key] if isinstance(key, str) else key
    most = hot_bound(rows.count() if total is None else total)
    hot = F.broadcast(found.where(F.col(count) > most))
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(found.where(F.col(count) <= most), keys)
    return rows.join(hot, keys).unionByName(cold)


def numbered(df: DataFrame, order: list[str | Column], into: str = "nth") -> DataFrame:
    """Adds 0, 1, 2, ... in ``order``, without bringing all rows to one task.

    Rows are dealt by range and numbered in their partition; the partitions' sizes, one row each, give the offsets.
    """
    part, within = f"{into}_part", f"{into}_within"
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = spool(sorted_.withColumn(part, F.spark_partition_id()).withColumn(within, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "numbered")
    sizes = sorted((r[0], r[1]) for r in placed.groupBy(part).count().collect())
    offsets, total = [], 0
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    offset = df.sparkSession.createDataFrame(offsets, f"{part} int, {into}_offset long")
    # one row a partition
    return placed.join(F.broadcast(offset), part).withColumn(into, F.col(f"{into}_offset") + F.col(within)).drop(part, within, f"{into}_offset")


def with_row_ids(df: DataFrame, into: str, id_col: str | None = None) -> DataFrame:
    """``into`` is the user's ``id_col`` if there is one, else the row's position as Spark reads it."""
    if id_col is not None:
        return df.withColumn(into, F.col(id_col).cast("long"))
    placed = spool(df.withColumn(into, F.monotonically_increasing_id()), "rows")
    shift = 1 << 33
    sizes = sorted((r[0], r[1]) for r in placed.groupBy(F.floor(F.col(into) / shift).alias("p")).count().collect())
    offsets, total = [], 0
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    offset = df.sparkSession.createDataFrame(offsets, "_p long, _offset long")
    joined = placed.withColumn("_p", F.floor(F.col(into) / shift)).join(F.broadcast(offset), "_p")
    return joined.withColumn(into, F.col(into) - F.col("_p") * shift + F.col("_offset")).drop("_p", "_offset")
