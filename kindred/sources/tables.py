"""Reading and writing the tables that are matched, and storing indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kindred.errors import ValidationError

FORMATS = ("parquet", "orc", "csv", "json", "text")


def read_records(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, columns: list[str] | None = None, **options) -> DataFrame:
    """A table of records; ``columns`` reaches the scan. CSV and JSON need a ``schema``, so that nothing is read twice."""
    if fmt not in FORMATS:
        raise ValidationError(f"format is one of {', '.join(FORMATS)}, not {fmt!r}")
    if fmt in ("csv", "json") and schema is None:
        raise ValidationError(f"{fmt} needs a schema")
    reader = spark.read.format(fmt).options(**({"header": True} if fmt == "csv" else {}) | options)
    df = (reader.schema(schema) if schema else reader).load(path)
    return df.select(*columns) if columns else df


def write_matches(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode).format(fmt)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
