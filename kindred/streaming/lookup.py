"""Streams against a reference table: each micro-batch is matched by the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from kindred.operators.join import fuzzy_join


def fuzzy_lookup(stream: DataFrame, reference: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str | None = None, **join) -> DataStreamWriter:
    """A writer whose batches are ``fuzzy_join(batch, reference, **join)``, handed to ``sink(matches, batch number)``.

    The sink gets the same batch number again after a failure; one that overwrites by it is exactly-once.
    """

    def one(batch: DataFrame, number: int) -> None:
        sink(fuzzy_join(batch, reference, **join), number)

    writer = stream.writeStream.foreachBatch(one)
    return writer.option("checkpointLocation", checkpoint) if checkpoint else writer
