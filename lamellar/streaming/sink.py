"""A Structured Streaming sink: each micro-batch is one append, and a batch that comes again changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from lamellar.operators.commit import Transaction, load
from lamellar.properties import Properties
from lamellar.sources import writer


def append_batches(root: str, name: str, properties: Properties | None = None) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch().  The number of the last batch is committed together with its rows, under the stream's name."""

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = load(spark, root).statistics.get(f"stream:{name}")
        if seen and int(seen.metadata["batch"]) >= number:
            return
        groups = writer.write(batch, root, properties)
        Transaction(spark, root).append(groups, batch.schema).update_statistic(f"stream:{name}", metadata={"batch": str(number)}).commit()

    return append
