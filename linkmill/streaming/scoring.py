"""Extension: arriving records matched against static masters by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame

from linkmill.operators.blocking import block


def match_stream(records: DataFrame, s1: DataFrame, path: str, checkpoint: str, k: int = 10):
    """Starts a query that appends each batch's candidate pairs as Parquet, one folder a batch, so a repeated batch replaces itself."""
    def each(batch: DataFrame, number: int) -> None:
        block(s1, batch, k).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
