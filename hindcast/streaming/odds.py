"""Latest odds per runner, from a stream of snapshots.

Each micro-batch is reduced to one row per key and merged into the buckets of its keys; the files of all other buckets stay
untouched. The latest value by time does not depend on the order of arrival, so late rows lose, and a batch that is
replayed after a failure changes nothing that it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hindcast.sources.buckets import BucketedTable


def upsert_stream(updates: DataFrame, table: BucketedTable, checkpoint: str, ts: str = "scraped_at", value: str = "win_odds") -> StreamingQuery:
    """Start the stream; it handles what is available and stops."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read for its buckets and for the merge
        try:
            table.upsert_latest(batch.withColumn(value, F.col(value).cast("string")), ts, value)
        finally:
            batch.unpersist()

    return (updates.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
