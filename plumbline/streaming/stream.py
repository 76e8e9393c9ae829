"""Replay as a Structured Streaming query over a folder of journal files.

The destination's tables are the state, so each micro-batch is applied by
``foreachBatch`` as one commit of the store, with the ledger in the same
commit. A batch that runs again after a failure finds its sequences in the
ledger and changes nothing, so delivery is exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from plumbline.plans.model import Schema
from plumbline.sources.store import Store
from plumbline.streaming.journal import JOURNAL


def journal_stream(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """Journal rows as they arrive as Parquet files."""
    return spark.readStream.schema(JOURNAL).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def replay_stream(journal: DataFrame, destination: Store, schema: Schema, checkpoint: str, tolerant: bool = True, drain: bool = True) -> StreamingQuery:
    """Apply a stream of changes to a store; with ``drain`` it ends when all files are read.

    Files must arrive in the order of their sequences, as one writer makes them.
    """

    def one(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            destination.apply_changes(schema, rows, tolerant)
        finally:
            rows.unpersist()

    writer = journal.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer.trigger(processingTime="1 second")).start()
