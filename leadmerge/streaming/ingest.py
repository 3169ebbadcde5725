"""Ingest of landed files as a stream of micro-batches.

Each micro-batch is one ingest run keyed by stream name and batch id. A batch that
is delivered again after a failure finds its finished run in the ledger and does
nothing, or repeats an unfinished run in the same folders. State is read from the
tables per batch, so there is no operator state to grow and late rows are merged
like any others; a secondary row that arrives before its base row stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from leadmerge.plans.ingest import ingest
from leadmerge.sources.store import LeadStore

ITEM_SCHEMA = "source string, raw_payload map<string,string>"


def item_stream(
    spark: SparkSession, path: str, *, fmt: str = "json", max_files: int | None = None
) -> DataFrame:
    """Landed files of items ``{"source": ..., "raw_payload": {...}}``."""
    reader = spark.readStream.schema(ITEM_SCHEMA).format(fmt)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def start_ingest(
    stream: DataFrame,
    store: LeadStore,
    checkpoint: str,
    *,
    name: str = "leads",
    interval: str | None = None,
    **options,
) -> StreamingQuery:
    """Start the ingest; without ``interval`` it handles what is there and stops."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        items = batch.select(F.col("source"), F.col("raw_payload"))
        ingest(store, items, idempotency_key=f"{name}:{batch_id}", **options)

    writer = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(handle)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()
