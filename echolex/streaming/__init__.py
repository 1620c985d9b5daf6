"""Structured Streaming over transcripts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def correct_stream(docs: DataFrame, correct: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Corrects a stream of (doc_id, text) with the batch plan, micro-batch by micro-batch, into Parquet at ``sink``.

    A text needs nothing of other texts, so there is no state to keep between batches. Each batch writes its own folder, named by
    its number: one that is run again after a failure replaces what it wrote."""

    def each(batch: DataFrame, number: int) -> None:
        correct(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
