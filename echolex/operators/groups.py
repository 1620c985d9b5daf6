"""Work on many small groups at once: a call for each batch of whole groups instead of one for each group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows of an Arrow batch, and with them a Python worker's memory on whole texts; a lower bound of the session stays."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))


def _starts(keys: pa.ChunkedArray) -> np.ndarray:
    """Where runs of equal keys begin; nulls are equal."""
    keys = keys.combine_chunks()
    if pa.types.is_nested(keys.type):
        own = keys.to_pylist()
        return np.array([i for i in range(len(own)) if not i or own[i] != own[i - 1]], np.int64)
    ends = pc.run_end_encode(keys, run_end_type=pa.int64()).run_ends.to_numpy()
    return np.concatenate([[0], ends[:-1]]).astype(np.int64)


def in_batches(rows: DataFrame, key: str, work: Callable[[pa.Table, np.ndarray], pa.Table], made: StructType | str) -> DataFrame:
    """``work`` on tables of whole groups of equal ``key``, one after another, with where each begins; a task holds a batch and the group at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.table(batch) if held is None else pa.concat_tables([held, pa.table(batch)])
            starts = _starts(table.column(key))
            last, held = int(starts[-1]), table.slice(int(starts[-1]))
            if last:
                yield from work(table.slice(0, last).combine_chunks(), starts[:-1]).combine_chunks().to_batches()
        if held is not None:
            yield from work(held.combine_chunks(), np.zeros(1, np.int64)).combine_chunks().to_batches()

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, made)
