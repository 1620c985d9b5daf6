"""Small helpers for Column expressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row. What stands inside a lambda of an array function is else computed
    for each element, columns of an earlier projection too, since the optimizer merges projections."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with ``columns``, each computed once a row. A generator stands between: projections are not merged over it, and
    filters on these columns are not moved before what ``rows`` does, where they would be computed for many more rows."""
    kept = [c for c in rows.columns if c not in columns]
    return rows.select(*kept, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def offsets(lengths: Column) -> Column:
    """Of an array of lengths: where each begins, the first at 0. Linear in the array, within its row; null of null."""

    @F.arrow_udf("array<int>")
    def begins(column: pa.Array) -> pa.Array:
        at = column.offsets.to_numpy()
        values = column.flatten().fill_null(0).to_numpy(zero_copy_only=False) if len(column) else np.zeros(0)
        sizes = np.where(np.array(column.is_valid()), np.diff(at), 0) if len(column) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        own = total[:-1] - np.repeat(total[first[:-1]], sizes)
        return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(own.astype(np.int32)), mask=pa.array(~np.array(column.is_valid(), bool)))

    return begins(lengths)


def _nullable(kind: pa.DataType) -> pa.DataType:
    if pa.types.is_list(kind):
        return pa.list_(_nullable(kind.value_type))
    return pa.struct([(f.name, _nullable(f.type)) for f in kind]) if pa.types.is_struct(kind) else kind


def nullable(table: pa.Table) -> pa.Table:
    """The table with all that is inside its types nullable, as results of grouped functions are declared."""
    return table.cast(pa.schema([(f.name, _nullable(f.type)) for f in table.schema]))
