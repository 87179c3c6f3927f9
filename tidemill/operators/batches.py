"""Arrow batches through a row function: the one bridge from DataFrames to the Python page functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows of output built at once; pages can be megabytes.
ROWS = 64


#: Input of more than so many bytes a core is left as its files split it: moving pages costs more than uneven tasks.
SMALL_TASK = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small input, which comes as fewer files than there are cores, over all cores; larger ones and streams stay as they are,
    and so does one that was spread before, such as rows of which large texts were made since."""
    if df.isStreaming:
        return df
    n, plan = df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution().optimizedPlan()
    if re.search(r"^\W*Repartition(?:ByExpression)? ", plan.toString(), re.M):
        return df
    size = int(plan.stats().sizeInBytes())
    return df.repartition(n) if size <= n * SMALL_TASK and len(df.inputFiles()) < n else df


def map_rows(df: DataFrame, columns: list[str], function: Callable[..., dict[str, Any] | None], schema: T.StructType, keep: list[str] | None = None) -> DataFrame:
    """The kept columns of df (all but those given to the function, if None) with the function's fields.

    The function gets the named columns of one row and gives a dict of the schema's fields; a missing one is null.
    """
    keep = [c for c in df.columns if c not in columns] if keep is None else keep
    kinds = {f.name: to_arrow_type(f.dataType) for f in schema}
    clash = set(keep) & set(kinds)
    keep = [c for c in keep if c not in clash]
    out = T.StructType([df.schema[c] for c in keep] + list(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                inputs = zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in columns), strict=True)
                rows = [function(*values) or {} for values in inputs]
                made = [pa.array([r.get(name) for r in rows], kind) for name, kind in kinds.items()]
                yield pa.record_batch([*(part.column(part.schema.get_field_index(c)) for c in keep), *made], names=out.names)

    return df.select(*dict.fromkeys([*keep, *columns])).mapInArrow(run, out)


def flat_map_rows(df: DataFrame, columns: list[str], function: Callable[..., list[dict[str, Any]]], schema: T.StructType, keep: list[str]) -> DataFrame:
    """As map_rows, with any number of rows for each."""
    kinds = {f.name: to_arrow_type(f.dataType) for f in schema}
    out = T.StructType([df.schema[c] for c in keep] + list(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                inputs = zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in columns), strict=True)
                found = [(k, row) for k, values in enumerate(inputs) for row in function(*values)]
                at = pa.array([k for k, _ in found], pa.int64())
                made = [pa.array([r.get(name) for _, r in found], kind) for name, kind in kinds.items()]
                yield pa.record_batch([*(part.column(part.schema.get_field_index(c)).take(at) for c in keep), *made], names=out.names)

    return df.select(*dict.fromkeys([*keep, *columns])).mapInArrow(run, out)
