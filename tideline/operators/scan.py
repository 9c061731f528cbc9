"""Ordered scan: state carried along the ordered rows of each key.

Many timeline rules are recursive (greedy cuts, decimation, re-anchoring): the
next state needs the last decision, so no window frame equals them.  An ordered
scan partitions by key, sorts within partitions and lets a step function walk
the rows, batch by batch.  Memory holds one batch and one state, so a key may
be of any length; its time is linear.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an output batch at most, and bytes of its binary values after which it goes out.
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20
#: Rows of an input batch that are Python objects at a time.
TAKEN = 512

#: make() -> step(*row values) -> tuple of new values, called once per key.
Make = Callable[[], Callable[..., tuple]]


def plain(column: pa.Array) -> list:
    """A column's Python values; numbers without nulls by way of numpy, which is many times faster."""
    numbers = pa.types.is_integer(column.type) or pa.types.is_floating(column.type) or pa.types.is_boolean(column.type)
    return column.to_numpy(zero_copy_only=False).tolist() if numbers and not column.null_count else column.to_pylist()


def taken(found: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches, a few at a time as Python values."""
    for batch in found:
        for at in range(0, batch.num_rows, TAKEN):
            yield from zip(*[plain(c) for c in batch.slice(at, TAKEN).columns], strict=True)


def batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches, however many rows an input row gives: a batch for
    each costs more than the rows, one for all of them holds them all."""
    wide = [i for i, f in enumerate(schema) if pa.types.is_binary(f.type)]
    out: list[tuple] = []
    size = 0

    def full() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        out.append(row)
        for i in wide:
            size += len(row[i] or b"")
        if len(out) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield full()
            out, size = [], 0
    if out:
        yield full()


def tasks(spark: SparkSession) -> int:
    """Tasks for Python work, which costs far more time than the bytes of its
    rows tell: a few for each core, and a number that is not merged by size."""
    return 4 * spark.sparkContext.defaultParallelism


def ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], reads: Sequence[str], adds: str, make: Make) -> DataFrame:
    """``df`` with the columns ``adds`` (DDL): for each row, in ``order`` within
    its ``keys``, what the step makes of the columns ``reads``."""
    new = T._parse_datatype_string(adds)
    out_schema = T.StructType([*df.schema.fields, *new.fields])
    names = df.columns
    from pyspark.sql.pandas.types import to_arrow_schema

    types = [f.type for f in to_arrow_schema(new)]
    at = [names.index(k) for k in keys], [names.index(r) for r in reads]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, step = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keyed = list(zip(*[batch.column(i).to_pylist() for i in at[0]], strict=True)) if keys else [()] * batch.num_rows
            read = zip(*[batch.column(i).to_pylist() for i in at[1]], strict=True)
            rows = []
            for own, values in zip(keyed, read, strict=True):
                if step is None or own != key:
                    key, step = own, make()
                rows.append(step(*values))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=[*names, *[f.name for f in new.fields]])

    parted = df.repartition(*[F.col(f"`{k}`") for k in keys]) if keys else df.coalesce(1)
    return parted.sortWithinPartitions(*[F.col(f"`{c}`") for c in [*keys, *order]]).mapInArrow(run, out_schema)
