"""Shared helpers of the training-data operators.

Texts reach Python as Arrow columns.  Most per-word work is done once per
distinct word of a batch (``unique_words``) and spread back over the rows with
vectorised gathers, so cost follows the vocabulary of a batch, not its length.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch between the JVM and Python.
BATCH_ROWS = 4096
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir``; only where that is unset and the session
    runs in one process (tests) a temporary folder takes its place, once.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(shared_dir, "local", None) or tempfile.mkdtemp(prefix="tideline-")
        shared_dir.local = found
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: lineage
    ends there, and a lost executor costs at most the running stage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote, once nothing lazy reads them."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def by_key(rows: DataFrame) -> DataFrame:
    """``rows`` for a join on a key that may be hot: it sorts and merges, so that
    adaptive execution can split what very many rows share."""
    return rows.hint("merge")


def dealt(rows: DataFrame) -> DataFrame:
    """Sums or minima dealt out anew: a join on their key then starts from plain
    exchanges on both sides, which adaptive execution can split."""
    return by_key(rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id's text leaves remainder 0 by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def positional(df: DataFrame, keep: list[str], **more: str) -> DataFrame:
    """Columns ``keep`` as k0, k1, ... and the columns ``more`` under their
    keywords, so that no name of ``df`` can clash."""
    return df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], *[F.col(f"`{c}`").alias(k) for k, c in more.items()])


def through(df: DataFrame, keep: list[str], text: str) -> tuple[DataFrame, Callable[[pa.RecordBatch], list[pa.Array]]]:
    """A frame of the columns ``keep`` and ``text`` for Python, where a text that
    is also kept travels once, and what gives a batch's columns ``keep``."""
    others = [c for c in keep if c != text]
    order = [len(others) if c == text else others.index(c) for c in keep]
    return positional(df, others, text=text), lambda batch: [batch.column(i) for i in order]


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches``; at the end the worker, which lives on, gives its free memory
    back to the system where the C library can do so."""
    yield from batches
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``limit`` bytes in each; one
    longer value stays whole in a slice of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def flat(array: pa.Array | pa.ChunkedArray) -> pa.Array:
    return array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array


def coded(parts: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct values, code of each value, offsets of each row) of a list
    column; empty strings are left out."""
    lo, hi = parts.offsets[0].as_py(), parts.offsets[-1].as_py()
    offsets = parts.offsets.to_numpy() - lo
    encoded = flat(parts.values.slice(lo, hi - lo)).dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    distinct = encoded.dictionary
    if len(distinct):
        empty = pc.index(distinct, pa.scalar("", distinct.type)).as_py()
        if empty >= 0:
            keep = codes != empty
            offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
            codes = codes[keep]
    return distinct, codes, offsets.astype(np.int64)


def unique_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text, coded; null is empty."""
    return coded(pc.ascii_split_whitespace(pc.fill_null(flat(texts).cast(pa.string()), "")))


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` within each row's range."""
    total = np.concatenate((np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)))
    return total[offsets[1:]] - total[offsets[:-1]]
