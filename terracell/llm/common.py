"""Helpers that several operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.plans.storage import scratch_path
from terracell.session import configure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared scratch folder and go on from the files.

    Lost executors then cost a reread, not a recomputation, and two readers see the same rows.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: Column) -> Column:
    """The fold of a document: crc32 of its id as text, modulo 3. Fold 1 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def piece(text: str, key: str, size: int) -> Column:
    """At most `size` characters of a text, from a place that the key's hash draws from the whole of it."""
    places = F.greatest(F.char_length(text) - size, F.lit(0)) + 1
    start = F.pmod(F.xxhash64(F.col(key), F.lit("piece")), places.cast("long")).cast("int") + 1
    return F.substring(F.col(text), start, F.lit(size))


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """df in range partitions by `order`, written once, each row with the number of its partition.

    Rows equal in all of `order` may be spread over several partitions, so no value is too frequent for a task.
    """
    spread = df.withColumn("spread", F.monotonically_increasing_id()).repartitionByRange(*order, "spread")
    return keep(spread.withColumn("part", F.spark_partition_id()).drop("spread"), "ranged")


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """run for mapInArrow; at the end of a task, what its worker process holds but does not use goes back to the system.

    Worker processes are used again by other operators, and an executor's memory holds several of them.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds at most `limit` bytes of a column of strings or lists of 32-bit numbers; a longer value is alone."""
    for batch in batches:
        values = batch.column(column)
        if isinstance(values, pa.ListArray):
            lengths = 4 * values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        else:
            lengths = pc.binary_length(values).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        start, filled = 0, 0
        for k, n in enumerate(lengths.tolist()):
            if k > start and filled + n > limit:
                yield batch.slice(start, k - start)
                start, filled = k, 0
            filled += n
        if start < len(batch):
            yield batch.slice(start)
