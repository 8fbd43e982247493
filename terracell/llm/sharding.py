"""Contiguous shards of nearly equal bytes (operator 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, ranged


def shard_by_bytes(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut the documents, ordered by id, into n_shards contiguous runs of nearly equal bytes.

    A document's size is the UTF-8 length of its text plus 1. Narrow rows (no text) are sorted by range
    and written once; each partition's total is summed, the totals are added up, and a document's prefix
    sum is its partition's offset plus a running sum inside the partition. The document whose middle byte
    falls in the s-th of n_shards equal parts goes to shard s, so a shard is off its target by at most
    one document at each end.

    Returns id, size long, text_crc32 long, shard int, slot long (0, 1, ... in each shard, in id order).

    Null text has no bytes (size 1, checksum 0). Null ids come first. Repeated ids stay separate rows,
    ordered by checksum and size; rows equal in all three are interchangeable and may fall on either side of a cut.
    An empty table gives no rows; a shard without documents has none either. Other columns are ignored.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("crc"),
    )
    order = ["id", "crc", "size"]
    rows = ranged(narrow, *order)

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a partition
    totals = rows.groupBy("part").agg(F.sum("size").alias("part_size"), F.count(F.lit(1)).alias("part_rows"))
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_size").over(Window.partitionBy()).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = rows.withColumns({"size_to": F.sum("size").over(inside), "row_to": F.count(F.lit(1)).over(inside)})
    placed = keep(
        running.join(F.broadcast(offsets), "part").select(
            *order,
            F.expr(f"{n_shards} * (2 * (size_before + size_to) - size) div (2 * total)").cast("int").alias("shard"),
            (F.col("rows_before") + F.col("row_to") - 1).alias("row"),
        ),
        "shard-placed",
    )
    starts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # one row a shard
    return placed.join(F.broadcast(starts), "shard").select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        "shard",
        (F.col("row") - F.col("first_row")).alias("slot"),
    )
