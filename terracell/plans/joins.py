"""Joins that stay even when keys are not.

Plain equi-joins are left to Spark, which measures both sides at run time and picks
broadcast, hash or sort-merge itself. The helpers here cover the two shapes it cannot
see: a summary grouped from a large frame, and a join on a few very hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import cut

#: a summary with at most this many rows is broadcast
SUMMARY_ROWS = 200_000
#: and at most this many bytes of text
BROADCAST_BYTES = 64_000_000
#: rows that a join with a broadcast side may make, whatever the partitions of the other
BROADCAST_RESULT = 16_000_000
#: rows of one join key that one task should handle
ROWS_PER_TASK = 2_000_000
#: copies of the small side when a summary is too large to broadcast
FALLBACK_SALTS = 32


def task_count(df: DataFrame) -> int:
    """Partitions for rows that are about to be multiplied: at least two per core."""
    spark = df.sparkSession
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fan_out(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """Spread few compact rows evenly before each becomes hundreds.

    A fixed partition number, since sizes measured before the expansion say nothing about the
    work after it. `rows`, where known, are those after it: no more than ROWS_PER_TASK a partition on average.
    """
    return df.repartition(max(task_count(df), rows // ROWS_PER_TASK), *keys)


def rebalance(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of the same keys together, in partitions of an even size, before a write.

    Adaptive execution splits and merges them by measured size. Where it is off, as in a stateful
    streaming batch, this is a plain repartition.
    """
    if df.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true":
        return df.hint("rebalance", *[F.col(k) for k in keys])
    return df.repartition(*keys)


def measured(df: DataFrame, keys: list[str]) -> dict:
    """Of a computed table, in one pass: rows, and the least and largest value of each key."""
    ends = [f(k).alias(f"{name}_{k}") for k in keys for name, f in (("low", F.min), ("high", F.max))]
    return df.agg(F.count(F.lit(1)).alias("rows"), *ends).first().asDict() | {"table": df}


def small_enough(size: dict, max_rows: int) -> bool:
    """Few rows, and only then few bytes (as text), so that a large table is counted and not written out as text."""
    if size["rows"] > max_rows:
        return False
    text = F.octet_length(F.to_json(F.struct(*size["table"].columns)))
    return (size["table"].agg(F.sum(text)).first()[0] or 0) <= BROADCAST_BYTES


def within(df: DataFrame, keys: list[str], size: dict) -> DataFrame:
    """Rows whose keys lie between the measured ends: plain comparisons, which prune files and row groups of a stored table."""
    plain = dict(df.dtypes)
    for k in keys:
        if size[f"low_{k}"] is not None and plain[k].split("(")[0] in (
            "decimal", "int", "bigint", "string", "date", "timestamp", "smallint", "tinyint"):
            df = df.filter(F.col(k).between(size[f"low_{k}"], size[f"high_{k}"]))
    return df


def summary_join(
    big: DataFrame, summary: DataFrame, on: list[str], how: str = "inner", max_rows: int = SUMMARY_ROWS
) -> DataFrame:
    """Attach a per-group summary (one row per key) to the rows it was grouped from.

    The summary is computed once and measured. Up to max_rows and BROADCAST_BYTES it is broadcast, so the
    big side is not shuffled at all; beyond that, both sides are salted, so a key holding
    a large share of the rows is spread over many tasks.
    """
    summary = cut(summary)
    if small_enough(measured(summary, []), max_rows):
        return big.join(F.broadcast(summary), on, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(FALLBACK_SALTS)))
    copies = summary.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(FALLBACK_SALTS - 1).cast("bigint"))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def small_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    spread_by: list[str],
    how: str = "inner",
    max_rows: int = SUMMARY_ROWS,
    meets: int = 1,
    size: dict | None = None,
) -> DataFrame:
    """Equi-join of stored data with a side that is usually small (spans, points, requests).

    The side is computed once and measured, here, while the plan is built. Its key ranges reach the scan of the stored data, which
    then reads only the files and row groups that can match. Up to max_rows and BROADCAST_BYTES the side is
    broadcast, so the stored data is never shuffled for it; beyond that the join is a shuffled one that spreads hot keys.

    `meets` says about how many rows a row of the side meets (inner joins only). The tasks of a shuffled join then follow the result's size and
    not the input's, and a result beyond BROADCAST_RESULT is joined that way, since few stored partitions would each make very many rows of it.
    `size` is measured(cut(small), on), if that is known already.
    """
    size = size or measured(cut(small), on)
    small = size["table"]
    if how in ("inner", "left_semi"):
        big = within(big, on, size)
    rows = size["rows"] * meets
    if (how != "inner" or rows <= BROADCAST_RESULT) and small_enough(size, max_rows):
        return big.join(F.broadcast(small), on, how)
    if how == "inner":
        return skew_join(small, big, on, spread_by, rows_per_task=max(1, ROWS_PER_TASK // meets), multiplies=meets > 1, rows=rows)
    # one row per key on the small side: the stored rows of a hot key are spread, its row copied
    return skew_join(big, small, on, [c for c in big.columns if c not in on][:2] or on, how)


def skew_join(
    big: DataFrame,
    other: DataFrame,
    on: list[str],
    spread_by: list[str],
    how: str = "inner",
    rows_per_task: int = ROWS_PER_TASK,
    multiplies: bool = False,
    rows: int = 0,
) -> DataFrame:
    """Equi-join where a few keys of `big` may hold a large share of its rows.

    Keys above rows_per_task are found with one partially aggregated count. There are at most
    rows(big) / rows_per_task of them, so that list is broadcast. Only rows of those keys are
    spread, by a hash of `spread_by`; matching rows of `other` are copied once per part.
    `how` is inner, left or left_semi: `other` may be copied, `big` never is. multiplies says that rows meet
    many others; the partition number is then fixed instead of following the input size. `rows`, if known, are those of the result.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"unsupported join type {how}")
    hot = (
        big.groupBy(*on)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > rows_per_task)
        .select(*on, F.ceil(F.col("_n") / rows_per_task).cast("int").alias("_parts"))
    )
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    left = (
        big.join(F.broadcast(hot), on, "left")
        .withColumn("_part", F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), parts).cast("int"))
        .drop("_parts")
    )
    right = (
        other.join(F.broadcast(hot), on, "left")
        .withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
        .drop("_parts")
    )
    keys = [*on, "_part"]
    if multiplies:
        left, right = fan_out(left, *keys, rows=rows), fan_out(right, *keys, rows=rows)
    return left.join(right, keys, how).drop("_part")


#: levels of buckets, each twice as wide as the one before: from 0.5 degrees they reach beyond the globe
BOX_LEVELS = 11


def bucket_range(low: Column, high: Column, size) -> Column:
    """Bucket numbers a closed interval touches."""
    return F.sequence(F.floor(low / size).cast("int"), F.floor(high / size).cast("int"))


def box_level(prefix: str, bucket: float) -> Column:
    """The level whose buckets are at least as wide as the box, so that it touches few of them."""
    extent = F.greatest(F.col(f"{prefix}xmax") - F.col(f"{prefix}xmin"), F.col(f"{prefix}ymax") - F.col(f"{prefix}ymin"))
    return F.when(extent <= bucket, F.lit(0)).otherwise(F.least(F.ceil(F.log2(extent / bucket)), F.lit(BOX_LEVELS)).cast("int"))


def box_join(
    big: DataFrame,
    other: DataFrame,
    spread_by: list[str],
    on: list[str] | None = None,
    bucket: float = 0.5,
    rows_per_task: int = ROWS_PER_TASK,
    max_rows: int = SUMMARY_ROWS,
) -> DataFrame:
    """All pairs whose boxes meet (closed), as an equi-join on grid buckets of several sizes.

    `big` has columns xmin..ymax, `other` has b_xmin..b_ymax; further columns must not clash
    except those in `on`. A box lives on the level of its size, where it touches at most a few buckets, and is looked up
    on the wider levels, so a global box costs as few rows as a small one. A pair meets on the level of its wider
    box: `_wide` says whether that is `other`'s own level (also where both are equal) or only `big`'s. A pair
    sharing several buckets is kept in the one that holds the lower left corner of the overlap, so no distinct is needed
    afterwards. The levels that boxes of either side live on, at most BOX_LEVELS + 1, are collected first, and no row is made for a level
    where nothing can meet it. `other` is broadcast when its counted bucket rows allow it; if not, hot buckets of `big` are spread.
    """
    on = list(on or [])
    size = F.lit(bucket) * F.call_function("shiftleft", F.lit(1), F.col("_level"))

    def spread(df, p):
        """One row per level from the box's own on, and bucket there."""
        levels = F.sequence(F.col("_own"), F.lit(BOX_LEVELS))
        keyed = df.withColumn("_own", box_level(p, bucket)).withColumn("_level", F.explode(levels))
        return keyed.withColumn("_own", F.col("_own") == F.col("_level"))

    def bucketed(df, p):
        keyed = df.withColumn("_bx", F.explode(bucket_range(F.col(f"{p}xmin"), F.col(f"{p}xmax"), size)))
        return keyed.withColumn("_by", F.explode(bucket_range(F.col(f"{p}ymin"), F.col(f"{p}ymax"), size)))

    keys = [*on, "_level", "_wide", "_bx", "_by"]
    # other's own level is met by big's own and wider ones; other's wider levels are met by big's own only
    lived_on = big.agg(F.collect_set(box_level("", bucket))).first()[0]
    levelled = spread(other, "b_").filter(F.col("_own") | F.col("_level").isin(lived_on))
    boxes = cut(bucketed(levelled.withColumnRenamed("_own", "_wide"), "b_"))
    levels = F.collect_set(F.when(F.col("_wide"), F.col("_level"))).alias("levels")  # at most BOX_LEVELS + 1
    counted = boxes.agg(F.count(F.lit(1)).alias("rows"), levels).first().asDict() | {"table": boxes}
    looked_up = spread(fan_out(big, *spread_by), "").filter(F.col("_own") | F.col("_level").isin(counted["levels"]))
    met = F.when(F.col("_own"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
    looked_up = looked_up.withColumn("_wide", F.explode(met)).drop("_own")
    # only boxes of a lower level look up big's own one
    lowest = min(counted["levels"], default=BOX_LEVELS)
    looked_up = bucketed(looked_up.filter(F.when(F.col("_wide"), F.col("_level").isin(counted["levels"])).otherwise(F.col("_level") > lowest)), "")
    if small_enough(counted, max_rows):
        joined = looked_up.join(F.broadcast(boxes), keys)
    else:
        joined = skew_join(looked_up, boxes, keys, spread_by, "inner", rows_per_task, multiplies=True)
    first_x = F.floor(F.greatest("xmin", "b_xmin") / size).cast("int")
    first_y = F.floor(F.greatest("ymin", "b_ymin") / size).cast("int")
    meets = (
        (F.col("xmin") <= F.col("b_xmax"))
        & (F.col("xmax") >= F.col("b_xmin"))
        & (F.col("ymin") <= F.col("b_ymax"))
        & (F.col("ymax") >= F.col("b_ymin"))
    )
    return joined.filter(meets & (F.col("_bx") == first_x) & (F.col("_by") == first_y)).drop("_bx", "_by", "_level", "_wide")
