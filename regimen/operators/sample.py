"""Seeded samples and positions that don't depend on partitions or row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from regimen.sources.tables import written

#: The bits of monotonically_increasing_id below the partition's number.
_ROW_BITS = 33
#: Most rows that a sample takes with a heap in every task.
TOP_ROWS = 10_000


def seeded(key: str | Column, seed: int | Column) -> Column:
    """A hash of seed and key as text; the order that takes a permutation's place."""
    return F.md5(F.concat_ws(":", F.lit(seed).cast("string") if not isinstance(seed, Column) else seed.cast("string"), F.col(key) if isinstance(key, str) else key))


def exact_n(df: DataFrame, n: int, seed: int, key: str = "example_key") -> DataFrame:
    """Exactly n rows, or all if there are fewer: the first by seeded hash, ties by key. Up to TOP_ROWS by a heap per partition; a larger n, such as a share of all rows, by positions from sorted ranges, so that no task holds n rows."""
    ordered = df.withColumn("_order", seeded(key, seed))
    if n <= TOP_ROWS:
        return ordered.orderBy("_order", key).limit(n).drop("_order")
    return index_rows(ordered, ["_order", key], "_idx").where(F.col("_idx") < n).drop("_order", "_idx")


def index_rows(df: DataFrame, by: list[str | Column], output: str = "idx", distinct: bool = False) -> DataFrame:
    """Adds the 0-based position in the order of by, without a window over all rows: ranges are sorted on their own and shifted by the sizes of the ranges before; those sizes are a row per partition. distinct: of rows with equal by one counts, which needs no shuffle of its own."""
    columns = [F.col(c) if isinstance(c, str) else c for c in by]
    ranges = df.repartitionByRange(*columns)
    ranges = ranges.dropDuplicates(by) if distinct else ranges
    placed = written(ranges.sortWithinPartitions(*columns).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_at", _ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    shifts = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"))
    joined = placed.withColumn("_part", part).join(F.broadcast(shifts), "_part")
    return joined.withColumn(output, F.col("_shift") + F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).drop("_at", "_part", "_shift")
