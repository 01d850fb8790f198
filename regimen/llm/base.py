"""What the corpus operators share: tables and joins of the core, and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regimen.sources import tables
from regimen.sources.tables import as_small, discard, erase, join_counted, join_salted, key_sizes, own_folder, shared_folder, written

__all__ = ["as_small", "discard", "erase", "id_hash", "join_counted", "join_met", "join_salted", "key_sizes", "own_folder", "shared_folder", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_met(rows: DataFrame, wanted: DataFrame, on: list[str], n: int, row_bytes: int) -> DataFrame:
    """Inner join of rows with wanted, whose n counted rows are broadcast if they are small; else one join on counted keys. A key's rows of wanted go as one row with an array, whose elements are spread after the join, so a key with a third of all rows stays where its rows are."""
    if n * row_bytes <= tables.BROADCAST_BYTES:
        return rows.join(F.broadcast(wanted), on)
    rest = [c for c in wanted.columns if c not in on]
    each = wanted.groupBy(*on).agg(F.collect_list(F.struct(*rest)).alias("_rest")) if rest else wanted.select(on).distinct()
    often = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).join(each, on)
    met = join_counted(rows, written(often, "met-keys"), on, "_n")
    return met.select(*rows.columns, F.inline("_rest")) if rest else met.select(rows.columns)


def id_hash(column: str = "doc_id") -> Column:
    """crc32 of an id written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
