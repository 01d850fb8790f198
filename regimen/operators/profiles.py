"""Profiles of stored tables from sketches that are kept per part and merged: only new or changed parts are scanned.

A part is a data file. For each part and column the store keeps the number of rows and nulls, the least and greatest value, a HyperLogLog
sketch of the distinct values, a frequent-items sketch, and for numbers a KLL sketch of the quantiles. merged() unions them
over the parts without reading the table. The store is a KeyedLog by part and column, so a part that was rewritten (another size or time) replaces its rows.

Bounds: the distinct count is within DISTINCT_ERROR of the true one with a probability of 0.997; a quantile's rank is within RANK_ERROR with 0.99; a
value's count is never missed by more than n * COUNT_ERROR / items, so every value more frequent than that is among the items.

Defined results: nulls count in n_nulls alone; values are compared as text, numbers also as doubles; NaN is left out of the quantiles; a table
without rows has no profile; a part that was deleted counts no more once merged() is given the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regimen.sources.log import KeyedLog

#: Three standard errors of the distinct count at 2 ** 12 registers, the rank error of the quantiles at k = 200, and what n / items is multiplied by.
DISTINCT_ERROR, RANK_ERROR, COUNT_ERROR = 3 * 1.04 / 64, 0.0165, 3.5
ITEMS = 400
SCHEMA = "key string, part string, stamp string, column string, n_rows bigint, n_nulls bigint, least string, greatest string, distinct binary, frequent struct<sketch:binary,maxItemsTracked:int,itemDataType:string,itemDataTypeDDL:string>, quantiles binary"


def profile_store(spark: SparkSession, path: str) -> KeyedLog:
    return KeyedLog(spark, path, "key", SCHEMA, buckets=8)


def parts(table: DataFrame) -> DataFrame:
    """part, stamp of every data file of a stored table."""
    file = F.col("_metadata")
    return table.select(file["file_path"].alias("part"), F.concat_ws(":", file["file_size"], F.unix_micros(file["file_modification_time"])).alias("stamp")).distinct()


def profile_new(table: DataFrame, store: KeyedLog, columns: list[str], items: int = ITEMS) -> int:
    """Adds the profiles of the parts of a stored table that the store doesn't have as they are; returns their number."""
    have = store.snapshot().select("part", "stamp").distinct()
    new = [r["part"] for r in parts(table).join(have, ["part", "stamp"], "left_anti").select("part").collect()]  # the driver lists the files anyway
    if not new:
        return 0
    spark, numeric = table.sparkSession, [f.name for f in table.schema if f.name in columns and f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")]
    file = F.col("_metadata")
    value = lambda c: F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), (F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")).alias("number"))
    rows = spark.read.schema(table.schema).parquet(*new).select(file["file_path"].alias("part"), F.concat_ws(":", file["file_size"], F.unix_micros(file["file_modification_time"])).alias("stamp"), F.inline(F.array(*[value(c) for c in columns])))
    sketched = rows.groupBy("part", "stamp", "column").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("value").isNull()).alias("n_nulls"), F.min("value").alias("least"), F.max("value").alias("greatest"),
        F.hll_sketch_agg("value", 12).alias("distinct"), F.expr(f"approx_top_k_accumulate(value, {items})").alias("frequent"),
        F.kll_sketch_agg_double(F.when(~F.isnan("number"), F.col("number"))).alias("quantiles"),
    )
    store.append(sketched.withColumn("key", F.concat_ws("|", "part", "column")))
    return len(new)


def merged(store: KeyedLog, table: DataFrame | None = None, k: int = 10, items: int = ITEMS, ranks: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """column, n_rows, n_nulls, least, greatest, n_distinct, distinct_low, distinct_high, top (value, count, least it can be), quantiles (null where no value is a number) over all parts of the store; with a table, over those that it still has."""
    rows = store.snapshot()
    if table is not None:
        rows = rows.join(parts(table), ["part", "stamp"], "left_semi")
    united = rows.groupBy("column").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_nulls").alias("n_nulls"), F.min("least").alias("least"), F.max("greatest").alias("greatest"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("n_distinct"), F.expr(f"approx_top_k_combine(frequent, {items})").alias("_frequent"),
        F.kll_merge_agg_double("quantiles").alias("_quantiles"),
    )
    top = F.expr(f"approx_top_k_estimate(_frequent, {k})")
    spare = F.ceil((F.col("n_rows") - F.col("n_nulls")) * COUNT_ERROR / items)
    united = united.withColumn("top", F.transform(F.filter(top, lambda t: t["item"].isNotNull()), lambda t: F.struct(t["item"].alias("value"), t["count"].alias("count"), F.greatest(t["count"] - spare, F.lit(0)).alias("at_least"))))
    numbers = F.when(F.kll_sketch_get_n_double("_quantiles") > 0, F.array(*[F.kll_sketch_get_quantile_double("_quantiles", F.lit(r)) for r in ranks]))
    bounds = {"distinct_low": F.floor(F.col("n_distinct") * (1 - DISTINCT_ERROR)), "distinct_high": F.ceil(F.col("n_distinct") * (1 + DISTINCT_ERROR))}
    return united.withColumns({**bounds, "quantiles": numbers}).drop("_frequent", "_quantiles")

