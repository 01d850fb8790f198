"""Tables and small files in the folder that driver and executors share, and joins on keys that may hold a third of all rows."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to so many bytes, counted before.
BROADCAST_BYTES = 8 << 20
#: Rows of a shuffle that a task gets about, where their number is known.
TASK_ROWS = 1 << 20
#: A key is joined on its own if it has more than one row in HEAVY, and more than LEAST_HEAVY (LEAST_SALTED where its rows are dealt).
HEAVY, LEAST_HEAVY, LEAST_SALTED = 1000, 1000, 100


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where a session with a local master has none, as in tests, a new local one. On a cluster it has to be set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="regimen-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """Where this application's tables are written."""
    return f"{shared_folder(spark)}/regimen/{spark.sparkContext.applicationId}"


def discard(spark: SparkSession) -> None:
    """Deletes the tables that this application has written; DataFrames that still read them can't be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str = "table", compression: str = "snappy") -> DataFrame:
    """The rows as a Parquet table in the shared folder, read back: cuts the lineage, survives lost executors and is computed once. discard() deletes it."""
    path = f"{own_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def bucketed(df: DataFrame, by: list[str], n: int, name: str = "buckets") -> DataFrame:
    """The rows as a table of n hash buckets by columns, sorted within them, in the shared folder: joins on all of by shuffle the other side only, however often. discard() deletes it."""
    spark, mark = df.sparkSession, uuid.uuid4().hex
    df.repartition(n, *by).write.bucketBy(n, *by).sortBy(*by).format("parquet").option("path", f"{own_folder(spark)}/{name}-{mark}").saveAsTable(f"buckets_{mark}")
    return spark.table(f"buckets_{mark}")


def _file(spark: SparkSession, path: str):
    """Hadoop's file system and path of a path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _file(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _file(spark, path)
    fs.delete(where, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, sorted; none if it isn't there."""
    fs, where = _file(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def write_once(spark: SparkSession, path: str, content: dict) -> bool:
    """Writes a small JSON file unless there is one: first under a name of its own, then renamed without replacing, so that no reader meets half a file. False if another writer was first."""
    fs, where = _file(spark, path)
    fs.mkdirs(where.getParent())
    hadoop = spark._jvm.org.apache.hadoop.fs
    own = hadoop.Path(where.getParent(), f".{where.getName()}.{uuid.uuid4().hex}")
    out = fs.create(own, False)
    out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    out.close()
    try:
        none = spark.sparkContext._gateway.new_array(getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        hadoop.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration()).rename(own, where, none)
        return True
    except Exception:
        fs.delete(own, False)
        if fs.exists(where):
            return False
        raise


def read_json(spark: SparkSession, path: str) -> dict | None:
    """A small JSON file, None if there is none."""
    if not exists(spark, path):
        return None
    return json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))


def erase(*tables: DataFrame) -> None:
    """Deletes tables of written() that later ones have replaced, so that steps don't pile up in the shared folder. For tables that nothing reads any more; other DataFrames are left alone."""
    for df in tables:
        if where := getattr(df, "_written_to", None):
            delete(df.sparkSession, where)


def as_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its counted rows fit BROADCAST_BYTES, else as it is, for Spark to shuffle."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def n_partitions(spark: SparkSession, rows: int) -> int:
    """Partitions for a shuffle of so many rows: the session's number, or more, so that a task's share doesn't grow with the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


@contextmanager
def partitions_for(spark: SparkSession, rows: int) -> Iterator[None]:
    """Shuffles of plans that are run inside have n_partitions of so many rows. What is made here has to be written here."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, n_partitions(spark, rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def key_sizes(keys: DataFrame, n: str = "n") -> tuple[int, int]:
    """All rows of the keys, and those of the most frequent one."""
    return tuple(keys.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first())


def join_counted(rows: DataFrame, keys: DataFrame, on: list[str], n: str = "n", sizes: tuple[int, int] | None = None) -> DataFrame:
    """Inner join of rows with keys: a row per key with its number n of rows, a table that is cheap to read. on: columns without nulls. sizes: key_sizes, if known.

    A key may hold a third of all rows. At most HEAVY keys can have more than a HEAVY-th of all rows; these are broadcast and their
    rows stay where they are, and the rest is shuffled by key.
    """
    total, most = sizes or key_sizes(keys, n)
    bound = max(total // HEAVY, LEAST_HEAVY)
    if most <= bound:
        return rows.join(keys.drop(n).hint("shuffle_hash"), on)
    heavy = F.broadcast(keys.where(F.col(n) > bound).drop(n))
    rest = rows.join(heavy.select(on), on, "left_anti").join(keys.where(F.col(n) <= bound).drop(n).hint("shuffle_hash"), on)
    return rows.join(heavy, on).unionByName(rest)


def join_salted(rows: DataFrame, large: DataFrame, on: str, by: str, counted: DataFrame | None = None) -> DataFrame:
    """Inner join of rows with large: a row per key that may be too wide to broadcast. Rows of a key with many rows are dealt by the hash of by, and only that key's row of large is repeated, at most HEAVY repetitions in all. counted: a cheaper table with about as many rows of each key, to count instead."""
    often = written((rows if counted is None else counted).groupBy(on).agg(F.count(F.lit(1)).alias("_n")), "key-counts")
    total, most = key_sizes(often, "_n")
    bound = max(total // HEAVY, LEAST_SALTED)
    if most <= bound:
        return rows.join(large, on)
    heavy = F.broadcast(often.where(F.col("_n") > bound).select(on, F.ceil(F.col("_n") / bound).alias("_parts")))
    dealt = rows.join(heavy, on, "left").withColumn("_deal", F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")), F.lit(0))).drop("_parts")
    copied = large.join(heavy, on, "left").withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copied, [on, "_deal"]).drop("_deal")
