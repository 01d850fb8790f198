"""A keyed log of appends in hash buckets: the last append of a key wins, and readers never shuffle the log.

Folder format: version-N/ is a Parquet table bucketed and sorted by the key, to which each append adds one file a bucket at most; a row carries its append's
id and number (_append, _sequence). manifests/N.json name the version and the appends that count. A manifest is written whole and
renamed without replacing an older one, so of two writers one is first and the other reads again; rows of an append
that no manifest names, as a stopped job leaves them, are never read. compact() rewrites the last rows as a new version; the version
before stays for its readers until the next compaction.

Since all files of a bucket are read by one task, last-wins sums and joins on the key need no exchange of the log, however many appends it has.

Defined results: rows with a null key are an error at append; of rows of one key in one append the greatest by order counts, else by all
columns; an append without rows counts like any other; a log without appends has no rows.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regimen.sources.tables import children, delete, read_json, write_once


class KeyedLog:
    """The log in a folder; a new folder gets buckets hash buckets by key and the columns of schema (DDL or a type)."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str | T.StructType, buckets: int = 16) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        first = {"key": key, "buckets": buckets, "schema": schema.json(), "version": 0, "appends": [], "sequence": 0}
        write_once(spark, self._manifest(0), first)
        there = self.manifest()
        if there["key"] != key or T.StructType.fromJson(json.loads(there["schema"])).simpleString() != schema.simpleString():
            raise ValueError(f"{path} is a log by {there['key']} of other columns")
        self.key, self.buckets, self.schema = key, there["buckets"], schema

    def _manifest(self, number: int) -> str:
        return f"{self.path}/manifests/{number:012d}.json"

    def _latest(self) -> int:
        return max((int(n[:-5]) for n in children(self.spark, f"{self.path}/manifests") if n.endswith(".json") and n[0] != "."), default=0)

    def manifest(self) -> dict:
        """What the latest manifest says."""
        return read_json(self.spark, self._manifest(self._latest()))

    def _table(self, version: int) -> str:
        """The name of a version in this session's catalog."""
        where = f"{self.path}/version-{version}"
        name = f"log_{hashlib.md5(where.encode()).hexdigest()}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}, _append string, _sequence bigint) USING parquet CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{where}'")
        return name

    def _write(self, rows: DataFrame, version: int, append: str, sequence: int) -> None:
        table = self._table(version)
        columns = [F.col(f"`{f.name}`") for f in self.schema]
        rows.select(*columns, F.lit(append).alias("_append"), F.lit(sequence).cast("bigint").alias("_sequence")).repartition(self.buckets, self.key).write.insertInto(table)
        self.spark.catalog.refreshTable(table)

    def append(self, rows: DataFrame, order: list[str] | None = None) -> int:
        """Adds rows as one append; returns its number."""
        key = F.when(F.col(self.key).isNotNull(), F.col(self.key)).otherwise(F.raise_error(F.lit("a row without key")).cast(self.schema[self.key].dataType))
        rest = [f.name for f in self.schema if f.name != self.key]
        own = F.struct(*rest) if rest else F.struct(F.lit(0).alias("_none"))
        # arrays and structs have an order, maps don't: these go by their text
        by = F.struct(*order) if order else F.struct(*[F.to_json(F.struct(c)) for c in rest]) if rest else F.lit(0)
        once = rows.withColumn(self.key, key).groupBy(self.key).agg(F.max_by(own, by).alias("_own")).select(self.key, *[F.col("_own")[c].alias(c) for c in rest])
        while True:  # a writer that comes second writes its rows again under the next number
            number, now = self._latest(), self.manifest()
            append, sequence = uuid.uuid4().hex, now["sequence"] + 1
            self._write(once, now["version"], append, sequence)
            if write_once(self.spark, self._manifest(number + 1), now | {"appends": [*now["appends"], [append, sequence]], "sequence": sequence}):
                return sequence

    def rows(self) -> DataFrame:
        """All rows of the appends that count, with _sequence."""
        now = self.manifest()
        table = self.spark.table(self._table(now["version"]))
        return table.where(F.col("_append").isin([a for a, _ in now["appends"]])).drop("_append")

    def snapshot(self) -> DataFrame:
        """The last row of each key."""
        rest = [f.name for f in self.schema if f.name != self.key]
        last = F.max_by(F.struct(*rest), "_sequence") if rest else F.lit(None)
        out = self.rows().groupBy(self.key).agg(last.alias("_last"))
        return out.select(*[F.col(self.key) if f.name == self.key else F.col("_last")[f.name].alias(f.name) for f in self.schema])

    def known(self, rows: DataFrame) -> DataFrame:
        """The rows whose key is in the log."""
        return rows.join(self.rows().select(self.key), self.key, "left_semi")

    def unknown(self, rows: DataFrame) -> DataFrame:
        """The rows whose key is not in the log, or null."""
        return rows.join(self.rows().select(self.key), self.key, "left_anti")

    def compact(self) -> bool:
        """Rewrites the last rows as a new version. False if another writer was first, which changes nothing."""
        number, now = self._latest(), self.manifest()
        version, append = now["version"] + 1, uuid.uuid4().hex
        while children(self.spark, f"{self.path}/version-{version}"):  # left by a compaction that lost or was stopped
            version += 1
        self._write(self.snapshot(), version, append, now["sequence"])
        if not write_once(self.spark, self._manifest(number + 1), now | {"version": version, "appends": [[append, now["sequence"]]], "previous": now["version"]}):
            return False
        for name in children(self.spark, self.path):
            if name.startswith("version-") and int(name[8:]) < now["version"]:
                delete(self.spark, f"{self.path}/{name}")
        return True

