"""Vocabularies and index sequences."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regimen.operators import lookup
from regimen.operators.sample import index_rows
from regimen.sources.tables import children, read_json, write_once, written

PAD = "<PAD>"


def build_vocab(ids: DataFrame, first: int = 0, pad: bool = False, column: str = "id") -> DataFrame:
    """id, idx: the distinct ids in code-point order from first on; with pad, <PAD> is 0."""
    vocab = index_rows(ids.select(F.col(column).alias("id")).where("id is not null").distinct(), ["id"]).select("id", (F.col("idx") + first).cast("int").alias("idx"))
    return vocab.unionByName(vocab.sparkSession.createDataFrame([(PAD, 0)], "id string, idx int")) if pad else vocab


def drug_vocab(df: DataFrame, drugs: str = "drug_set") -> DataFrame:
    return build_vocab(df.select(F.explode(drugs).alias("id")), first=1, pad=True)


def disease_vocab(df: DataFrame, condition: str = "condition_id_norm") -> DataFrame:
    return build_vocab(df.select(F.col(condition).alias("id")))


def write_vocab(vocab: DataFrame, path: str) -> None:
    vocab.write.mode("overwrite").parquet(path)


def encode_examples(df: DataFrame, drugs_vocab: DataFrame, diseases_vocab: DataFrame, key: str = "example_key", drugs: str = "drug_set", condition: str = "condition_id_norm") -> DataFrame:
    """df with drug_idx (array<int>, in the order of the drugs), disease_idx and length. Examples with an id outside a vocabulary go."""
    known = lambda vocab: vocab.where(F.col("id").isNotNull()).select("id", F.array(F.col("idx")).alias("vector"))

    def make(rows: pa.RecordBatch, codes: np.ndarray, sizes: np.ndarray, drug: np.ndarray, disease: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        row = np.repeat(np.arange(len(sizes)), sizes)
        keep = (sizes > 0) & (disease >= 0) & (np.bincount(row[codes < 0], minlength=len(sizes)) == 0)
        if keep.any():
            left = rows.filter(pa.array(keep))
            idx = lookup.lists(sizes[keep], pa.array(drug[codes[keep[row]], 0], pa.int32()))
            more = [idx, pa.array(own[disease[keep], 0], pa.int32()), pa.array(sizes[keep], pa.int32())]
            yield pa.RecordBatch.from_arrays([*left.columns, *more], [*left.schema.names, "drug_idx", "disease_idx", "length"])

    added = [T.StructField("drug_idx", T.ArrayType(T.IntegerType())), *(T.StructField(n, T.IntegerType()) for n in ("disease_idx", "length"))]
    return lookup.with_vectors(df, known(drugs_vocab), known(diseases_vocab), make, T.StructType([*df.schema.fields, *added]), "int", key, drugs, condition)


def pad(df: DataFrame, width: int | None = None, column: str = "drug_idx", output: str = "padded") -> DataFrame:
    """Sequences filled with 0 up to width, or to the longest one."""
    longest = width if width is not None else df.agg(F.max(F.size(column))).first()[0] or 0
    return df.withColumn(output, F.concat(column, F.array_repeat(F.lit(0), F.greatest(F.lit(longest) - F.size(column), F.lit(0)))))


class GrowingVocabulary:
    """A stored vocabulary to which unseen ids are added: indices once given never change.

    Each growth writes the ids that no committed growth has, numbered in code-point order from the next free index on: ranges are sorted on
    their own and shifted by the sizes before, so no task numbers all of them. Its manifest, written whole and once, makes it count; a growth
    that was stopped, or came second, is written again on top of what is there then. first: the index of the first id; pad: <PAD> is 0.
    """

    def __init__(self, spark: SparkSession, path: str, first: int = 0, pad: bool = False) -> None:
        if pad and first < 1:
            raise ValueError("with <PAD> at 0 the ids begin at 1 or later")
        self.spark, self.path = spark, path.rstrip("/")
        write_once(spark, self._manifest(0), {"parts": [], "next": first, "pad": pad, "first": first})
        there = self.manifest()
        if (there["first"], there["pad"]) != (first, pad):
            raise ValueError(f"{path} begins at {there['first']}, {'with' if there['pad'] else 'without'} <PAD>")

    def _manifest(self, number: int) -> str:
        return f"{self.path}/manifests/{number:012d}.json"

    def _latest(self) -> int:
        return max((int(n[:-5]) for n in children(self.spark, f"{self.path}/manifests") if n.endswith(".json") and n[0] != "."), default=0)

    def manifest(self) -> dict:
        return read_json(self.spark, self._manifest(self._latest()))

    def read(self, version: int | None = None) -> DataFrame:
        """id, idx of all growths, or of those up to a version."""
        now = read_json(self.spark, self._manifest(self._latest() if version is None else version))
        schema = "id string, idx int"
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in now["parts"]]) if now["parts"] else self.spark.createDataFrame([], schema)
        return rows.union(self.spark.createDataFrame([(PAD, 0)], schema)) if now["pad"] else rows

    def grow(self, ids: DataFrame, column: str = "id") -> int:
        """Adds the ids that are new; null isn't an id. Returns how many."""
        wanted = written(ids.select(F.col(column).alias("id")).where("id is not null").distinct(), "wanted-ids")
        while True:
            number, now = self._latest(), self.manifest()
            new = index_rows(wanted.join(self.read(), "id", "left_anti"), ["id"], "_pos")
            part = f"growth-{uuid.uuid4().hex}"
            new.select("id", (F.col("_pos") + now["next"]).cast("int").alias("idx")).write.parquet(f"{self.path}/{part}")
            n = self.spark.read.parquet(f"{self.path}/{part}").count()
            if not n or write_once(self.spark, self._manifest(number + 1), now | {"parts": [*now["parts"], part], "next": now["next"] + n}):
                return n
