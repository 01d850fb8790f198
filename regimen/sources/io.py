"""Readers and writers for examples, id lists, reports and stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regimen.functions import text as X

PAIR_COLUMNS = ("primary_drug_id_norm", "secondary_drug_id_norm", "condition_id_norm")
SINGLE_COLUMNS = ("final normalized drug id", "final normalized disease id")


def read_csv_text(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """A CSV file with a header, all columns text by name, missing-value tokens null; keeps only columns."""
    raw = spark.read.options(header=True, multiLine=True, escape='"', inferSchema=False).csv(path)
    missing = [c for c in columns if c not in raw.columns]
    if missing:
        raise ValueError(f"{path} lacks {missing}; it has {raw.columns}")
    return raw.select(*[X.null_if_na(F.col(f"`{c}`")).alias(c) for c in columns])


def read_pairs(spark: SparkSession, path: str, label: int) -> DataFrame:
    """drug_set, condition_id_norm, label, bad from a labelled-pair CSV; the label comes from the file. Rows whose list can't be read have bad true and stay for the caller to see."""
    raw = read_csv_text(spark, path, PAIR_COLUMNS)
    parsed = raw.select(X.parse_list(F.col(PAIR_COLUMNS[0])).alias("p"), X.parse_list(F.col(PAIR_COLUMNS[1])).alias("s"), PAIR_COLUMNS[2])
    rows = parsed.select(X.drug_set(F.col("p.items"), F.col("s.items")).alias("drug_set"), PAIR_COLUMNS[2], F.lit(label).alias("label"), (F.col("p.bad") | F.col("s.bad")).alias("bad"))
    return rows.where(F.col("bad") | ((F.size("drug_set") > 0) & F.col(PAIR_COLUMNS[2]).isNotNull() & ~F.col(PAIR_COLUMNS[2]).startswith("Error")))


def read_single_therapy(spark: SparkSession, path: str, label: int) -> DataFrame:
    """drug_set, condition_id_norm, label from a CSV of pipe-separated drugs and one disease."""
    raw = read_csv_text(spark, path, SINGLE_COLUMNS)
    disease = F.trim(F.col(f"`{SINGLE_COLUMNS[1]}`"))
    rows = raw.select(F.array_sort(X.split_pipe(F.col(f"`{SINGLE_COLUMNS[0]}`"))).alias("drug_set"), disease.alias("condition_id_norm"), F.lit(label).alias("label"))
    known = ~F.lower("condition_id_norm").isin("nan", "none", "") & ~F.col("condition_id_norm").startswith("Error")
    return rows.where((F.size("drug_set") > 0) & known)


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct trimmed lines of a text file, without blank ones, as the column id."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''").distinct()


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """A stored example table: Parquet with an array column, or CSV with the list as text."""
    if not path.endswith(".csv"):
        return spark.read.parquet(path).select("drug_set", "condition_id_norm", F.col("label").cast("int").alias("label"))
    raw = read_csv_text(spark, path, ("drug_set", "condition_id_norm", "label"))
    return raw.select(X.parse_list(F.col("drug_set"))["items"].alias("drug_set"), "condition_id_norm", F.col("label").try_cast("int").alias("label"))


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: str | None = None) -> None:
    """Parquet; arrays stay arrays."""
    writer = df.write.mode(mode)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; arrays of strings become list literals."""
    lists = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)]
    df.withColumns({c: X.format_list(F.col(c)) for c in lists}).write.mode(mode).options(header=True, escape='"').csv(path)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A report of a few rows as JSON lines with sorted keys."""
    df.select(*sorted(df.columns)).coalesce(1).write.mode(mode).json(path)
