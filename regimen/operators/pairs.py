"""Labelled (drug set, disease) pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regimen.functions import text as X

KEY = ("drug_set", "condition_id_norm")


def valid_rows(df: DataFrame, drugs: str = "drug_set", condition: str = "condition_id_norm", trim: bool = False) -> DataFrame:
    """Rows with a non-empty drug set and a usable condition. trim: the condition is trimmed and nan/none are matched in any case."""
    value = F.trim(F.col(condition)) if trim else F.col(condition)
    df = df.withColumn(condition, value)
    missing = F.lower(condition).isin("nan", "none", "") if trim else F.col(condition).isin("nan", "None")
    return df.where((F.size(drugs) > 0) & F.col(condition).isNotNull() & ~missing & ~F.col(condition).startswith("Error"))


def combine_sources(*sources: DataFrame) -> DataFrame:
    """All rows of several labelled sources."""
    return reduce(lambda a, b: a.unionByName(b), sources)


def dedupe(df: DataFrame, key: tuple[str, ...] = KEY, label: str = "label") -> DataFrame:
    """One row per key; label 0 wins. conflict says whether the key had several labels."""
    return df.groupBy(*key).agg(F.min(label).alias(label), (F.min(label) != F.max(label)).alias("conflict"))


def conflicts(df: DataFrame, key: tuple[str, ...] = KEY, label: str = "label") -> DataFrame:
    """The keys with several labels, with their numbers of rows per label."""
    return df.groupBy(*key).agg(F.count_if(F.col(label) == 0).alias("n_negative"), F.count_if(F.col(label) == 1).alias("n_positive")).where("n_negative > 0 and n_positive > 0")


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def required_nodes(df: DataFrame, drugs: str = "drug_set", condition: str = "condition_id_norm") -> DataFrame:
    """Distinct drugs and diseases as the column id."""
    return df.select(F.explode(F.array_append(F.col(drugs), F.col(condition))).alias("id")).distinct()


def of_size(df: DataFrame, n: int, drugs: str = "drug_set") -> DataFrame:
    """Examples of exactly n drugs."""
    return df.where(F.size(drugs) == n)


def with_key(df: DataFrame, drugs: str = "drug_set", condition: str = "condition_id_norm", output: str = "example_key") -> DataFrame:
    return df.withColumn(output, X.example_key(F.col(drugs), F.col(condition)))
