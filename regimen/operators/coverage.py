"""Which examples have all their identifiers in a set of known nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regimen.functions.text import curie_prefix
from regimen.sources.tables import as_small, written


def annotate(df: DataFrame, nodes: DataFrame, key: str = "example_key", drugs: str = "drug_set", condition: str = "condition_id_norm", node: str = "id") -> DataFrame:
    """df with missing_drug_ids (in order, repeats kept), missing_disease_id and reason; reason is '' where nothing is missing.

    df is written once. Of its distinct ids those that aren't known are counted, and the exploded ids meet only these: as many as a task may hold are
    broadcast, so that what is known never leaves its task, and more are joined by id. One grouping by key follows.
    """
    df = written(df, "examples")
    each = F.posexplode(F.array_append(F.col(drugs), F.col(condition))).alias("pos", "id")
    unknown = written(df.select(each).select("id").distinct().join(nodes.select(F.col(node).alias("id")).distinct(), "id", "left_anti").withColumnRenamed("id", "_unknown"), "unknown-ids")
    n, widest = unknown.agg(F.count(F.lit(1)), F.coalesce(F.max(F.octet_length("_unknown")), F.lit(0))).first()
    ids = df.select(key, each, F.size(drugs).alias("n"))
    missing = ids.join(as_small(unknown, n, widest + 32), F.col("id").eqNullSafe(F.col("_unknown"))).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "id", "n"))).alias("gaps"))
    gaps = F.coalesce("gaps", F.array().cast("array<struct<pos:int,id:string,n:int>>"))
    found = df.join(missing, key, "left").withColumn("gaps", gaps)
    found = found.withColumns({
        "missing_drug_ids": F.transform(F.filter("gaps", lambda g: g["pos"] < g["n"]), lambda g: g["id"]),
        "missing_disease_id": F.get(F.transform(F.filter("gaps", lambda g: g["pos"] == g["n"]), lambda g: g["id"]), 0),
    }).drop("gaps")
    return found.withColumn("reason", F.concat_ws("+", F.when(F.size("missing_drug_ids") > 0, "missing_drug"), F.when(F.col("missing_disease_id").isNotNull(), "missing_disease")))


def filter_by_coverage(df: DataFrame, nodes: DataFrame, **names: str) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped with reasons)."""
    found = annotate(df, nodes, **names)
    return found.where("reason = ''").select(df.columns), found.where("reason <> ''")


def drop_stats(found: DataFrame) -> DataFrame:
    """One row: n_rows, n_dropped, percent_dropped (of annotate's rows)."""
    dropped = F.count_if(F.col("reason") != "")
    return found.agg(F.count(F.lit(1)).alias("n_rows"), dropped.alias("n_dropped"), (dropped / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("percent_dropped"))


def missing_prefixes(dropped: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent prefixes of missing ids, repeats counted; ties by prefix."""
    every = F.concat("missing_drug_ids", F.when(F.col("missing_disease_id").isNotNull(), F.array("missing_disease_id")).otherwise(F.array().cast("array<string>")))
    ids = dropped.select(F.explode(every).alias("id"))
    return ids.groupBy(curie_prefix(F.col("id")).alias("prefix")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "prefix").limit(k)
