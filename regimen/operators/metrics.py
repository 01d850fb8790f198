"""Binary classification metrics by group. Undefined metrics are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from regimen.sources.tables import written

# The buckets of drug counts.
BUCKETS = ["1", "2", "3-4", ">=5"]
METRICS = ["roc_auc", "accuracy", "sensitivity", "specificity", "f1"]


def bucket(size: Column) -> Column:
    """The bucket of a number of drugs; null, none or less has no bucket."""
    return F.when(size == 1, "1").when(size == 2, "2").when(size.between(3, 4), "3-4").when(size >= 5, ">=5")


def confusion(df: DataFrame, by: list[str] | None = None, prob: str = "prob", label: str = "label", threshold: float = 0.5) -> DataFrame:
    """n, tn, fp, fn, tp per group; a probability at the threshold is positive."""
    hit, yes = F.col(prob) >= threshold, F.col(label) == 1
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.count_if(~hit & ~yes).alias("tn"), F.count_if(hit & ~yes).alias("fp"), F.count_if(~hit & yes).alias("fn"), F.count_if(hit & yes).alias("tp"))


def rates(counts: DataFrame) -> DataFrame:
    """counts with accuracy, sensitivity, specificity, f1."""
    return counts.withColumns({
        "accuracy": F.try_divide(F.col("tp") + F.col("tn"), F.col("n")),
        "sensitivity": F.try_divide("tp", F.col("tp") + F.col("fn")),
        "specificity": F.try_divide("tn", F.col("tn") + F.col("fp")),
        "f1": F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
    })


def roc_auc(df: DataFrame, by: list[str] | None = None, prob: str = "prob", label: str = "label") -> DataFrame:
    """roc_auc per group, ties counting half; null where one class is missing.

    Rows are summed per distinct probability, and these are dealt by ranges: negatives are summed up within a range and shifted by those of
    the ranges before, a row per range and group. So no task sees all probabilities of a group.
    """
    by = by or []
    points = df.groupBy(*by, F.col(prob).alias("p")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    ranged = written(points.repartitionByRange(*by, "p").withColumn("_range", F.spark_partition_id()), "probability-ranges")
    before = lambda what, groups, order: F.coalesce(F.sum(what).over(Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = [*by, "_range"]
    shifts = ranged.groupBy(*each).agg(F.sum("neg").alias("_n")).select(*[F.col(c).alias(f"_of{i}") for i, c in enumerate(each)], before("_n", by or [F.lit(0)], "_range").alias("_shift"))
    same = [F.col(c).eqNullSafe(F.col(f"_of{i}")) for i, c in enumerate(each)]
    placed = ranged.withColumn("_own", before("neg", each, "p")).join(shifts, same, "left").withColumn("_below", F.col("_own") + F.col("_shift"))
    area = placed.withColumn("area", F.col("pos") * (F.col("_below") + F.col("neg") / 2))
    return area.groupBy(*by).agg(F.try_divide(F.sum("area"), (F.sum("pos") * F.sum("neg")).cast("double")).alias("roc_auc"))


def binary_metrics(df: DataFrame, by: list[str] | None = None, prob: str = "prob", label: str = "label", threshold: float = 0.5) -> DataFrame:
    """Counts, rates and roc_auc per group."""
    left, right = rates(confusion(df, by, prob, label, threshold)), roc_auc(df, by, prob, label)
    return left.join(right, by) if by else left.crossJoin(right)  # one row each


def bucket_metrics(df: DataFrame, length: str = "length", by: list[str] | None = None, **names) -> DataFrame:
    """binary_metrics per bucket of drug counts; every bucket is reported, an empty one with n = 0 and null metrics. Rows without a bucket are left out."""
    groups = [*(by or []), "bucket"]
    found = binary_metrics(df.withColumn("bucket", bucket(F.col(length))).where("bucket is not null"), groups, **names)
    every = F.explode(F.array(*[F.lit(b) for b in BUCKETS])).alias("bucket")
    frame = df.select(*by).distinct().select(*by, every) if by else df.sparkSession.range(1).select(every)
    return frame.join(found, groups, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "tn", "fp", "fn", "tp")})


def summarize_replicates(df: DataFrame, metrics: list[str] = METRICS, by: list[str] | None = None) -> DataFrame:
    """metric, mean, std, sem, n over the rows (replicates); null and NaN are left out, one value has std and sem 0. Where df has n (rows that a replicate was measured on), mean_n is its mean over all replicates."""
    by = by or []
    size = F.col("n") if "n" in df.columns else F.lit(None)
    long = df.select(*by, size.cast("double").alias("_size"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")).select(*by, "_size", "m.*")
    good = F.when(F.col("value").isNotNull() & ~F.isnan("value"), F.col("value"))
    out = long.groupBy(*by, "metric").agg(F.avg(good).alias("mean"), F.stddev_samp(good).alias("std"), F.count(good).alias("n"), F.avg("_size").alias("mean_n"))
    std = F.when(F.col("n") == 1, 0.0).otherwise(F.col("std"))
    return out.select(*by, "metric", "mean", std.alias("std"), F.try_divide(std, F.sqrt(F.nullif(F.col("n"), F.lit(0)).cast("double"))).alias("sem"), "n", *(["mean_n"] if "n" in df.columns else []))


def format_mean_sem(mean: Column, sem: Column) -> Column:
    return F.format_string("%.4f±%.4f", mean, sem)


def best_run(df: DataFrame, score: str = "roc_auc", run: str = "run") -> DataFrame:
    """The row of the run with the largest score; null and NaN are left out, ties go to the least run."""
    good = df.where(F.col(score).isNotNull() & ~F.isnan(score))
    return good.orderBy(F.desc(score), run).limit(1)


def parse_lines(df: DataFrame, line: str = "line", key: str = "run") -> DataFrame:
    """key, metric, value from texts like `Test | auc=0.9 | acc=0.8`; a value that is no number is null."""
    parts = F.filter(F.transform(F.split(F.col(line), r" *\| *"), lambda x: F.split(F.trim(x), "=", 2)), lambda x: F.size(x) == 2)
    pairs = df.select(key, F.explode(parts).alias("kv"))
    return pairs.select(key, F.trim(F.get("kv", F.lit(0))).alias("metric"), F.trim(F.get("kv", F.lit(1))).try_cast("double").alias("value"))


def compare_runs(left: DataFrame, right: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """metric, baseline, refined, delta of two metric tables; metrics of one table only stay."""
    a, b = left.select(metric, F.col(value).alias("baseline")), right.select(metric, F.col(value).alias("refined"))
    return a.join(b, metric, "full").withColumn("delta", F.col("refined") - F.col("baseline"))


def append_results(done: DataFrame, new: DataFrame, run: str = "run_name") -> DataFrame:
    """done with the runs of new that it lacks; columns are united."""
    return done.unionByName(new.join(done.select(run).distinct(), run, "left_anti"), allowMissingColumns=True)
