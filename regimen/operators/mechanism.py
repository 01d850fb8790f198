"""Mechanism annotations of examples: requests, payloads, cache, labels, refined ground truth."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regimen.functions import text as X
from regimen.operators.pairs import dedupe

# The categories and the longest rationale.
CATEGORIES = ["common_comorbidity", "mechanistically_synergistic", "other", "side_effect_relief"]
RATIONALE_CHARS = 600

HEADER = "Which mechanism joins the drugs of this combination to the disease?"
FOOTER = "Answer with one JSON object of the fields category, confidence, rationale_short and needs_human_review."


def check_categories(categories: list[str]) -> list[str]:
    """The list, if all are known categories and there is one."""
    if not categories or (unknown := sorted(set(c.strip() for c in categories) - set(CATEGORIES))):
        raise ValueError(f"unknown categories {unknown if categories else 'none given'}; known are {CATEGORIES}")
    return [c.strip() for c in categories]


def condition_label(columns: list[str], names: tuple[str, ...] = ("condition_id_norm_norm_label", "condition_id_norm_label")) -> Column:
    """The first non-blank of the label columns that are there, trimmed, else ''."""
    there = [F.nullif(F.trim(F.col(c)), F.lit("")) for c in names if c in columns]
    return F.coalesce(*there, F.lit(""))


def resolve_label(df: DataFrame) -> DataFrame:
    """df with label (int) from source_label_binary, else from label."""
    for name in ("source_label_binary", "label"):
        if name in df.columns:
            return df.withColumn("label", F.col(name).try_cast("int"))
    raise ValueError(f"no label column among {df.columns}")


def load_combined(*sources: tuple[DataFrame, str]) -> DataFrame:
    """Rows of several sources with source_file and source_rank, in the order given."""
    tagged = [df.withColumns({"source_file": F.lit(name), "source_rank": F.lit(i)}) for i, (df, name) in enumerate(sources)]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def unique_examples(df: DataFrame, order: list[str], key: str = "example_key") -> DataFrame:
    """The first row per key in the order given. Aggregated with map-side combine, so a hot key is no large group."""
    rest = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first"))
    return first.select(key, "first.*").select(df.columns)


def cache_key(key: Column, version: str, model: str) -> Column:
    return F.concat_ws("::", key, F.lit(version), F.lit(model))


def request_text(df: DataFrame, drugs: str = "drug_set", condition: str = "condition_id_norm", label: str = "source_label_binary", source: str = "source_file", header: str = HEADER, footer: str = FOOTER, drug_labels: str | None = None, condition_name: str | None = None) -> DataFrame:
    """df with request: a line per field; the optional fields have a line only where they aren't empty."""
    line = lambda name, value: F.concat(F.lit(f"- {name}: "), value)
    optional = [line(name, F.nullif(F.col(c).cast("string"), F.lit(""))) for name, c in (("drug_labels", drug_labels), ("condition_label", condition_name)) if c]
    lines = [F.lit(header), line("disease_id", F.col(condition)), line("drug_ids", X.format_list(F.col(drugs))), line("source_label_binary", F.col(label).cast("string")), line("source_file", F.col(source)), *optional, F.lit(footer)]
    return df.withColumn("request", F.concat_ws("\n", *lines))


def validate_payloads(df: DataFrame, payload: str = "payload") -> DataFrame:
    """df with category, confidence, rationale_short, needs_human_review and error: null where the payload fits the rules, else what is wrong first.

    The types are those of the JSON values: a flag in quotes is no boolean, and a category has to be a string.
    """
    kind = lambda name: F.schema_of_variant(F.try_variant_get("_v", f"$.{name}", "variant"))
    value = lambda name, as_: F.try_variant_get("_v", f"$.{name}", as_)
    df = df.withColumn("_v", F.try_parse_json(F.col(payload)))
    rationale = F.when(kind("rationale_short") == "STRING", F.substring(F.trim(value("rationale_short", "string")), 1, RATIONALE_CHARS))
    category, confidence = F.when(kind("category") == "STRING", value("category", "string")), value("confidence", "double")
    df = df.withColumns({"_category": category, "_confidence": confidence, "_rationale": rationale, "_flag": F.when(kind("needs_human_review") == "BOOLEAN", value("needs_human_review", "boolean"))})
    error = (
        F.when(F.col("_v").isNull() | ~F.schema_of_variant("_v").startswith("OBJECT"), "malformed")
        .when(F.col("_category").isNull() | ~F.col("_category").isin(CATEGORIES), "category")
        .when(F.col("_confidence").isNull() | F.isnan("_confidence") | (F.col("_confidence") < 0) | (F.col("_confidence") > 1), "confidence")
        .when(F.coalesce("_rationale", F.lit("")) == "", "rationale")
        .when(F.col("_flag").isNull(), "needs_human_review")
    )
    out = df.withColumn("error", error)
    ok = lambda name: F.when(F.col("error").isNull(), F.col(name))
    return out.withColumns({"category": ok("_category"), "confidence": ok("_confidence"), "rationale_short": ok("_rationale"), "needs_human_review": ok("_flag")}).drop("_v", "_category", "_confidence", "_rationale", "_flag")


CACHE_SCHEMA = "cache_key string, example_key string, prompt_version string, model string, classification struct<category:string,confidence:double,rationale_short:string,needs_human_review:boolean>, _corrupt string"


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The last well-formed JSON line per cache_key; blank and malformed lines are passed over.

    The last line is that with the greatest sequence, which append_cache writes; of lines of one sequence, or without any (which count as
    older), that of the later file, by its time, then its name, and in a file the later line. The sizes of the files and how Spark packs them don't matter.
    """
    file = F.col("_metadata")
    at = F.struct(file["file_modification_time"].alias("time"), file["file_path"].alias("file"), file["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(path).select(F.trim("value").alias("line"), at.alias("at")).where("line <> ''")
    rows = lines.select("at", F.from_json("line", CACHE_SCHEMA + ", sequence bigint", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")).where("r._corrupt is null and r.cache_key is not null and r.classification is not null")
    last = F.max_by(F.struct("r.example_key", "r.prompt_version", "r.model", "r.classification"), F.struct(F.coalesce("r.sequence", F.lit(-1)), "at"))
    return rows.groupBy("r.cache_key").agg(last.alias("last")).select("cache_key", "last.*")


def append_cache(rows: DataFrame, path: str, sequence: int | None = None) -> None:
    """Appends rows as JSON lines with their sequence: nanoseconds of the driver's clock, unless it is given."""
    rows.drop("sequence").withColumn("sequence", F.lit(time.time_ns() if sequence is None else sequence).cast("bigint")).write.mode("append").json(path)


def partition_cached(df: DataFrame, cache: DataFrame, force: bool = False, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """(rows with a cached annotation, rows to do); force: all are to do."""
    if force:
        return df.limit(0), df
    keys = cache.select(key).distinct()
    return df.join(keys, key, "left_semi"), df.join(keys, key, "left_anti")


def annotate(todo: DataFrame, classify: Callable[[list[str]], list[str]], partitions: int = 8, key: str = "example_key", request: str = "request") -> DataFrame:
    """example_key, payload, error: the answers of a batch classifier; a failed batch gives rows with its error. partitions bounds the parallel calls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                answers, error = list(classify(batch[request].tolist())), None
            except Exception as e:  # a failure is a row
                answers, error = [None] * len(batch), f"{type(e).__name__}: {e}"
            yield pd.DataFrame({key: batch[key], "payload": answers, "error": [error] * len(batch)})

    return todo.select(key, request).repartition(partitions).mapInPandas(run, f"{key} string, payload string, error string")


def attach(df: DataFrame, annotations: DataFrame, model: str, version: str, key: str = "example_key", order: list[str] | None = None) -> DataFrame:
    """Every row of df with its key's annotation (null if there is none), the model, version and a UTC time stamp. Of several annotations of a key the first by order counts (else the least by all columns)."""
    own = F.struct(F.col("category").alias("mechanism_category"), F.col("confidence").alias("mechanism_confidence"), "needs_human_review", "rationale_short")
    one = annotations.groupBy(key).agg(F.min_by(own, F.struct(*order) if order else own).alias("_one")).select(key, "_one.*")
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return df.join(one, key, "left").withColumns({"llm_model": F.lit(model), "prompt_version": F.lit(version), "classified_at_utc": stamp})


def read_labeled(spark: SparkSession, path: str) -> DataFrame:
    """A stored mechanism-labelled CSV with confidence and flag cast; what can't be cast is null."""
    raw = spark.read.options(header=True, multiLine=True, escape='"', inferSchema=False).csv(path)
    return resolve_label(raw).withColumns({"drug_set": X.parse_list(F.col("drug_set"))["items"], "mechanism_confidence": F.col("mechanism_confidence").try_cast("double"), "needs_human_review": F.col("needs_human_review").try_cast("boolean")})


def summarize(df: DataFrame, category: str = "mechanism_category", confidence: str = "mechanism_confidence", review: str = "needs_human_review", error: str = "error") -> DataFrame:
    """One row: n_rows (annotated rows), n_failures (rows with an error, where df has such a column), and of the annotated rows mean, median, least and largest confidence and review_rate."""
    failed = F.count_if(F.col(error).isNotNull()) if error in df.columns else F.lit(0).cast("bigint")
    known = F.col(category).isNotNull()
    confidence, review = F.when(known, F.col(confidence)), F.when(known, F.col(review))
    return df.agg(F.count_if(known).alias("n_rows"), failed.alias("n_failures"), F.avg(confidence).alias("mean"), F.median(confidence).alias("median"), F.min(confidence).alias("least"), F.max(confidence).alias("largest"), F.avg(review.cast("int")).alias("review_rate"))


def category_counts(df: DataFrame, category: str = "mechanism_category") -> DataFrame:
    return df.where(F.trim(category) != "").groupBy(F.col(category).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def _steps(keep: list[str], least: float, drop_review: bool) -> tuple[Column, Column, Column]:
    a = F.coalesce(F.col("mechanism_category").isin(check_categories(keep)), F.lit(False))
    b = a & F.coalesce(F.col("mechanism_confidence") >= least, F.lit(False))
    return a, b, b & ~F.coalesce(F.col("needs_human_review"), F.lit(True)) if drop_review else b


def refine(df: DataFrame, keep: list[str], least: float = 0.6, drop_review: bool = True) -> DataFrame:
    """Deduplicated drug_set, condition_id_norm, label of the rows of kept categories, at least as confident, not up for review. A row without a review flag counts as up for review."""
    return dedupe(df.where(_steps(keep, least, drop_review)[2])).select("drug_set", "condition_id_norm", "label")


def refinement_report(df: DataFrame, keep: list[str], least: float = 0.6, drop_review: bool = True) -> DataFrame:
    """One row: rows left after each step, and rows and labels after deduplication. The steps are counted in one pass."""
    a, b, c = _steps(keep, least, drop_review)
    counts = df.agg(F.count(F.lit(1)).alias("n_input"), F.count_if(a).alias("n_category"), F.count_if(b).alias("n_confidence"), F.count_if(c).alias("n_review"))
    final = refine(df, keep, least, drop_review).agg(F.count(F.lit(1)).alias("n_final"), F.count_if(F.col("label") == 1).alias("n_indications"), F.count_if(F.col("label") == 0).alias("n_contraindications"))
    return counts.crossJoin(final)  # one row each


def to_training_schema(df: DataFrame) -> DataFrame:
    """primary_drug_id_norm (first drug), secondary_drug_id_norm (the rest), condition_id_norm; an empty drug set is an error."""
    checked = F.when(F.size("drug_set") > 0, F.col("drug_set")).otherwise(F.raise_error(F.lit("an example without drugs")).cast("array<string>"))
    return df.select(F.slice(checked, 1, 1).alias("primary_drug_id_norm"), F.slice("drug_set", 2, 1 << 30).alias("secondary_drug_id_norm"), "condition_id_norm")


def split_by_label(df: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(indications, contraindications), each with the full schema even if empty."""
    return df.where(F.col(label) == 1), df.where(F.col(label) == 0)
