"""Views of the given tables in the shapes that the operators work on. Every view is derived from whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regimen.functions import text as X
from regimen.operators import embed, kg, pairs
from regimen.sources.tables import n_partitions

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs_raw(spark: SparkSession, sf_dir: str, ordered: bool = True) -> DataFrame:
    """row_id, primary and secondary ids as list literals, condition_id_norm, label, source_file of each order. Suppliers stand for drugs, so that ids and keys grow with the tables, and orders still repeat. ordered: the ids stand in the order of the lines; where it doesn't count, only they are shuffled."""
    by = LINE_ORDER if ordered else ["l_suppkey"]
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *by)
    small = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*by))).alias("ls"))  # an order has few lines
    ids = small.select("l_orderkey", F.transform("ls", lambda x: F.concat(F.lit("DRUG:"), x["l_suppkey"].cast("string"))).alias("ids"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return ids.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("row_id"),
        X.format_list(F.slice("ids", 1, 1)).alias("primary_drug_id_norm"),
        X.format_list(F.slice("ids", 2, 1 << 30)).alias("secondary_drug_id_norm"),
        F.concat(F.lit("COND:"), (F.col("o_custkey") % 25).cast("string")).alias("condition_id_norm"),
        F.when(urgent, 0).otherwise(1).alias("label"),
        F.when(urgent, "contraindications").otherwise("indications").alias("source_file"),
    )


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, drug_set, condition_id_norm, label, source_file, example_key of all pairs, parsed and united; a drug set has an order of its own."""
    raw = pairs_raw(spark, sf_dir, ordered=False)
    # a row of its own for the one list of items: filters on it are not pushed below the parsing, which they would repeat many times a row
    items = F.concat(X.parse_plain_list(F.col("primary_drug_id_norm")), X.parse_plain_list(F.col("secondary_drug_id_norm")))
    parsed = raw.select("*", F.explode(F.array(items)).alias("_items")).withColumn("drug_set", X.drug_set(F.col("_items")))
    return pairs.with_key(pairs.valid_rows(parsed)).select("row_id", "drug_set", "condition_id_norm", "label", "source_file", "example_key")


def deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (drug_set, condition_id_norm) with its example_key."""
    return pairs.with_key(pairs.dedupe(examples(spark, sf_dir))).select("example_key", "drug_set", "condition_id_norm", "label")


def known_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of the examples whose number isn't divisible by 7."""
    return pairs.required_nodes(examples(spark, sf_dir)).where(F.substring_index("id", ":", -1).cast("int") % 7 != 0)


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, predicate, object: parts and their suppliers. Repeated ones go by their numbers, in tasks that don't grow with the table."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("predicate"))
    once = lines.repartition(n_partitions(spark, lines.count()), "l_partkey", "l_suppkey").distinct()
    return once.select(F.concat(F.lit("PART:"), F.col("l_partkey").cast("string")).alias("subject"), "predicate", F.concat(F.lit("SUPP:"), F.col("l_suppkey").cast("string")).alias("object"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kg.clean_edges(kg.normalize_edges(raw_edges(spark, sf_dir)))


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, category of parts (their type) and suppliers (their nation); some are null in the source."""
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("PART:"), F.col("p_partkey").cast("string")).alias("id"), F.when(F.col("p_partkey") % 11 != 0, F.col("p_type")).alias("category"))
    named = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    supplier = named.select(F.concat(F.lit("SUPP:"), F.col("s_suppkey").cast("string")).alias("id"), F.when(F.col("s_suppkey") % 13 != 0, F.col("n_name")).alias("category"))
    return kg.node_categories(part.unionByName(supplier))


def node_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, pca_embedding, topological_embedding, some of the latter null."""
    prefix = F.element_at(F.array(F.lit("CHEBI"), F.lit("MONDO"), F.lit("UNII")), F.pmod(F.col("label"), F.lit(3)) + 1)
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.concat_ws(":", prefix, F.col("vec_id").cast("string")).alias("id"), F.slice("embedding", 1, 32).alias("pca_embedding"), F.when(F.col("vec_id") % 9 != 0, F.slice("embedding", 33, 32)).alias("topological_embedding"), "vec_id")


def entity_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, vector: every embedding as that of the drug and of the disease with its number."""
    vectors = embed.select_embedding(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("pca_embedding")), "pca")
    both = F.explode(F.array(F.concat(F.lit("DRUG:"), "id"), F.concat(F.lit("COND:"), "id")))
    return vectors.select(both.alias("id"), "vector")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, label, prob (rounded, so there are ties), length, replicate."""
    prob = F.least(F.floor(F.col("value") / 5) / 100, F.lit(1.0))
    return table(spark, sf_dir, "events").select("event_id", (F.col("event_type") == "purchase").cast("int").alias("label"), prob.alias("prob"), (F.col("user_id") % 7).cast("int").alias("length"), (F.col("user_id") % 5).cast("int").alias("replicate"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """example_key, payload (JSON text, some of it unfit) of the labelled documents."""
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    kind, doc = F.col("doc_id") % 10, F.col("doc_id")
    category = F.when(kind == 0, "unknown").otherwise(F.element_at(F.array(*[F.lit(c) for c in ("common_comorbidity", "mechanistically_synergistic", "other", "side_effect_relief")]), (doc % 4 + 1).cast("int")))
    confidence = F.when(kind == 2, "1.5").otherwise(F.concat(F.lit("0."), F.lpad((doc % 100).cast("string"), 2, "0")))
    flag = F.when(kind == 3, '"yes"').when(F.col("toxic") == 1, "true").otherwise("false")
    text = F.concat(F.lit('{"category": "'), category, F.lit('", "confidence": '), confidence, F.lit(', "rationale_short": "  '), "source", F.lit(" "), "lang", F.lit(' ", "needs_human_review": '), flag, F.lit("}"))
    return joined.select(F.concat(F.lit("DOC:"), doc.cast("string")).alias("example_key"), F.when(kind == 1, F.concat(F.lit("no json "), doc.cast("string"))).otherwise(text).alias("payload"))


def labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The examples with mechanism annotations made from their row ids."""
    row = F.col("row_id")
    category = F.element_at(F.array(*[F.lit(c) for c in ("common_comorbidity", "mechanistically_synergistic", "other", "side_effect_relief")]), (row % 4 + 1).cast("int"))
    return examples(spark, sf_dir).withColumns({"mechanism_category": F.when(row % 29 != 0, category), "mechanism_confidence": F.round(row % 61 / 60, 2), "needs_human_review": F.when(row % 23 != 0, row % 9 == 0)})
