"""The corpus pipeline: documents in, token digests of the documents worth training on out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run() writes
every stage's rows as Parquet in the shared folder and reads them back for the next.

Defined results of every stage: no documents give no rows; columns beside doc_id and text pass through unread, whatever their names
(the last stage leaves them out); a row whose id is null is judged by its text like any other, but is no near-duplicate; repeated rows are judged
alike. A stage's docstring says what null and empty texts, ties and very long texts give; texts are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regimen.llm import bpe, lines, neardup, overlap, quality
from regimen.llm.base import table, written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, with a score of 0.3 or more. Null counts as an empty text, which gets a score like any other; without two classes of labels the score is the smoothed share of label 1."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), usable=quality.learnable())
    return quality.classify(docs, model, 0.3).where("predicted = 1").select(docs.columns)


def rare_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten of them share; n_chars, where there is one, follows. Null becomes an empty text; a document that loses all its lines stays with an empty text; blank lines are never lost; repeated rows count as one document."""
    kept = lines.drop_common_lines(docs, min_docs=10, min_chars=1)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(docs.columns)


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, on five-word shingles with a similarity of 0.8 or more: that with the least id. Null and empty texts and rows without id all stay; rows of one id stay or go together."""
    return neardup.one_of_each(docs, size=5, similarity=(80, 100), bands=40, rows=4)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark: less than a twentieth of their words is inside a window of 13 words of an item. Null and empty texts stay; an item without id counts like any other."""
    return overlap.without_contaminated(docs, table(spark, sf_dir, "benchmark"), window=13)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document left, a row each. Null and empty texts have no tokens and the digests of nothing."""
    spec = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    coded = bpe.encode(docs.select("doc_id", "text"), spec).drop("text")
    back = bpe.decode(coded.withColumns({"n_tokens": bpe.count_ids(), "ids_sha256": F.sha2("ids", 256)}), spec).drop("ids")
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", good_documents), ("lines", rare_lines), ("near_duplicates", first_copies), ("benchmark", clean_of_benchmark), ("bpe", tokens)]
#: A fitted classifier and BPE can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
