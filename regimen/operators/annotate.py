"""Annotation by a paid batch classifier that is never asked twice for an answer that was committed.

Requests are dealt to the calls by the hash of key and request, and cut into batches of bounded size in the order of a seeded hash, so their texts are shuffled once.
A batch is named by the hash of its keys and requests, and its answers are one file under that name in a shared folder: written under another name, then moved. A task that runs again after an executor was
lost finds the files of the batches that it had done and asks only for the rest; so does a later run, which leaves out every request that has an
answer, whatever batches it stood in. Only batches in flight when a task dies can be asked for again.

The result is read from the files, so further actions on it ask for nothing.

Defined results: rows with a null key or request are left out; repeated (key, request) rows are asked once; a batch that fails after all retries gives
rows with its error, is not committed, and is asked again by the next run.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regimen.operators import mechanism
from regimen.operators.sample import seeded
from regimen.sources.log import KeyedLog
from regimen.sources.tables import children, written

#: A row of an answer file.
ANSWER = "batch string, key string, asked string, payload string"


def _files(path: str):
    """The file system and path as executors reach them, with nothing of the JVM."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:/", "file:///", 1))


def commit_batch(path: str, batch: str, rows: list[dict]) -> None:
    """Writes the answers of a batch unless they are there."""
    files, where = _files(path)
    files.create_dir(where, recursive=True)
    own = f"{where}/_{batch}-{uuid.uuid4().hex}"
    with files.open_output_stream(own) as out:
        out.write("".join(json.dumps(r) + "\n" for r in rows).encode())
    if is_committed(path, batch):
        files.delete_file(own)
    else:
        files.move(own, f"{where}/{batch}.json")


def is_committed(path: str, batch: str) -> bool:
    from pyarrow import fs

    files, where = _files(path)
    return files.get_file_info(f"{where}/{batch}.json").type == fs.FileType.File


def answers(spark: SparkSession, path: str) -> DataFrame | None:
    """key, asked (hash of the request, as bytes), payload of all committed batches, None if there are none; of a repeated answer the one of the least batch."""
    if not any(n.endswith(".json") for n in children(spark, path)):
        return None
    rows = spark.read.schema(ANSWER).json(path).select("key", F.unhex("asked").alias("asked"), "payload", F.unhex("batch").alias("batch"))
    return rows.groupBy("key", "asked").agg(F.min_by("payload", "batch").alias("payload"))


def dealt(requests: DataFrame, rest: DataFrame, partitions: int, seed: int = 13) -> DataFrame:
    """key, request, asked (as hex) of the requests in rest, in partitions that depend on the rows alone, each in the order of a seeded hash: the one shuffle of the texts."""
    here = requests.repartition(partitions, "key", "asked").join(rest.repartition(partitions, "key", "asked").hint("shuffle_hash"), ["key", "asked"], "left_semi")
    named = here.select("key", "request", F.lower(F.hex("asked")).alias("asked"))
    return named.withColumn("_order", seeded(F.concat_ws("|", "key", "asked"), seed)).sortWithinPartitions("_order", "key", "asked").drop("_order")


def batches(frames: Iterator[pd.DataFrame], size: int) -> Iterator[tuple[str, list[dict]]]:
    """Name and rows of the batches of a sorted partition, all of size rows but the last; repeated rows stand once."""
    rows, last = [], None
    for frame in frames:
        for row in frame.to_dict("records"):
            if (row["key"], row["asked"]) != last:
                last = row["key"], row["asked"]
                rows.append(row)
            if len(rows) == size:
                yield _name(rows), rows
                rows = []
    if rows:
        yield _name(rows), rows


def _name(rows: list[dict]) -> str:
    return hashlib.sha256(json.dumps([[r["key"], r["asked"]] for r in rows]).encode()).hexdigest()


def annotate_once(todo: DataFrame, classify: Callable[[list[str]], list[str]], path: str, size: int = 32, retries: int = 3, wait: float = 1.0, partitions: int = 8, key: str = "example_key", request: str = "request") -> DataFrame:
    """key, payload, error of each (key, request) of todo, answered now or before. partitions bounds the parallel calls; a failed call is tried again after wait seconds, twice as many, and so on."""
    spark = todo.sparkSession
    texts = written(todo.where(F.col(key).isNotNull() & F.col(request).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(request).alias("request")), "requests")
    texts = texts.withColumn("asked", F.unhex(F.sha2("request", 256)))
    asked, before = written(texts.select("key", "asked").distinct(), "asked"), answers(spark, path)
    rest = asked if before is None else asked.join(before.select("key", "asked"), ["key", "asked"], "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, rows in batches(frames, size):
            if is_committed(path, batch):
                continue
            for attempt in range(retries):
                try:
                    found = list(classify([r["request"] for r in rows]))
                    if len(found) != len(rows):
                        raise ValueError(f"{len(found)} answers to {len(rows)} requests")
                except Exception as e:  # the last failure becomes rows
                    if attempt + 1 < retries:
                        time.sleep(wait * 2**attempt)
                    else:
                        yield pd.DataFrame({"key": [r["key"] for r in rows], "asked": [r["asked"] for r in rows], "error": [f"{type(e).__name__}: {e}"] * len(rows)})
                else:
                    commit_batch(path, batch, [{"batch": batch, "key": r["key"], "asked": r["asked"], "payload": p} for r, p in zip(rows, found)])
                    break

    failed = written(dealt(texts, rest, partitions).mapInPandas(run, "key string, asked string, error string"), "failures")
    failed, now = failed.select("key", F.unhex("asked").alias("asked"), "error"), answers(spark, path)
    done = asked.withColumn("payload", F.lit(None).cast("string")) if now is None else asked.join(now, ["key", "asked"], "left")
    if not failed.isEmpty():
        done = done.join(failed, ["key", "asked"], "left")
    else:
        done = done.withColumn("error", F.lit(None).cast("string"))
    return done.select(F.col("key").alias(key), "payload", F.when(F.col("payload").isNull(), F.coalesce("error", F.lit("no answer"))).alias("error"))


def annotate_with_log(df: DataFrame, classify: Callable[[list[str]], list[str]], log: KeyedLog, path: str, model: str, version: str, key: str = "example_key", request: str = "request", force: bool = False, **params) -> DataFrame:
    """key, category, confidence, rationale_short, needs_human_review, error of every row of df: from the log where it has the key for this model and version, else asked, checked and appended to the log. force asks for all rows."""
    keyed = df.select(key, request).withColumn("cache_key", mechanism.cache_key(F.col(key), version, model))
    todo, path = (keyed, f"{path}/forced-{uuid.uuid4().hex}") if force else (log.unknown(keyed) if log.manifest()["appends"] else keyed, path)
    found = annotate_once(todo, classify, path, key=key, request=request, **params)
    checked = written(mechanism.validate_payloads(found.where("error is null")), "checked")
    fields = ["category", "confidence", "rationale_short", "needs_human_review"]
    good = checked.where("error is null").select(mechanism.cache_key(F.col(key), version, model).alias("cache_key"), F.col(key).cast("string").alias("example_key"), F.lit(version).alias("prompt_version"), F.lit(model).alias("model"), F.struct(*fields).alias("classification"))
    if not good.isEmpty():
        log.append(good)
    bad = checked.where("error is not null").select(key, "error").unionByName(found.where("error is not null").select(key, "error"))
    bad = bad.groupBy(key).agg(F.min("error").alias("error"))
    last = log.snapshot().select("cache_key", "classification")
    joined = keyed.select(key, "cache_key").distinct().join(last, "cache_key", "left").join(bad, key, "left")
    return joined.select(key, *[F.col("classification")[c].alias(c) for c in fields], F.when(F.col("classification").isNull(), F.col("error")).alias("error"))


#: Columns of a log of annotations.
LOG_SCHEMA = "cache_key string, example_key string, prompt_version string, model string, classification struct<category:string,confidence:double,rationale_short:string,needs_human_review:boolean>"
