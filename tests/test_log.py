"""The keyed log, the JSON cache and annotation that asks once."""

from __future__ import annotations

import os
import threading

import pytest
from pyspark.sql import functions as F

from regimen.operators import annotate, mechanism
from regimen.sources import tables
from regimen.sources.log import KeyedLog

SCHEMA = "k string, v int, note string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def last(log) -> dict:
    return {r.k: (r.v, r.note) for r in log.snapshot().collect()}


def test_last_append_wins_whatever_the_sizes(spark, tmp_path):
    log = KeyedLog(spark, str(tmp_path / "log"), "k", SCHEMA, buckets=4)
    assert last(log) == {}
    many = [(f"k{i}", 1, "first") for i in range(2000)]
    log.append(frame(spark, many))
    log.append(frame(spark, [("k7", 2, None), ("new", 2, "x")]))
    log.append(frame(spark, [(f"k{i}", 3, "large") for i in range(1000, 2000)]).repartition(7))
    log.append(frame(spark, [("k1500", 4, "small")]))
    want = {k: (v, n) for k, v, n in many} | {"k7": (2, None), "new": (2, "x")} | {f"k{i}": (3, "large") for i in range(1000, 2000)} | {"k1500": (4, "small")}
    assert last(log) == want
    assert log.compact() and last(log) == want
    log.append(frame(spark, [("k7", 5, "after")]))
    assert last(KeyedLog(spark, str(tmp_path / "log"), "k", SCHEMA)) == want | {"k7": (5, "after")}
    assert log.compact() and log.compact() and last(log) == want | {"k7": (5, "after")}
    assert len([n for n in os.listdir(tmp_path / "log") if n.startswith("version-")]) == 2


def test_log_of_odd_rows(spark, tmp_path):
    log = KeyedLog(spark, str(tmp_path / "log"), "k", SCHEMA, buckets=3)
    log.append(frame(spark, []))
    log.append(frame(spark, [("a", 1, "z"), ("a", 2, "b"), ("a", 2, "b")]), order=["v"])
    assert last(log) == {"a": (2, "b")}
    with pytest.raises(Exception, match="without key"):
        log.append(frame(spark, [(None, 1, "x")]))
    assert last(log) == {"a": (2, "b")}
    with pytest.raises(ValueError, match="other columns"):
        KeyedLog(spark, str(tmp_path / "log"), "k", "k string, v bigint")
    rows = frame(spark, [("a", 0, ""), (None, 0, ""), ("b", 0, "")])
    assert [r.k for r in log.known(rows).collect()] == ["a"] and {r.k for r in log.unknown(rows).collect()} == {None, "b"}


def test_appends_without_a_manifest_are_not_read(spark, tmp_path, monkeypatch):
    """A writer that dies after its files, and two that write at a time."""
    log = KeyedLog(spark, str(tmp_path / "log"), "k", SCHEMA, buckets=2)
    log.append(frame(spark, [("a", 1, "")]))
    with monkeypatch.context() as m:
        m.setattr("regimen.sources.log.write_once", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            log.append(frame(spark, [("a", 9, "lost"), ("b", 9, "lost")]))
    assert last(log) == {"a": (1, "")}
    other = KeyedLog(spark, str(tmp_path / "log"), "k", SCHEMA)
    writers = [threading.Thread(target=x.append, args=(frame(spark, [("a", 2 + i, ""), (f"w{i}", i, "")]),)) for i, x in enumerate((log, other))]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert {k for k in last(log)} == {"a", "w0", "w1"} and log.manifest()["sequence"] == 3


def test_the_log_is_not_shuffled(spark, tmp_path):
    log = KeyedLog(spark, str(tmp_path / "log"), "k", SCHEMA, buckets=4)
    for i in range(3):
        log.append(frame(spark, [(f"k{j}", i, "") for j in range(50)]))
    plan = log.snapshot()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    rows = frame(spark, [(f"k{j}", 0, "") for j in range(40, 60)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for joined, n in ((log.known(rows), 10), (log.unknown(rows), 10)):
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1 and joined.count() == n
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def line(spark, key, category):
    return spark.createDataFrame([(key, "e", "v", "m", (category, 0.5, "r", False))], "cache_key string, example_key string, prompt_version string, model string, classification struct<category:string,confidence:double,rationale_short:string,needs_human_review:boolean>")


@pytest.mark.parametrize("large_first", [True, False])
def test_json_cache_takes_the_last_append(spark, tmp_path, large_first):
    path = str(tmp_path / "cache")
    large = line(spark, "k", "side_effect_relief").union(spark.range(3000).select(F.concat(F.lit("x"), "id").alias("cache_key"), *[F.lit(c).alias(c) for c in ("e", "v", "m")], F.struct(F.lit("other").alias("category"), F.lit(0.5).alias("confidence"), F.lit("r" * 50).alias("rationale_short"), F.lit(False).alias("needs_human_review")))).coalesce(1)
    both = [(large, "side_effect_relief"), (line(spark, "k", "other"), "other")]
    for rows, _ in both if large_first else both[::-1]:
        mechanism.append_cache(rows, path)
    want = both[1 if large_first else 0][1]
    assert [r.classification.category for r in mechanism.read_cache(spark, path).where("cache_key = 'k'").collect()] == [want]


def test_plain_lines_come_before_numbered_ones(spark, tmp_path):
    text = '{"cache_key": "%s", "example_key": "k", "prompt_version": "v1", "model": "m", "classification": {"category": "%s", "confidence": 0.1, "rationale_short": "a", "needs_human_review": false}%s}\n'
    (tmp_path / "a.jsonl").write_text(text % ("k", "new", ', "sequence": 1') + text % ("k", "old", "") + text % ("l", "one", "") + text % ("l", "two", ""))
    assert {r.cache_key: r.classification.category for r in mechanism.read_cache(spark, str(tmp_path / "a.jsonl")).collect()} == {"k": "new", "l": "two"}


# Annotation


def counting(folder, fail_after: int | None = None):
    """A classifier that notes every call in a file; with fail_after its process dies in the call after so many, once."""

    def classify(requests):
        calls = len(os.listdir(folder))
        with open(f"{folder}/{calls}-{os.getpid()}-{abs(hash(tuple(requests)))}", "w") as f:
            f.write("\n".join(requests))
        if fail_after is not None and calls == fail_after and not os.path.exists(f"{folder}-died"):
            open(f"{folder}-died", "w").close()
            os.remove(f"{folder}/{calls}-{os.getpid()}-{abs(hash(tuple(requests)))}")  # this call wasn't answered
            os._exit(1)
        return [r.upper() for r in requests]

    return classify


def asked(folder) -> list[str]:
    return sorted(r for name in os.listdir(folder) for r in open(f"{folder}/{name}").read().split("\n"))


def test_no_batch_is_asked_twice_after_a_lost_task(tmp_path):
    """In a session that runs a failed task again: the Python worker dies in its fourth call."""
    import subprocess
    import sys

    calls = tmp_path / "calls"
    calls.mkdir()
    code = f"""
import sys
sys.path[:0] = {[os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]!r}
from pyspark.sql import SparkSession
from pyspark import cloudpickle
import tests.test_log as t
cloudpickle.register_pickle_by_value(t)
from regimen.operators import annotate
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).getOrCreate()
todo = spark.createDataFrame([(f"k{{i}}", f"q{{i}}") for i in range(50)], "example_key string, request string")
rows = annotate.annotate_once(todo, t.counting({str(calls)!r}, 3), {str(tmp_path / "answers")!r}, size=5, partitions=1)
assert sorted((r.example_key, r.payload, r.error) for r in rows.collect()) == sorted((f"k{{i}}", f"Q{{i}}", None) for i in range(50))
rows.count()
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert os.path.exists(f"{calls}-died") and asked(calls) == sorted(f"q{i}" for i in range(50))


def test_a_later_run_asks_only_for_what_is_new(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    todo = spark.createDataFrame([(f"k{i}", f"q{i}") for i in range(20)] + [(None, "q"), ("k", None), ("k1", "q1")], "example_key string, request string")
    path = str(tmp_path / "answers")
    assert annotate.annotate_once(todo.where("example_key < 'k15'"), counting(str(calls)), path, size=3).count() == 7
    rows = annotate.annotate_once(todo, counting(str(calls)), path, size=4)
    assert rows.count() == 20 and rows.where("error is not null").isEmpty() and asked(calls) == sorted(f"q{i}" for i in range(20))
    failed = annotate.annotate_once(todo.withColumn("request", F.concat("request", F.lit("?"))), lambda r: r[1:], path, size=4, retries=2, wait=0.0)
    assert failed.count() == 20 and all("answers to" in r.error and r.payload is None for r in failed.collect())
    again = annotate.annotate_once(todo.withColumn("request", F.concat("request", F.lit("?"))), lambda r: r, path, size=4)
    assert again.where("error is null").count() == 20


def test_annotation_with_the_log(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    log = KeyedLog(spark, str(tmp_path / "log"), "cache_key", annotate.LOG_SCHEMA, buckets=2)
    good = '{"category": "other", "confidence": 0.5, "rationale_short": "r", "needs_human_review": false}'
    ask = counting(str(calls))
    classify = lambda requests: [good if r.startswith("Q") else "no json" for r in ask(requests)]
    df = spark.createDataFrame([("k1", "q1"), ("k2", "x2")], "example_key string, request string")
    run = lambda rows, **more: {r.example_key: (r.category, r.error) for r in annotate.annotate_with_log(rows, classify, log, str(tmp_path / "answers"), "m", "v", **more).collect()}
    assert run(df) == {"k1": ("other", None), "k2": (None, "malformed")} == run(df)
    assert asked(calls) == ["q1", "x2"] and log.rows().count() == 1
    assert run(df, force=True) == {"k1": ("other", None), "k2": (None, "malformed")} and len(asked(calls)) == 4 and log.rows().count() == 2


def test_small_files_are_written_once(spark, tmp_path):
    path = str(tmp_path / "a/b.json")
    assert tables.read_json(spark, path) is None and tables.write_once(spark, path, {"x": 1}) and not tables.write_once(spark, path, {"x": 2})
    assert tables.read_json(spark, path) == {"x": 1} and [n for n in tables.children(spark, str(tmp_path / "a")) if n[0] != "."] == ["b.json"]
