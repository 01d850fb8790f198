"""What the findings of round 3 by growth were about: no task, shuffle or table that grows faster than the input."""

from __future__ import annotations

import os

import pandas as pd

from regimen.operators import annotate, encode, kg, khop
from regimen.plans import queries as core
from regimen.plans import testbed as V
from regimen.sources import tables

SMALL = "/root/testdata/sf0.001"


def test_no_task_takes_all_edges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 500)
    assert V.edges(spark, SMALL).rdd.getNumPartitions() >= 12
    core._parts_of_edges(spark, SMALL, str(tmp_path / "edges"))
    sizes = [spark.read.parquet(f"{tmp_path}/edges/{n}").count() for n in os.listdir(tmp_path / "edges") if n.endswith(".parquet")]
    assert len(sizes) >= 12 and max(sizes) < sum(sizes) / 4 and sum(sizes) == V.edges(spark, SMALL).count()


def test_texts_are_written_and_dealt_once(spark, tmp_path, monkeypatch):
    held, real = [], annotate.written
    monkeypatch.setattr(annotate, "written", lambda df, name: (held.append("q1" in str(df.collect())), real(df, name))[1])
    todo = spark.createDataFrame([(f"k{i}", f"q{i}") for i in range(20)] * 2, "example_key string, request string")
    rows = annotate.annotate_once(todo, lambda r: [x.upper() for x in r], str(tmp_path / "answers"), size=6, partitions=2)
    assert sorted((r.example_key, r.payload, r.error) for r in rows.collect()) == sorted((f"k{i}", f"Q{i}", None) for i in range(20))
    assert held.count(True) == 1
    batch = [{"key": k, "request": "q", "asked": k} for k in "aabbc"]
    assert [[r["key"] for r in rows] for _, rows in annotate.batches(iter([pd.DataFrame(batch[:1]), pd.DataFrame(batch[1:])]), 2)] == [["a", "b"], ["c"]]


def counted(spark, df):
    """df that counts how often its rows are made, and the counter."""
    made = spark.sparkContext.accumulator(0)

    def run(frames):
        for frame in frames:
            made.add(len(frame))
            yield frame

    return df.mapInPandas(run, df.schema), made


def test_edges_are_made_once(spark, monkeypatch):
    raw = spark.createDataFrame([(f"P{i}", r, f"S{j}") for i in range(6) for j in range(9) if (i * j) % 4 == 1 for r in "ab"] + [("P1", "a", "P1")], "src string, relation string, dst string")
    edges, made = counted(spark, raw)
    khop.Hops(edges)
    assert made.value <= 2 * raw.count()
    monkeypatch.setattr(V, "edges", lambda *a: counted_again[0])
    counted_again = counted(spark, raw)
    found = {r.id: r.neighbours for r in core.QUERIES["adjacency_blocks"](spark, SMALL).collect()}
    assert counted_again[1].value <= 2 * raw.count()
    assert found == {r.id: "|".join(r.neighbours) for r in kg.adjacency(raw).collect()} and found["P1"].startswith("P1|")


def test_keys_are_not_shuffled_for_every_drug(spark):
    df = spark.createDataFrame([("k1", ["D:2", "D:1", "D:2"], "C:1"), ("k2", ["D:9", "D:1"], "C:1"), ("k3", ["D:1"], "C:9"), ("k4", [None], "C:1"), ("k5", [], "C:1")], "example_key string, drug_set array<string>, condition_id_norm string")
    drugs, diseases = (spark.createDataFrame(rows, "id string, idx int") for rows in ([("<PAD>", 0), ("D:1", 1), ("D:2", 2)], [("C:1", 0)]))
    found = encode.encode_examples(df, drugs, diseases)
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.example_key, r.drug_idx, r.disease_idx, r.length) for r in found.collect()] == [("k1", [2, 1, 2], 0, 3)]
