"""k hops by bitmaps, adjacency in blocks, growing vocabularies and mergeable profiles."""

from __future__ import annotations

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from regimen.operators import encode, kg, khop, profiles
from regimen.sources import tables


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def random_edges(seed, nodes=300, n=500, hub=True):
    r = random.Random(seed)
    pairs = [(f"n{r.randrange(nodes):03d}", f"n{r.randrange(nodes):03d}") for _ in range(n)]
    return pairs + ([("n000", f"n{i:03d}") for i in range(0, nodes, 2)] if hub else []) + [("a", "b"), ("b", "a"), ("s", "s")]


@pytest.mark.parametrize(("way", "heavy"), [("push", 3), ("pull", 3), (None, 1000)])
def test_bitmap_hops_equal_the_joins(spark, monkeypatch, way, heavy):
    monkeypatch.setattr(tables, "HEAVY", heavy)
    monkeypatch.setattr(tables, "LEAST_HEAVY", 1000 if heavy == 1000 else 4)
    edges = edges_of(spark, random_edges(1, hub=way != "push"))
    start = spark.createDataFrame([("n005",), ("n005",), ("outside",), (None,), ("a",)], "id string")
    for hops, most in ((0, None), (2, None), (9, 40)):
        want, got = kg.expand_nodes(edges, start, hops, most), khop.expand(edges, start, hops, most, way=way)
        assert sorted(map(tuple, got[0].collect())) == sorted(map(tuple, want[0].collect()))
        assert got[1] == want[1] and got[2] == want[2]
    nothing = khop.expand(edges, start.where("false"), 2, way=way)
    assert nothing[0].collect() == [] and nothing[1] == []
    assert khop.expand(edges.where("false"), start, 2, way=way)[0].count() == 3


def test_words_of_sets(spark):
    numbers = spark.createDataFrame([(n,) for n in (0, 63, 64, 1000, 1000, 127)], "number bigint")
    words = khop.as_words(numbers)
    assert words.count() == 3 and khop.Hops.size(words) == 5
    assert sorted(r.number for r in khop.as_numbers(words).collect()) == [0, 63, 64, 127, 1000]


def test_a_hub_is_few_rows(spark):
    hops = khop.Hops(edges_of(spark, [("hub", f"n{i:04d}") for i in range(3000)]))
    assert hops.adjacency.where("node = 0").count() <= 3000 // 64 + 2
    near, log, _ = hops.expand(spark.createDataFrame([("hub",)], "id string"), 2)
    assert near.count() == 3001 and log == [(1, 3000, 3001)]


@pytest.mark.parametrize("length", [1, 7, 1024])
def test_blocks_give_the_adjacency_back(spark, length):
    edges = edges_of(spark, random_edges(2))
    numbers = tables.written(khop.number_nodes(edges))
    blocks = tables.written(khop.adjacency_blocks(edges, numbers, length))
    got = khop.named_neighbours(blocks, numbers).groupBy("id").agg(F.array_sort(F.collect_list("other")).alias("neighbours"))
    want = kg.adjacency(edges).select("id", "neighbours")
    assert {r.id: r.neighbours for r in got.collect()} == {r.id: r.neighbours for r in want.collect()}
    sizes = [len(r.rest) for r in blocks.collect()]
    assert all(r.rest[0] == 0 and r.rest == sorted(r.rest) for r in blocks.collect()) and max(sizes) < 4 * length + 12
    hub = numbers.where("id = 'n000'").first().number
    assert blocks.where(F.col("node") == hub).count() == min(blocks.where(F.col("node") == hub).first().n_blocks, blocks.where(F.col("node") == hub).count()) and (length > 100 or blocks.where(F.col("node") == hub).count() > 3)


def test_membership_by_block(spark, monkeypatch):
    pairs = random_edges(3, nodes=40, n=200)
    edges = edges_of(spark, pairs)
    numbers = tables.written(khop.number_nodes(edges))
    blocks = tables.written(khop.adjacency_blocks(edges, numbers, 5))
    number = {r.id: r.number for r in numbers.collect()}
    known = {(number[a], number[b]) for a, b in pairs} | {(number[b], number[a]) for a, b in pairs}
    asked = [(a, b) for a in number.values() for b in list(number.values())[::3]]
    monkeypatch.setattr(tables, "HEAVY", 3)
    monkeypatch.setattr(tables, "LEAST_HEAVY", 4)
    got = khop.has_edge(spark.createDataFrame(asked + asked[:5], "a bigint, b bigint"), blocks).collect()
    assert len(got) == len(asked) + 5 and all(r.known == ((r.a, r.b) in known) for r in got)


# Growing vocabularies


def test_vocabulary_grows_without_moving(spark, tmp_path):
    vocabulary = encode.GrowingVocabulary(spark, str(tmp_path / "v"), first=1, pad=True)
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "id string")
    now = lambda **k: {r.id: r.idx for r in vocabulary.read(**k).collect()}
    assert now() == {"<PAD>": 0} and vocabulary.grow(ids("d", "b", "b", None)) == 2
    first = now()
    assert first == {"<PAD>": 0, "b": 1, "d": 2}
    examples = spark.createDataFrame([("k", ["d", "b"], "M")], "example_key string, drug_set array<string>, condition_id_norm string")
    diseases = spark.createDataFrame([("M", 0)], "id string, idx int")
    before = encode.encode_examples(examples, vocabulary.read(), diseases).first().drug_idx
    assert vocabulary.grow(ids("a", "c", "d").repartition(3)) == 2 and vocabulary.grow(ids("a")) == 0
    assert now() == first | {"a": 3, "c": 4} and now(version=1) == first
    assert encode.encode_examples(examples, vocabulary.read(), diseases).first().drug_idx == before == [2, 1]
    again = encode.GrowingVocabulary(spark, str(tmp_path / "v"), first=1, pad=True)
    assert again.grow(ids(*[f"x{i:03d}" for i in range(500)]).repartition(9)) == 500
    assert sorted(now().values()) == list(range(505)) and now()["x499"] == 504
    with pytest.raises(ValueError, match="begins at 1"):
        encode.GrowingVocabulary(spark, str(tmp_path / "v"))


def test_a_growth_that_was_stopped_does_not_count(spark, tmp_path, monkeypatch):
    vocabulary = encode.GrowingVocabulary(spark, str(tmp_path / "v"))
    ids = spark.createDataFrame([("b",), ("a",)], "id string")
    with monkeypatch.context() as m:
        m.setattr(encode, "write_once", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            vocabulary.grow(ids)
    assert vocabulary.read().count() == 0 and vocabulary.grow(ids) == 2
    first, real = [True], encode.write_once

    def second(s, path, content):  # another writer comes first
        if first.pop() if first else False:
            other = encode.GrowingVocabulary(spark, str(tmp_path / "v"))
            assert other.grow(spark.createDataFrame([("z",)], "id string")) == 1
        return real(s, path, content)

    monkeypatch.setattr(encode, "write_once", second)
    assert vocabulary.grow(spark.createDataFrame([("c",), ("z",)], "id string")) == 1
    assert {r.id: r.idx for r in vocabulary.read().collect()} == {"a": 0, "b": 1, "z": 2, "c": 3}


# Profiles


def test_profiles_are_merged_within_their_bounds(spark, tmp_path):
    where, r = str(tmp_path / "t"), random.Random(4)
    rows = [(f"v{min(int(r.paretovariate(0.6)), 30000)}", None if i % 10 == 0 else r.gauss(0, 10)) for i in range(30000)]
    for k in range(3):
        spark.createDataFrame(rows[k * 10000 : (k + 1) * 10000], "name string, x double").coalesce(1).write.mode("append").parquet(where)
    store = profiles.profile_store(spark, str(tmp_path / "store"))
    table = lambda: spark.read.parquet(where)
    assert profiles.profile_new(table(), store, ["name", "x"]) == 3 and profiles.profile_new(table(), store, ["name", "x"]) == 0

    def exact(rows):
        from collections import Counter

        found = {c.column: c for c in profiles.merged(store, table()).collect()}
        counts, xs = Counter(n for n, _ in rows), sorted(x for _, x in rows if x is not None)
        name, x = found["name"], found["x"]
        assert name.n_rows == x.n_rows == len(rows) and name.n_nulls == 0 and x.n_nulls == sum(v is None for _, v in rows)
        assert (name.least, name.greatest) == (min(counts), max(counts)) and name.quantiles is None
        assert name.distinct_low <= len(counts) <= name.distinct_high and x.distinct_low <= len(set(xs)) <= x.distinct_high
        assert all(t.at_least <= counts[t.value] <= t["count"] for t in name.top) and name.top[0].value == counts.most_common(1)[0][0]
        for rank, value in zip((0.25, 0.5, 0.75), x.quantiles):
            assert abs(sum(v <= value for v in xs) / len(xs) - rank) < profiles.RANK_ERROR

    exact(rows)
    more = [("new", 5.0)] * 4000
    spark.createDataFrame(more, "name string, x double").coalesce(1).write.mode("append").parquet(where)
    assert profiles.profile_new(table(), store, ["name", "x"]) == 1
    exact(rows + more)
    assert store.compact()
    exact(rows + more)
    for name in os.listdir(where):  # a part that goes counts no more
        if name.endswith(".parquet") and spark.read.parquet(f"{where}/{name}").where("name = 'new'").count() == 4000:
            os.remove(f"{where}/{name}")
            if os.path.exists(f"{where}/.{name}.crc"):
                os.remove(f"{where}/.{name}.crc")
    exact(rows)
    shutil.rmtree(where)


def test_profile_of_nothing(spark, tmp_path):
    where = str(tmp_path / "t")
    spark.createDataFrame([], "name string, x double").write.parquet(where)
    store = profiles.profile_store(spark, str(tmp_path / "store"))
    assert profiles.profile_new(spark.read.parquet(where), store, ["name", "x"]) == 0 and profiles.merged(store).collect() == []
    spark.createDataFrame([(None, None), (None, None)], "name string, x double").coalesce(1).write.mode("append").parquet(where)
    assert profiles.profile_new(spark.read.parquet(where), store, ["name", "x"]) == 1
    got = {r.column: r for r in profiles.merged(store).collect()}
    assert got["x"].n_nulls == 2 and got["x"].quantiles is None and got["name"].top == [] and got["name"].least is None
