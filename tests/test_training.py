"""Skip-gram in blocks, its store, and the attention classifier."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from regimen.operators import attention, skipgram, walks


def communities(spark, n=40):
    r = random.Random(0)
    pairs = [(f"n{i:02d}", f"n{j:02d}") for i in range(n) for j in range(i) if r.random() < (0.35 if (i < n // 2) == (j < n // 2) else 0.01)]
    return spark.createDataFrame(pairs, "src string, dst string")


def margin(vectors: dict, border="n20") -> float:
    """How much nearer nodes of one community are than those of two, in mean cosine."""
    ids = sorted(vectors)
    unit = np.array([vectors[i] / np.linalg.norm(vectors[i]) for i in ids])
    cosine, side = unit @ unit.T, np.array([i < border for i in ids])
    same = side[:, None] == side[None, :]
    np.fill_diagonal(same, False)
    return cosine[same].mean() - cosine[side[:, None] != side[None, :]].mean()


@pytest.mark.parametrize("block_nodes", [1000, 15])
def test_skipgram_finds_planted_communities(spark, block_nodes):
    paths = walks.random_walks(communities(spark), num_walks=8, length=12, seed=3)
    found = {r.id: np.array(r.vector) for r in skipgram.fit(paths, dim=16, window=4, steps=10, seed=3, block_nodes=block_nodes).collect()}
    assert len(found) == 40 and all(len(v) == 16 and np.isfinite(v).all() for v in found.values())
    assert margin(found) > 0.3


def test_skipgram_goes_on_after_its_last_round(spark, tmp_path, monkeypatch):
    paths = walks.random_walks(communities(spark), num_walks=3, length=8, seed=3).cache()
    fit = lambda where: {r.id: r.vector for r in skipgram.fit(paths, dim=4, window=3, steps=2, seed=3, block_nodes=15, path=str(tmp_path / where)).collect()}
    want, real, ran = fit("whole"), skipgram._round, []

    def dies(*a, **k):
        ran.append(a[3:6])
        if len(ran) == 4:
            raise RuntimeError("stopped")
        return real(*a, **k)

    monkeypatch.setattr(skipgram, "_round", dies)
    with pytest.raises(RuntimeError, match="stopped"):
        fit("stopped")
    assert fit("stopped") == want and len(ran) == 4 + 3  # three rounds were written, one was lost, three were left


def test_window_pairs_and_rare_nodes(spark):
    paths = spark.createDataFrame([("s", 0, ["a", "b", "c", "d", "a"]), ("s", 1, ["a"]), ("s", 2, None)], "start string, walk int, path array<string>")
    got = {(r.centre, r.context): r.n for r in skipgram.window_pairs(paths, 1, 1).collect()}
    assert got == {(a, b): 1 for a, b in ["ab", "ba", "bc", "cb", "cd", "dc", "da", "ad"]}
    wide = skipgram.window_pairs(paths, 10, 1)
    assert 8 <= wide.agg(F.sum("n")).first()[0] <= 20 and wide.where("centre = 'b' and context = 'b'").isEmpty()
    assert {r.id for r in skipgram.fit(paths, dim=2, window=2, min_count=2, steps=1).collect()} == {"a"}
    assert skipgram.fit(paths.where("walk = 2"), dim=2).collect() == []


def test_pairs_of_a_hub_are_few_and_nothing_is_collected(spark):
    """A hub's pairs are summed: no more rows than the nodes it meets; work per bucket is by distinct pairs."""
    star = spark.createDataFrame([("hub", f"leaf{i}") for i in range(300)], "src string, dst string")
    pairs = skipgram.window_pairs(walks.random_walks(star, num_walks=4, length=6, seed=1), 2, 1)
    assert pairs.where("centre = 'hub'").count() <= 301 and pairs.groupBy("centre", "context").count().where("count > 1").isEmpty()


def test_store_takes_all_parameters(spark, tmp_path, monkeypatch):
    edges = communities(spark, 20)
    build = lambda **more: walks.load_or_build(edges, str(tmp_path), **({"num_walks": 2, "length": 5, "dim": 4, "window": 2, "steps": 3, "seed": 1} | more))
    plain = {r.id: r.vector for r in build().collect()}
    biased = {r.id: r.vector for r in build(p=0.25, q=4.0).collect()}
    assert plain.keys() == biased.keys() and plain != biased
    assert {r.id: r.vector for r in build().collect()} == plain
    stores = lambda: sorted(n for n in os.listdir(tmp_path) if n.startswith("node2vec-"))
    assert len(stores()) == 2
    build(min_count=2)
    assert len(stores()) == 3
    with pytest.raises(ValueError, match="unknown parameters \\['depth'\\]"):
        build(depth=3)


def test_a_half_written_store_is_not_read(spark, tmp_path, monkeypatch):
    edges = communities(spark, 20)
    build = lambda: {r.id: r.vector for r in walks.load_or_build(edges, str(tmp_path), num_walks=2, length=5, dim=4, window=2, steps=2, seed=1).collect()}
    want = build()
    [store] = [tmp_path / n for n in os.listdir(tmp_path)]
    os.remove(store / "manifest.json")
    spark.createDataFrame([("bad", [0.0])], "id string, vector array<float>").write.mode("overwrite").parquet(str(store / "vectors"))
    assert build() == want and os.path.exists(store / "manifest.json") and not os.path.exists(store / "training")


# Attention


def test_attention_gradient_equals_finite_differences():
    rng = np.random.default_rng(1)
    p = attention.start_parameters(3, 2, 4, 5)
    x, mask = rng.normal(size=(5, 4, 3)), np.arange(4)[None, :] < np.array([1, 2, 4, 3, 2])[:, None]
    x[~mask] = 0
    disease, label = rng.normal(size=(5, 2)), np.array([0, 1, 1, 0, 1.0])
    for ordered in (True, False):
        _, g = attention.gradient(p, x, mask, disease, label, ordered)
        for k in p:
            for i in range(p[k].size):
                moved = {a: b.copy() for a, b in p.items()}
                moved[k].flat[i] += 1e-5
                up, _ = attention.gradient(moved, x, mask, disease, label, ordered)
                moved[k].flat[i] -= 2e-5
                down, _ = attention.gradient(moved, x, mask, disease, label, ordered)
                assert abs((up - down) / 2e-5 - g[k].flat[i]) < 1e-7


def test_places_beyond_a_set_do_not_count():
    rng = np.random.default_rng(2)
    p, x, disease = attention.start_parameters(3, 2, 4, 5), rng.normal(size=(1, 2, 3)), rng.normal(size=(1, 2))
    wide = np.concatenate([x, rng.normal(size=(1, 3, 3))], axis=1)
    a, _ = attention.forward(p, x, np.array([[True, True]]), disease, True)
    b, _ = attention.forward(p, wide, np.array([[True, True, False, False, False]]), disease, True)
    assert np.allclose(a, b)


VECTORS = [("A", [1.0, 0.0]), ("B", [-1.0, 0.0]), ("C", [0.0, 1.0]), ("D", [0.0, -1.0]), ("M", [0.3, 0.3])]
PAIRS = [(a, b) for a in "ABCD" for b in "ABCD" if a != b]


@pytest.mark.parametrize("ordered", [False, True])
def test_attention_learns_rules_that_a_mean_cannot_hold(spark, ordered):
    """{A, B} and {C, D} have the same mean vector, of {A, B, C} that of C: label 1 where A and B are both there; and, ordered, where the first drug comes before the second."""
    sets = [p for p in PAIRS for _ in range(4)] if ordered else [*[tuple(sorted(p)) for p in PAIRS] * 2, ("A", "B", "C"), ("A", "B", "D"), ("C",), ("D",)] * 4
    label = (lambda s: int(s[0] < s[1])) if ordered else (lambda s: int("A" in s and "B" in s))
    df = spark.createDataFrame([(f"k{i}", list(s), "M", label(s)) for i, s in enumerate(sets)], "example_key string, drug_set array<string>, condition_id_norm string, label int")
    vectors = spark.createDataFrame(VECTORS, "id string, vector array<float>")
    features = attention.sequence_features(df, vectors, vectors)
    model = attention.fit(features, hidden=24, steps=80, rate=0.02, ordered=ordered)
    scored = model.score(features).collect()
    assert len(scored) == len(sets) and all((r.prob > 0.5) == (r.label == 1) and r.length == len(r.drug_set) for r in scored)
    if not ordered:
        turned = model.score(features.withColumn("drug_vectors", F.reverse("drug_vectors"))).select("example_key", "prob").collect()
        assert {r.example_key: round(r.prob, 9) for r in turned} == {r.example_key: round(r.prob, 9) for r in scored}


def test_attention_gradient_over_partitions_and_odd_rows(spark):
    vectors = spark.createDataFrame(VECTORS, "id string, vector array<float>")
    rows = [("a", ["A", "B"], "M", 1), ("b", ["C", "unknown", "D", "A"], "M", 0), ("c", ["unknown"], "M", 1), ("d", [], "M", 1), ("e", ["A"], "N", 1), ("f", ["A"], "M", None)]
    df = spark.createDataFrame(rows, "example_key string, drug_set array<string>, condition_id_norm string, label int")
    features = attention.sequence_features(df, vectors, vectors)
    assert {r.example_key: [list(v) for v in r.drug_vectors] for r in features.collect()} == {"a": [[1, 0], [-1, 0]], "b": [[0, 1], [0, -1], [1, 0]], "f": [[1, 0]]}
    learned = features.where("label is not null")
    p = attention.start_parameters(2, 2, 3, 1)
    one = attention.summed_gradient(learned.coalesce(1), p, True)
    many = attention.summed_gradient(learned.repartition(9), p, True, fan=2)
    assert one[1] == many[1] == 2 and one[0] == pytest.approx(many[0]) and all(np.allclose(one[2][k], many[2][k]) for k in p)
    assert len(attention.fit(features, hidden=3, steps=2).score(features).collect()) == 3
    assert attention.fit(features.where("false"), hidden=3, steps=2).losses == []
