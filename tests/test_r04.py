"""What the findings of round 4 were about: nothing that grows with the tables is broadcast by an estimate, shuffled again for every step, or stored wider than it has to be."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from regimen.llm import phrases
from regimen.operators import attention, khop, lookup, models, skipgram, walks


def executed(spark, df) -> list[str]:
    """The final plans of df and of all that runs while it is made."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = {e.executionId() for e in _each(store.executionsList())}
    df().write.format("noop").mode("overwrite").save()
    return [e.physicalPlanDescription() for e in _each(store.executionsList()) if e.executionId() not in before]


def _each(seq):
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def test_candidates_of_walks_are_never_broadcast(spark):
    """Their table is small in bytes, but each row has many candidates; only the sizes of sorted ranges, a row a partition, may travel so."""
    edges = spark.range(400).selectExpr("concat('P', id % 40) as src", "concat('S', (id * 7 + id % 40) % 23) as dst")
    biased = executed(spark, lambda: walks.random_walks(edges, num_walks=2, length=4, p=0.5, q=2.0))
    assert all(plan.count("BroadcastExchange") == 0 or "_shift" in plan for plan in biased) and not any("luck" in plan and "Broadcast" in plan for plan in biased)


def test_a_step_of_walks_does_not_shuffle_the_neighbours(spark):
    edges = spark.range(400).selectExpr("concat('P', id % 40) as src", "concat('S', (id * 7 + id % 40) % 23) as dst")
    plan = walks.random_walks(edges, num_walks=1, length=4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SelectedBucketsCount") == 3


def test_walks_of_loops_nulls_and_links_before(spark):
    """A loop is one neighbour, null ends are none; with q over 1, a step to a node that is linked to the last one is likelier than one away."""
    odd = spark.createDataFrame([("a", "a"), ("a", None), (None, "b"), ("c", "d"), ("d", "c")], "src string, dst string")
    for q in (1.0, 3.0):
        assert {r.start: r.path for r in walks.random_walks(odd, 1, 4, p=1.0, q=q).collect()} == {"a": ["a"] * 4, "c": ["c", "d", "c", "d"], "d": ["d", "c", "d", "c"]}
    near = spark.createDataFrame([("x", "y"), ("x", "m"), ("m", "y"), ("m", "far")], "src string, dst string")
    for q in (0.05, 20.0):
        third = [r.path[2] for r in walks.random_walks(near, 300, 3, seed=5, p=50.0, q=q).collect() if r.path[:2] == ["x", "m"]]
        assert len(third) > 60 and (third.count("y") > 8 * third.count("far") if q > 1 else third.count("far") > 8 * third.count("y"))


NAMES = [("A", [1.0, 0.0]), ("B", [-1.0, 0.5]), ("C", [0.0, 1.0]), ("M", [0.3, 0.2]), ("N", [0.1, -0.4])]
ODD = [("a", ["A", "B"], "M", 1), ("b", ["C", "unknown", "B", "A"], "N", 0), ("c", ["unknown"], "M", 1), ("d", [], "M", 1), ("e", ["A"], "none", 1), ("f", ["A"], "M", None), ("g", ["A", "A", "C"], "M", 0), ("h", None, "M", 1)]


def odd_examples(spark):
    df = spark.createDataFrame(ODD, "example_key string, drug_set array<string>, condition_id_norm string, label int")
    return df, spark.createDataFrame(NAMES, "id string, vector array<float>")


def test_attention_learns_from_numbers_of_names(spark):
    """No row of the stored table holds a vector for each name of an example; gradients and scores are those of the vectors."""
    df, vectors = odd_examples(spark)
    packs = lookup.packed(df, vectors, vectors, "label")
    [pack] = [p for r in packs.collect() for p in lookup.packs(pa.RecordBatch.from_pylist([r.asDict()]))]
    assert len(pack.drugs) == 3 and len(pack.diseases) == 2 and sorted(pack.sizes) == [2, 3, 3]
    p, features = attention.start_parameters(2, 2, 3, 1), attention.sequence_features(df, vectors, vectors)
    for ordered in (True, False):
        plain, found = attention.summed_gradient(features.where("label is not null"), p, ordered), attention.packed_gradient(packs, p, ordered)
        assert plain[1] == found[1] == 3 and np.isclose(plain[0], found[0]) and all(np.allclose(plain[2][k], found[2][k]) for k in p)
    fitted = attention.fit_examples(df, vectors, vectors, hidden=3, steps=2)
    want = {r.example_key: (round(r.prob, 9), r.length) for r in fitted.score(features).collect()}
    assert want == {r.example_key: (round(r.prob, 9), r.length) for r in fitted.score_examples(df, vectors, vectors).collect()} and len(want) == 4
    assert attention.fit_examples(df.where("false"), vectors, vectors, hidden=3, steps=2).losses == []


def test_combo_learns_from_numbers_of_names(spark):
    """Gradients are those of the features, by differences; scores are those of Spark's perceptron with the same weights, and odd rows go as in combo_features."""
    rng = np.random.default_rng(1)
    layers, x, label = (4, 3, 2), rng.normal(size=(6, 4)), np.array([0, 1, 1, 0, 1, 0])
    w = rng.normal(size=4 * 3 + 3 + 3 * 2 + 2)
    _, g = models.perceptron_gradient(w, layers, x, label)
    for i in range(len(w)):
        up, down = (models.perceptron_gradient(w + by * (np.arange(len(w)) == i), layers, x, label)[0] for by in (1e-5, -1e-5))
        assert abs((up - down) / 2e-5 - g[i]) < 1e-7
    df, vectors = odd_examples(spark)
    features = {r.example_key: np.array(r.features) for r in models.combo_features(df, vectors, vectors).collect()}
    model = models.fit_combo_examples(df, vectors, vectors, hidden=(3,), steps=40, seed=1)
    found = {r.example_key: (r.prob, r.length) for r in model.score_examples(df, vectors, vectors).collect()}
    assert found.keys() == features.keys() and [found[k][0] > 0.5 for k in "abg"] == [True, False, False]
    for k, f in features.items():
        (w1, b1), (w2, b2) = models._unpacked(model.weights, model.layers)
        z = (1 / (1 + np.exp(-(f @ w1 + b1)))) @ w2 + b2
        assert np.isclose(found[k][0], 1 / (1 + np.exp(z[0] - z[1])))


def test_combo_learns_as_sparks_perceptron_does(spark):
    rng = np.random.default_rng(3)
    names = [(f"D{i}", rng.normal(size=4).tolist()) for i in range(30)] + [("M", [0.5] * 4)]
    sets = [[names[i][0] for i in rng.integers(0, 30, 3)] for _ in range(300)]
    at = dict(names)
    rows = [(f"k{i}", s, "M", int(sum(at[d][0] for d in s) > 0)) for i, s in enumerate(sets)]
    df, vectors = spark.createDataFrame(rows, "example_key string, drug_set array<string>, condition_id_norm string, label int"), spark.createDataFrame(names, "id string, vector array<float>")
    made = models.combo_features(df, vectors, vectors)
    loss = lambda scored: -float(np.mean([np.log(r.prob if r.label else 1 - r.prob) for r in scored.collect()]))
    own = loss(models.fit_combo_examples(df, vectors, vectors, hidden=(4,), steps=20).score_examples(df, vectors, vectors))
    assert own < 0.2 and own < 1.5 * loss(models.score(made, models.fit_combo(made, hidden=(4,), steps=20))) + 0.02


def test_pairs_of_empty_blocks_are_asked(spark):
    """Neighbours that share a block leave others without a row; every pair is there nonetheless, as are those of nodes without edges."""
    edges = spark.createDataFrame([(f"P{i}", f"S{j}") for i in range(30) for j in range(12) if (i * j + i) % 5 == 1], "src string, dst string")
    numbers = khop.number_nodes(edges.union(spark.createDataFrame([("P99", "S99")], edges.schema)))
    of = {r.id: r.number for r in numbers.collect()}
    left, right = (spark.createDataFrame([(n, of[n], int(n[1:]) % 2) for n in of if n[0] == side], f"{name} string, {key} bigint, r int") for side, name, key in (("P", "p", "a"), ("S", "s", "b")))
    blocks = khop.adjacency_blocks(edges, numbers, length=1)
    assert blocks.count() < blocks.select("node", "n_blocks").distinct().groupBy().sum("n_blocks").first()[0]
    found, have = khop.linked_pairs(left, right, blocks, "r").collect(), {(r.src, r.dst) for r in edges.collect()}
    assert len(found) == len({(r.p, r.s) for r in found}) == left.join(right, "r").count() and all(r.known == ((r.p, r.s) in have) for r in found)


def test_only_edges_that_can_link_asked_pairs_are_kept(spark):
    edges = spark.createDataFrame([("P1", "S1"), ("P1", "S2"), ("P2", "S2"), ("S2", "P2"), ("P3", "S1")], "src string, dst string")
    left, right = spark.createDataFrame([("P1", 1), ("P2", 0)], "id string, r int"), spark.createDataFrame([("S1", 1), ("S2", 0)], "id string, r int")
    assert sorted(map(tuple, khop.edges_within(edges, left, right, "r").collect())) == [("P1", "S1"), ("P2", "S2")]


def test_blocks_are_no_more_than_memory_or_tasks_ask_for(spark, monkeypatch):
    """All blocks pass a shuffle in each round, and there are as many rounds as blocks: their number may not grow with the nodes while they are small."""
    edges, ran, real = spark.range(300).selectExpr("concat('N', id % 90) as src", "concat('N', (id * 7 + 1) % 90) as dst"), [], skipgram._round
    monkeypatch.setattr(skipgram, "_round", lambda *a, **k: (ran.append(a[4]), real(*a, **k))[1])
    monkeypatch.setattr(skipgram, "BLOCK_NODES", 10)
    paths = walks.random_walks(edges, num_walks=1, length=4, seed=3)
    assert len(walks.node2vec(paths, dim=4, window=2, steps=2, seed=3).collect()) == 90 and ran == [skipgram.WORKERS] * 2 * skipgram.WORKERS
    ran.clear()
    monkeypatch.setattr(skipgram, "BLOCK_BYTES", 90 * 4 * 5 // 6)
    assert len(walks.node2vec(paths, dim=4, window=2, steps=1, seed=3).collect()) == 90 and ran == [6] * 6


def test_packed_pairs_are_all_pairs_of_the_windows(spark, monkeypatch):
    """By numbers of nodes, in packs of a few; repeated paths count each time, and nodes without a place keep their distance."""
    paths = spark.createDataFrame([(["a", "b", "c", None, "d", "a"],), (["a", "b"],), (["a", "b"],), (["a"],), (None,)], "path array<string>")
    placed = spark.createDataFrame([(n, 9, i % 2, i) for i, n in enumerate("abd")], "id string, uses bigint, block int, at int")
    number = {n: (i % 2, i) for i, n in enumerate("abd")}
    want = sorted((*number[r.centre], *number[r.context], r.n) for r in skipgram.window_pairs(paths, 4, 7).collect() if r.centre in number and r.context in number)
    found = skipgram.numbered_pairs(paths, placed, 4, 7)
    assert sorted(map(tuple, found.collect())) == want and len(want) == 5
    monkeypatch.setattr(skipgram, "PACK", 3)
    keyed = pa.RecordBatch.from_pylist([{"turn": i // 7, "cb": 0, "piece": 0, "c": i, "x": 2, "n": 1} for i in range(12)], pa.schema([(c, pa.int32()) for c in ("turn", "cb", "piece", "c", "x", "n")]))
    out = [b.to_pylist()[0] for b in skipgram._pack(iter([keyed.slice(0, 4), keyed.slice(4)]))]
    assert [(r["turn"], r["part"], np.frombuffer(r["data"], "<i4").reshape(-1, 3)[:, 0].tolist()) for r in out] == [(0, 0, [0, 1, 2]), (0, 1, [3, 4, 5]), (0, 2, [6]), (1, 0, [7, 8, 9]), (1, 1, [10, 11])]


def test_a_pass_of_phrases_reads_the_languages_of_its_tries(spark, monkeypatch):
    """Each text is read for the tries of its language and for no others; languages of few candidates share theirs; counts are exact."""
    many = lambda mark: [" ".join(f"{mark}{i} {mark}{i + 1} {mark}{i + 2}" for i in range(k, k + 8)) for k in (0, 3) for _ in range(3)]
    rows = [(lang, t) for lang in ("aa", "bb") for t in many(lang)] + [("cc", "x y z")] * 4 + [(None, "x y z")] * 3 + [("dd", "once only")]
    docs, read, real = spark.createDataFrame(rows, "lang string, text string"), [], phrases.trie_counts
    monkeypatch.setattr(phrases, "trie_counts", lambda s, texts, *a: (read.append(sorted({r.lang for r in texts.collect()})), real(s, texts, *a))[1])
    small = {"bits": 16, "word_bits": 16}
    found = sorted(map(tuple, phrases.phrase_counts(docs, least=3, longest=3, trie_phrases=40, **small)[1].collect()))
    assert sum("aa" in r for r in read) <= 2 and not any({"aa", "bb", "cc"} <= set(r) for r in read) and sum("cc" in r for r in read) == 1 and len(read) > 1
    read.clear()
    assert sorted(map(tuple, phrases.phrase_counts(docs, least=3, longest=3, **small)[1].collect())) == found and read == [["aa", "bb", "cc", "dd", "und"]]
    assert ("und", "x y z", 3) in found and ("cc", "y z", 4) in found and len(found) > 40
