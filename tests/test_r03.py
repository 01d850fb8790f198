"""What the findings of round 3 were about: work that is done once a row, and shuffles that don't grow beyond the input."""

from __future__ import annotations

from regimen.operators import attention, coverage, khop, models, split, walks
from regimen.plans import testbed as V

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lists_are_parsed_once_a_row(spark):
    """A filter that is pushed below the parsing repeats it, and what it is made of, many times."""
    assert plan(V.deduped(spark, SMALL)).count("regexp_extract_all(") == 2


def test_known_ids_stay_in_their_task(spark):
    df = spark.createDataFrame([("k1", ["D:1", "D:2"], "C:1"), ("k2", ["D:2", None], None), ("k3", ["D:2"], "C:2")], "example_key string, drug_set array<string>, condition_id_norm string")
    nodes = spark.createDataFrame([("D:2",), ("C:1",), (None,)], "id string")
    found = coverage.annotate(df, nodes)
    assert "Window" not in plan(found) and plan(found).count("strategy=broadcast") == 1
    assert {r.example_key: (r.missing_drug_ids, r.missing_disease_id, r.reason) for r in found.collect()} == {
        "k1": (["D:1"], None, "missing_drug"), "k2": ([None], None, "missing_drug"), "k3": ([], "C:2", "missing_disease"),
    }


def test_vectors_are_not_shuffled_for_every_drug(spark):
    """Drugs without a vector are left out, repeated ones count each time, examples without any go; one vector a part meets all its examples."""
    df = spark.createDataFrame([("k1", ["D:1", "D:1", "D:2"], "C:1"), ("k2", ["D:9"], "C:1"), ("k3", ["D:2"], "C:9"), ("k4", ["D:9", "D:2"], "C:1"), ("k5", [], "C:1")], "example_key string, drug_set array<string>, condition_id_norm string")
    vectors = spark.createDataFrame([("D:1", [1.0, 2.0]), ("D:2", [4.0, 8.0]), ("C:1", [0.5, 0.25])], "id string, vector array<float>")
    found = models.combo_features(df, vectors, vectors)
    assert "Join" not in plan(found).split("_kind")[0]
    assert {r.example_key: r.features for r in found.collect()} == {"k1": [2.0, 4.0, 0.5, 0.25], "k4": [4.0, 8.0, 0.5, 0.25]}
    rows = attention.sequence_features(df, vectors, vectors).collect()
    assert {r.example_key: (r.drug_vectors, r.disease_vector) for r in rows} == {"k1": ([[1.0, 2.0], [1.0, 2.0], [4.0, 8.0]], [0.5, 0.25]), "k4": ([[4.0, 8.0]], [0.5, 0.25])}


def test_pairs_of_a_product_are_asked_without_a_shuffle(spark):
    edges = spark.createDataFrame([(f"P{i}", f"S{j}") for i in range(6) for j in range(9) if (i * j) % 4 == 1], "src string, dst string")
    numbers = khop.number_nodes(edges)
    of = {r.id: r.number for r in numbers.collect()}
    left = spark.createDataFrame([(n, of[n], int(n[1:]) % 2) for n in of if n[0] == "P"], "p string, a bigint, r int")
    right = spark.createDataFrame([(n, of[n], int(n[1:]) % 2) for n in of if n[0] == "S"], "s string, b bigint, r int")
    found = khop.linked_pairs(left, right, khop.adjacency_blocks(edges, numbers, length=2), "r").collect()
    have = {(r.src, r.dst) for r in edges.collect()}
    assert len(found) == len({(r.p, r.s) for r in found}) == left.join(right, "r").count() and all(r.known == ((r.p, r.s) in have) for r in found)


def test_walks_that_rarely_accept_read_the_index_a_few_times(spark, monkeypatch):
    names, real = [], walks.written
    monkeypatch.setattr(walks, "written", lambda df, name: (names.append(name), real(df, name))[1])
    ring = spark.range(200).selectExpr("concat('N', id) as src", "concat('N', (id + 1) % 200) as dst")
    found = walks.random_walks(ring, num_walks=1, length=3, p=20.0, q=20.0).collect()
    assert len(found) == 200 and names.count("taken") <= 8


def test_a_split_of_pairs_carries_no_other_lists(spark):
    """Every example counts in the split, but only those of two drugs carry their lists through its sort; features and parts are the same."""
    df = spark.createDataFrame([(f"k{i}", ["D:1", "D:2", "D:1"][: i % 4], "C:1", i % 2) for i in range(60)], "example_key string, drug_set array<string>, condition_id_norm string, label int")
    vectors = spark.createDataFrame([("D:1", [1.0, 2.0]), ("D:2", [4.0, 8.0]), ("C:1", [0.5, 0.25])], "id string, vector array<float>")
    small = split.exact_split(models.only_pairs(df), 13)
    assert small.count() == 60 and small.where("drug_set is not null or condition_id_norm is not null").count() == 15
    found, want = (sorted(map(repr, models.pair_features(x, vectors, vectors).collect())) for x in (small, split.exact_split(df, 13)))
    assert found == want and len(found) == 15
