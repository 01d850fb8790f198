"""Hand-made tables, one for each rule of the data model."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from regimen.functions import text as X
from regimen.operators import coverage, embed, encode, kg, mechanism, metrics, models, pairs, sample, split, walks
from regimen.sources import io


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect())


@pytest.mark.parametrize(
    ("value", "items", "bad"),
    [
        (None, [], False), ("", [], False), (" NaN ", [], False), ("none", [], False), ("[]", [], False),
        ("['CHEBI:1']", ["CHEBI:1"], False), ("CHEBI:1", ["CHEBI:1"], False), ("'CHEBI:1'", ["CHEBI:1"], False),
        ("[['A', None], 'B', 'Error: x', ' ', 3]", ["A", "B", "3"], False), ('["it\'s"]', ["it's"], False),
        ("[' A ', 'A']", [" A ", "A"], False), ("12", [], True), ("('A',)", [], True), ("{'a': 1}", [], True),
    ],
)
def test_parse_list(spark, value, items, bad):
    row = spark.createDataFrame([(value,)], "t string").select(X.parse_list(F.col("t")).alias("p")).first()["p"]
    assert (row["items"], row["bad"]) == (items, bad)


def test_split_pipe_and_keys(spark):
    df = spark.createDataFrame([("A | b|nan||NONE|Error x",), (None,)], "t string").select(X.split_pipe(F.col("t")).alias("x"))
    assert [r.x for r in df.collect()] == [["A", "b"], []]
    two = spark.createDataFrame([(["CHEBI:2", "CHEBI:1"],), (["CHEBI:1", "CHEBI:2"],)], "d array<string>")
    assert {r[0] for r in two.select(X.example_key(F.col("d"), F.lit("MONDO:10"))).collect()} == {"CHEBI:1|CHEBI:2||MONDO:10"}
    assert spark.range(1).select(X.drug_set(F.array(F.lit("é"), F.lit("a"), F.lit("A")), F.array(F.lit("A")))).first()[0] == ["A", "A", "a", "é"]
    assert [r[0] for r in spark.createDataFrame([("CHEBI:1:2",), ("bare",)], "i string").select(X.curie_prefix(F.col("i"))).collect()] == ["CHEBI", "bare"]
    assert [r[0] for r in spark.createDataFrame([(["a", "b"],), ([],)], "l array<string>").select(X.format_list(F.col("l"))).collect()] == ["['a', 'b']", "[]"]


def test_read_pairs_and_single_therapy(spark, tmp_path):
    (tmp_path / "p.csv").write_text("primary_drug_id_norm,secondary_drug_id_norm,condition_id_norm,extra\n\"['B']\",\"['A', 'A']\",MONDO:1,x\nC,,nan,x\nC,,Error: no,x\n[],,MONDO:2,x\n12,,MONDO:3,x\n")
    got = io.read_pairs(spark, str(tmp_path / "p.csv"), 1).collect()
    assert sorted((r.drug_set, r.condition_id_norm, r.label, r.bad) for r in got) == [([], "MONDO:3", 1, True), (["A", "A", "B"], "MONDO:1", 1, False)]
    (tmp_path / "s.csv").write_text("final normalized drug id,final normalized disease id\nCHEBI:2|CHEBI:1|nan, MONDO:1 \nnan,MONDO:2\nCHEBI:1,Error\n")
    assert rows(io.read_single_therapy(spark, str(tmp_path / "s.csv"), 0), "drug_set", "condition_id_norm", "label") == [(["CHEBI:1", "CHEBI:2"], "MONDO:1", 0)]
    (tmp_path / "ids.txt").write_text(" a \n\nb\na\n")
    assert rows(io.read_id_list(spark, str(tmp_path / "ids.txt")), "id") == ["a", "b"]


def test_stored_examples_come_back(spark, tmp_path):
    df = spark.createDataFrame([(["A", "B"], "M", 1), (["C"], "N", 0)], "drug_set array<string>, condition_id_norm string, label int")
    io.write_csv(df, str(tmp_path / "x.csv"))
    io.write_table(df, str(tmp_path / "x"))
    for path in ("x.csv", "x"):
        assert rows(io.read_examples(spark, str(tmp_path / path)), "drug_set", "condition_id_norm", "label") == [(["A", "B"], "M", 1), (["C"], "N", 0)]
    io.write_report(df.agg(F.count(F.lit(1)).alias("n"), F.max("label").alias("a")), str(tmp_path / "r"))
    text = next((tmp_path / "r").glob("part-*")).read_text()
    assert list(json.loads(text)) == ["a", "n"]


def test_zero_wins_and_conflicts(spark):
    df = spark.createDataFrame([(["A", "B"], "M", 1), (["A", "B"], "M", 0), (["C"], "M", 1)], "drug_set array<string>, condition_id_norm string, label int")
    assert rows(pairs.dedupe(df), "drug_set", "label", "conflict") == [(["A", "B"], 0, True), (["C"], 1, False)]
    assert pairs.conflicts(df).count() == 1
    assert pairs.dedupe(df.limit(0)).columns == ["drug_set", "condition_id_norm", "label", "conflict"]


def test_coverage_keeps_order_and_repeats(spark):
    df = spark.createDataFrame([("k1", ["X", "A", "X"], "M"), ("k2", ["A"], "Q"), ("k3", ["A"], "M"), ("k4", ["X"], "Q")], "example_key string, drug_set array<string>, condition_id_norm string")
    nodes = spark.createDataFrame([("A",), ("M",), ("A",)], "id string")
    kept, dropped = coverage.filter_by_coverage(df, nodes)
    assert rows(kept, "example_key") == ["k3"]
    assert {r.example_key: (r.missing_drug_ids, r.missing_disease_id, r.reason) for r in dropped.collect()} == {"k1": (["X", "X"], None, "missing_drug"), "k2": ([], "Q", "missing_disease"), "k4": (["X"], "Q", "missing_drug+missing_disease")}
    assert {r.prefix: r.n for r in coverage.missing_prefixes(dropped).collect()} == {"X": 3, "Q": 2}
    assert coverage.drop_stats(coverage.annotate(df.limit(0), nodes)).first()["percent_dropped"] == 0


def test_graph(spark):
    raw = spark.createDataFrame([("A", "p", " B "), ("B", "p", "C"), ("B", "p", "C"), ("D", "q", "D"), (None, "p", "A"), ("", "p", "A")], "Subject string, predicate string, OBJECT string")
    edges = kg.clean_edges(kg.normalize_edges(raw))
    assert edges.columns == ["src", "dst", "relation"] and edges.count() == 4
    start = spark.createDataFrame([("A",), ("outside",)], "id string")
    for hops, want in ((0, {"A", "outside"}), (1, {"A", "outside", "B"}), (2, {"A", "outside", "B", "C"}), (5, {"A", "outside", "B", "C"})):
        seen, log, truncated = kg.expand_nodes(edges, start, hops)
        assert {r.id for r in seen.collect()} == want and not truncated
    seen, log, truncated = kg.expand_nodes(edges, start, 3, max_nodes=2)
    assert truncated and log == [(1, 1, 3)] and seen.count() == 3
    assert kg.incident_edges(edges, spark.createDataFrame([("C",), ("D",)], "id string")).count() == 3
    cats = kg.node_categories(spark.createDataFrame([("A", "x", 1), ("A", "y", 2), ("B", None, 1), (None, "z", 1)], "id string, category string, row int"), order=["row"])
    assert rows(cats, "id", "category") == [("A", "y"), ("B", "UNKNOWN")]
    with pytest.raises(ValueError, match="known endpoint"):
        kg.infer_endpoints(["a", "b"])
    with pytest.raises(ValueError, match="lack"):
        kg.normalize_edges(raw, "no", "OBJECT")


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_samples_and_splits_do_not_depend_on_partitions(spark, parts):
    df = spark.range(200).select(F.concat(F.lit("k"), "id").alias("example_key"), (F.col("id") % 3 == 0).cast("int").alias("label")).repartition(parts)
    assert rows(sample.exact_n(df, 10, 5), "example_key") == rows(sample.exact_n(df.coalesce(1), 10, 5), "example_key")
    one = {r.example_key: r.split for r in split.exact_split(df, 5).collect()}
    assert [list(one.values()).count(s) for s in ("train", "val", "test")] == [160, 20, 20]
    assert one == {r.example_key: r.split for r in split.exact_split(df.coalesce(1), 5).collect()}
    assert split.stratified_split(df, 5).where("split = 'val'").groupBy("label").count().orderBy("label").collect()[0]["count"] == 13
    assert sorted(r.idx for r in sample.index_rows(df, ["example_key"]).collect()) == list(range(200))


@pytest.mark.parametrize(("n", "want"), [(0, (0, 0)), (1, (1, 1)), (2, (1, 2)), (3, (2, 3)), (10, (8, 9))])
def test_split_sizes(n, want):
    assert split.sizes(n, 0.8, 0.1, 0.1) == want
    with pytest.raises(ValueError, match="sum to 1"):
        split.sizes(10, 0.8, 0.1, 0.2)


def test_stored_split_is_reused_only_if_it_fits(spark, tmp_path):
    df = spark.range(20).select(F.col("id").cast("string").alias("example_key"))
    first = split.load_or_make(df, str(tmp_path / "s"), 1).collect()
    assert split.load_or_make(df, str(tmp_path / "s"), 2).collect() == first
    assert split.load_or_make(df.limit(10), str(tmp_path / "s"), 2).count() == 10


@pytest.mark.parametrize(("test", "size"), [(0.5, 5), (0.02, 2)])
def test_holdout_by_size(spark, test, size):
    df = spark.range(100).select(F.col("id").cast("string").alias("example_key"), F.array_repeat(F.lit("A"), F.when(F.col("id") < 5, 3).otherwise(1)).alias("drug_set"))
    found = split.holdout_by_size(df, "3-4", 7, test=test)
    assert found.where("split = 'test'").count() == size and found.count() == 100


def test_encoding(spark):
    df = spark.createDataFrame([("k", ["B", "A", "A"], "M"), ("j", ["A"], "N")], "example_key string, drug_set array<string>, condition_id_norm string")
    drugs, diseases = encode.drug_vocab(df), encode.disease_vocab(df)
    assert rows(drugs, "idx", "id") == [(0, "<PAD>"), (1, "A"), (2, "B")] and rows(diseases, "idx", "id") == [(0, "M"), (1, "N")]
    padded = encode.pad(encode.encode_examples(df, drugs, diseases), width=4)
    assert {r.example_key: (r.padded, r.disease_idx, r.length) for r in padded.collect()} == {"k": ([2, 1, 1, 0], 0, 3), "j": ([1, 0, 0, 0], 1, 1)}


def test_payload_rules(spark):
    good = {"category": "side_effect_relief", "confidence": 0.5, "rationale_short": "  x" + "y" * 700, "needs_human_review": True}
    cases = [(json.dumps(good), None), (json.dumps(good | {"category": "invalid"}), "category"), (json.dumps(good | {"confidence": 1.01}), "confidence"), (json.dumps(good | {"rationale_short": "  "}), "rationale"), (json.dumps(good | {"needs_human_review": "true"}), "needs_human_review"), ("nope", "malformed"), ("[1]", "malformed"), (None, "malformed")]
    got = {r.i: r for r in mechanism.validate_payloads(spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, payload string")).collect()}
    assert [got[i].error for i in range(len(cases))] == [c[1] for c in cases]
    assert len(got[0].rationale_short) == 600 and got[0].needs_human_review is True


def test_cache_prevents_a_second_call(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('\n{"cache_key": "k::v1::m", "example_key": "k", "prompt_version": "v1", "model": "m", "classification": {"category": "other", "confidence": 0.1, "rationale_short": "a", "needs_human_review": false}}\nbroken\n{"cache_key": "k::v1::m", "example_key": "k", "prompt_version": "v1", "model": "m", "classification": {"category": "other", "confidence": 0.9, "rationale_short": "b", "needs_human_review": false}}\n')
    cache = mechanism.read_cache(spark, str(tmp_path / "c.jsonl"))
    assert [r.classification.confidence for r in cache.collect()] == [0.9]
    df = spark.createDataFrame([("k::v1::m", "k", "q1"), ("l::v1::m", "l", "q2")], "cache_key string, example_key string, request string")
    cached, todo = mechanism.partition_cached(df, cache)
    assert rows(cached, "example_key") == ["k"] and rows(todo, "example_key") == ["l"]
    assert mechanism.partition_cached(df, cache, force=True)[1].count() == 2
    answers = mechanism.annotate(todo, lambda texts: [t.upper() for t in texts], partitions=2)
    assert rows(answers, "example_key", "payload") == [("l", "Q2")]
    failed = mechanism.annotate(df, lambda texts: 1 / 0, partitions=1).collect()
    assert len(failed) == 2 and all(r.payload is None and "ZeroDivisionError" in r.error for r in failed)


def test_refinement_funnel_and_training_schema(spark):
    df = spark.createDataFrame([(["A", "B"], "M", 1, "other", 0.6, False), (["A", "B"], "M", 0, "other", 0.7, False), (["A"], "M", 1, "other", 0.59, False), (["A"], "M", 1, "other", 0.9, True), (["A"], "M", 1, None, None, None)], "drug_set array<string>, condition_id_norm string, label int, mechanism_category string, mechanism_confidence double, needs_human_review boolean")
    report = mechanism.refinement_report(df, ["other"]).first().asDict()
    assert report == {"n_input": 5, "n_category": 4, "n_confidence": 3, "n_review": 2, "n_final": 1, "n_indications": 0, "n_contraindications": 1}
    assert rows(mechanism.to_training_schema(mechanism.refine(df, ["other"])), "primary_drug_id_norm", "secondary_drug_id_norm", "condition_id_norm") == [(["A"], ["B"], "M")]
    with pytest.raises(ValueError, match="unknown categories"):
        mechanism.check_categories(["x"])
    with pytest.raises(Exception, match="without drugs"):
        mechanism.to_training_schema(df.limit(1).withColumn("drug_set", F.array().cast("array<string>"))).collect()


def test_metrics_of_ties_one_class_and_empty(spark):
    df = spark.createDataFrame([("a", 0.5, 1), ("a", 0.5, 0), ("a", 0.9, 1), ("a", 0.1, 0), ("b", 0.7, 1)], "g string, prob double, label int")
    got = {r.g: r for r in metrics.binary_metrics(df, ["g"]).collect()}
    assert got["a"].roc_auc == 0.875 and got["a"].fp == 1 and got["b"].roc_auc is None and got["b"].specificity is None
    assert metrics.binary_metrics(df.where("g = 'none'")).first()["accuracy"] is None
    buckets = metrics.bucket_metrics(df.withColumn("length", F.lit(2))).collect()
    assert sorted((r.bucket, r.n) for r in buckets) == [("1", 0), ("2", 5), ("3-4", 0), (">=5", 0)]
    one = metrics.summarize_replicates(spark.createDataFrame([(0.5, float("nan"))], "roc_auc double, f1 double"), ["roc_auc", "f1"]).collect()
    assert {r.metric: (r["mean"], r["std"], r.sem, r.n) for r in one} == {"roc_auc": (0.5, 0.0, 0.0, 1), "f1": (None, None, None, 0)}


def test_embeddings(spark, tmp_path):
    vocab = spark.createDataFrame([("<PAD>", 0), ("A", 1), ("B", 2)], "id string, idx int")
    vectors = spark.createDataFrame([("A", [1.0, 2.0])], "id string, vector array<float>")
    got = {r.id: r for r in embed.entity_embeddings(vocab, vectors, 2).collect()}
    again = {r.id: r for r in embed.entity_embeddings(vocab.repartition(5), vectors, 2).collect()}
    assert got["<PAD>"].vector == [0.0, 0.0] and got["A"].vector == [1.0, 2.0] and not got["B"].known and got["B"].vector == again["B"].vector
    many = spark.range(2000).select(embed.normal_vector(F.col("id").cast("string"), 1, 3)[0].alias("x")).agg(F.avg("x"), F.stddev("x")).first()
    assert abs(many[0]) < 0.01 and abs(many[1] - 0.1) < 0.01
    vectors.union(vectors).write.parquet(str(tmp_path / "v"))
    with pytest.raises(ValueError, match="2 rows of 1 ids"):
        embed.load_embeddings(spark, str(tmp_path / "v"))


def test_walks_are_stored_by_fingerprint(spark, tmp_path):
    edges = spark.createDataFrame([("A", "B"), ("B", "C")], "src string, dst string")
    first = walks.load_or_build(edges, str(tmp_path), num_walks=2, length=4, dim=4, window=2, seed=1)
    assert {r.id for r in first.collect()} == {"A", "B", "C"}
    walks.load_or_build(edges, str(tmp_path), num_walks=2, length=4, dim=4, window=2, seed=1)
    walks.load_or_build(edges.limit(1), str(tmp_path), num_walks=2, length=4, dim=4, window=2, seed=1)
    assert len(list(tmp_path.glob("node2vec-*"))) == 2


def test_buckets_of_odd_lengths(spark):
    df = spark.createDataFrame([(1, 0.9, 1), (0, 0.9, 1), (None, 0.9, 1), (-1, 0.1, 0), (4, 0.1, 0), (7, 0.1, 0)], "length int, prob double, label int")
    assert sorted((r.bucket, r.n) for r in metrics.bucket_metrics(df).collect()) == [("1", 1), ("2", 0), ("3-4", 1), (">=5", 1)]


def test_roc_auc_over_many_ranges(spark):
    import random

    r = random.Random(3)
    data = [(r.choice("ab") if i % 50 else None, round(r.random(), 2 + i % 3), int(r.random() < 0.4)) for i in range(600)]
    got = {x.g: x.roc_auc for x in metrics.roc_auc(spark.createDataFrame(data, "g string, prob double, label int").repartition(7), ["g"]).collect()}
    for g in ("a", "b", None):
        pos, neg = ([p for h, p, y in data if h == g and y == k] for k in (1, 0))
        want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
        assert abs(got[g] - want) < 1e-9
    flat = metrics.roc_auc(spark.createDataFrame([(p, y) for _, p, y in data], "prob double, label int")).first().roc_auc
    pos, neg = ([p for _, p, y in data if y == k] for k in (1, 0))
    assert abs(flat - sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))) < 1e-9


def test_large_samples_are_the_same_rows(spark, monkeypatch):
    df = spark.range(500).selectExpr("concat('k', id) AS example_key")
    want = rows(sample.exact_n(df, 200, 5), "example_key")
    monkeypatch.setattr(sample, "TOP_ROWS", 10)
    assert rows(sample.exact_n(df.repartition(3), 200, 5), "example_key") == want and len(want) == 200


def test_missing_review_flag_and_failures(spark):
    schema = "drug_set array<string>, condition_id_norm string, label int, mechanism_category string, mechanism_confidence double, needs_human_review boolean, error string"
    df = spark.createDataFrame([(["A"], "M", 1, "other", 0.9, None, None), (["B"], "M", 1, "other", 0.9, False, None), (["C"], "M", 0, None, None, None, "timeout")], schema)
    assert rows(mechanism.refine(df, [" other "]), "drug_set") == [["B"]]
    r = mechanism.summarize(df).first()
    assert (r.n_rows, r.n_failures, r.mean, r.review_rate) == (2, 1, 0.9, 0.0)
    with pytest.raises(ValueError, match="nothing"):
        mechanism.check_categories(["other", "nothing"])


def test_attach_takes_the_first_annotation(spark):
    df = spark.createDataFrame([("k",), ("l",)], "example_key string")
    notes = spark.createDataFrame([("k", 2, "other", 0.1, True, "b"), ("k", 1, "side_effect_relief", 0.9, False, "a")], "example_key string, at int, category string, confidence double, needs_human_review boolean, rationale_short string")
    for part in (notes, notes.orderBy("at")):
        got = {r.example_key: r for r in mechanism.attach(df, part, "m", "v1", order=["at"]).collect()}
        assert got["k"].mechanism_category == "side_effect_relief" and got["l"].mechanism_category is None
        assert got["k"].classified_at_utc.endswith("+00:00") and got["k"].llm_model == "m"


def test_mean_n_of_replicates(spark):
    df = spark.createDataFrame([("1", 0.5, 10), ("1", 1.0, 20), ("2", None, 0)], "bucket string, accuracy double, n bigint")
    got = {r.bucket: (r["mean"], r.n, r.mean_n) for r in metrics.summarize_replicates(df, ["accuracy"], by=["bucket"]).collect()}
    assert got == {"1": (0.75, 2, 15.0), "2": (None, 0, 0.0)}


def test_graph_files(spark, tmp_path):
    spark.createDataFrame([(" A ", "treats", "B"), ("A", "r", None), ("", "r", "B")], "Subject string, predicate string, Object string").write.parquet(str(tmp_path / "e"))
    edges = kg.read_edges(spark, str(tmp_path / "e"))
    assert rows(edges, "src", "relation", "dst") == [("A", "treats", "B")]
    kg.export_edges(edges.union(edges), str(tmp_path / "all"))
    assert spark.read.csv(str(tmp_path / "all"), header=True).count() == 2
    kg.export_edges(edges.union(spark.createDataFrame([("0", "x", "B")], edges.schema)), str(tmp_path / "one"), 1)
    assert rows(spark.read.csv(str(tmp_path / "one"), header=True), "src") == ["0"]
    for i, part in enumerate(([("n", "old"), ("m", "x"), ("m", "y")], [("n", "new"), ("o", None)])):
        spark.createDataFrame(part, "id string, category string").coalesce(1).write.parquet(str(tmp_path / f"c{i}"))
        (tmp_path / "nodes").mkdir(exist_ok=True)
        next((tmp_path / f"c{i}").glob("part-*.parquet")).rename(tmp_path / "nodes" / f"part-{i}.parquet")
    assert rows(kg.read_node_categories(spark, str(tmp_path / "nodes")), "id", "category") == [("m", "y"), ("n", "new"), ("o", "UNKNOWN")]


def test_embedding_and_vocabulary_files(spark, tmp_path):
    spark.createDataFrame([("A", [1.0], [2.0], 5)], "id string, pca_embedding array<double>, topological_embedding array<double>, other int").write.parquet(str(tmp_path / "v"))
    parts = embed.read_node_embeddings(spark, str(tmp_path / "v"))
    assert parts.columns == ["id", "pca_embedding", "topological_embedding"] and embed.select_embedding(parts).first().vector == [1.0, 2.0]
    vocab = encode.drug_vocab(spark.createDataFrame([(["b", "a"],)], "drug_set array<string>"))
    encode.write_vocab(vocab, str(tmp_path / "vocab"))
    assert rows(spark.read.parquet(str(tmp_path / "vocab")), "idx", "id") == [(0, "<PAD>"), (1, "a"), (2, "b")]


def test_labelled_files_and_cache(spark, tmp_path):
    (tmp_path / "l.csv").write_text("drug_set,condition_id_norm,source_label_binary,mechanism_category,mechanism_confidence,needs_human_review\n\"['B', 'A']\",M,1,other,0.7,True\n['C'],N,0,other,high,maybe\n")
    got = {r.condition_id_norm: r for r in mechanism.read_labeled(spark, str(tmp_path / "l.csv")).collect()}
    assert (got["M"].drug_set, got["M"].label, got["M"].mechanism_confidence, got["M"].needs_human_review) == (["B", "A"], 1, 0.7, True)
    assert (got["N"].label, got["N"].mechanism_confidence, got["N"].needs_human_review) == (0, None, None)
    good, bad = mechanism.split_by_label(mechanism.read_labeled(spark, str(tmp_path / "l.csv")))
    assert rows(good, "condition_id_norm") == ["M"] and rows(bad, "condition_id_norm") == ["N"] and bad.columns == good.columns
    with pytest.raises(ValueError, match="no label column"):
        mechanism.resolve_label(spark.range(1))
    assert mechanism.resolve_label(spark.createDataFrame([("1", "x")], "label string, other string")).first().label == 1
    names = spark.createDataFrame([(" ", " b "), ("a", "b"), (None, None)], "condition_id_norm_norm_label string, condition_id_norm_label string")
    assert [r[0] for r in names.select(mechanism.condition_label(names.columns)).collect()] == ["b", "a", ""]
    assert spark.range(1).select(mechanism.condition_label(["id"])).first()[0] == ""
    line = spark.createDataFrame([("k", "e", "v", "m", ("other", 0.5, "r", False))], mechanism.CACHE_SCHEMA.rsplit(",", 1)[0])
    mechanism.append_cache(line, str(tmp_path / "cache"))
    mechanism.append_cache(line.withColumn("cache_key", F.lit("k2")), str(tmp_path / "cache"))
    assert rows(mechanism.read_cache(spark, str(tmp_path / "cache")), "cache_key") == ["k", "k2"]


def test_valid_rows_with_trimmed_conditions(spark):
    df = spark.createDataFrame([(["A"], " M "), (["A"], "NONE"), (["A"], " nan "), ([], "M"), (["A"], None)], "drug_set array<string>, condition_id_norm string")
    assert rows(pairs.valid_rows(df, trim=True), "condition_id_norm") == ["M"]


def test_models_learn_what_can_be_told_apart(spark):
    data = [(f"k{i}", ["A", "B"] if i % 2 else ["C", "D"], "M", i % 2) for i in range(80)]
    df = spark.createDataFrame(data, "example_key string, drug_set array<string>, condition_id_norm string, label int")
    vectors = spark.createDataFrame([("A", [1.0, 0.0]), ("B", [1.0, 0.5]), ("C", [-1.0, 0.0]), ("D", [-1.0, 0.5]), ("M", [0.3, 0.3])], "id string, vector array<float>")
    for features, fit in ((models.pair_features, lambda x: models.fit_forest(x, trees=5, depth=3)), (models.combo_features, lambda x: models.fit_combo(x, hidden=(4,), steps=60))):
        made = features(df, vectors, vectors)
        scored = models.score(made, fit(made)).collect()
        assert len(scored) == 80 and all((r.prob > 0.8) == (r.label == 1) and (r.prob < 0.2) == (r.label == 0) and r.length == 2 for r in scored)
    three = spark.createDataFrame([("k", ["A", "B", "D"], "M", 1)], df.schema)
    assert models.combo_features(three, vectors, vectors).first().features == pytest.approx([1 / 3, 1 / 3, 0.3, 0.3])


def test_biased_walks_follow_their_weights(spark):
    """From the path 0 - 1 the next step goes back to 0, to 2 (which 0 knows) or to 3 or 4 (which it doesn't) as 1/p : 1 : 1/q : 1/q."""
    edges = spark.createDataFrame([("0", "1"), ("1", "2"), ("0", "2"), ("1", "3"), ("1", "4")], "src string, dst string")
    p, q = 0.5, 4.0
    paths = [r.path for r in walks.random_walks(edges, num_walks=2500, length=3, seed=3, p=p, q=q).where("start = '0'").collect()]
    thirds = [path[2] for path in paths if path[1] == "1"]
    total = 1 / p + 1 + 2 / q
    for node, weight in (("0", 1 / p), ("2", 1.0), ("3", 1 / q), ("4", 1 / q)):
        assert abs(thirds.count(node) / len(thirds) - weight / total) < 0.05
    assert len(paths) == 2500 and 0.45 < len(thirds) / 2500 < 0.55


def test_written_tables_can_be_discarded(spark):
    import os

    from regimen.sources import tables

    kept = tables.written(spark.range(3), "some").collect()
    assert os.path.isdir(tables.own_folder(spark)) and len(kept) == 3
    tables.discard(spark)
    assert not os.path.isdir(tables.own_folder(spark))
