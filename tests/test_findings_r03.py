"""The findings of round 3: steps whose rows grew faster than the input."""

from collections import Counter

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors

from riskloom.operators import embeddings
from riskloom.operators import graph_algorithms as ga
from riskloom.operators import graph_build as gb
from riskloom.operators import models, similarity
from riskloom.plans import queries

SMALL = "/root/testdata/sf0.001"


def test_a_metapath_makes_only_edges_that_it_goes_over(spark, monkeypatch):
    def never(*_, **__):
        raise AssertionError("pairs of providers are no hop of this path")

    monkeypatch.setattr(gb, "similar_billing", never)
    monkeypatch.setattr(gb, "co_bills_with", never)
    rows = queries.QUERIES["metapath_graph"](spark, SMALL).collect()
    assert rows and all(r.src < r.dst and r.weight == 2 for r in rows)
    assert gb.path_edge_types([["Provider", "Patient", "Provider_Ind"]]) == {"TREATS"}


@pytest.mark.parametrize("task_edges", [1_000_000, 300, 30])
def test_triangles_in_blocks_are_counted_once(spark, task_edges):
    rng = np.random.default_rng(1)
    pairs = [(f"n{a:02d}", f"n{b:02d}") for a in range(40) for b in range(a) if rng.random() < 0.3] + [("n00", f"z{k}") for k in range(5)]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    graph = spark.createDataFrame([(a, b, 1.0) for x in pairs for a, b in (x, x[::-1])], "src string, dst string, weight double")
    expected = {a: 2 * sum(b < c and c in near[b] for b in n for c in n) / max(1, len(n) * (len(n) - 1)) for a, n in near.items()}
    assert {r.node_id: r.clustering for r in ga.clustering(graph, task_edges).collect()} == pytest.approx(expected)


@pytest.mark.parametrize("threshold", [0.9, 0.7])
def test_counted_pairs_are_the_pairs(spark, threshold):
    rng = np.random.default_rng(2)
    vectors = rng.integers(0, 6, (60, 5))
    vectors[40:] = vectors[:20]
    rows = [(f"p{i:02d}", f"c{j}", int(n)) for i, v in enumerate(vectors) for j, n in enumerate(v) if n]
    counts = spark.createDataFrame(rows, "p string, code string, n long")
    expected = {(f"p{i:02d}", f"p{j:02d}") for i, a in enumerate(vectors) for j, b in enumerate(vectors) if i < j and a @ b >= threshold * np.sqrt((a @ a) * (b @ b)) > 0}
    ends = Counter(x for pair in expected for x in pair)
    for block in (None, 8):
        assert {(r.src, r.dst) for r in similarity.similar_pairs(counts, threshold, block).collect()} == expected
        assert {r.p: r.n for r in similarity.similar_counts(counts, threshold, block).collect()} == ends


def test_statistics_make_no_row_for_a_similar_pair(spark, monkeypatch):
    monkeypatch.setattr(gb, "similar_billing", lambda *_, **__: pytest.fail("pairs became rows"))
    found = {(r.kind, r.type): r.n for r in queries.QUERIES["graph_statistics"](spark, SMALL).collect()}
    assert found[("edge", "SIMILAR_BILLING_PATTERN")] > 0


def test_a_round_does_not_sort_the_edges(spark):
    graph = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, weight double")
    restart = spark.createDataFrame([("a", 1.0), ("b", 0.0)], "node_id string, restart double")
    plan = ga.propagate(graph, restart, 0.8, rounds=2)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ShuffledHashJoin") == 2


@pytest.mark.parametrize("block_nodes", [1000, 7])
def test_the_autoencoder_in_blocks_equals_the_dense_one(spark, block_nodes):
    rng = np.random.default_rng(3)
    a = np.triu(rng.random((30, 30)) < 0.2, 1) | np.diag(np.ones(29, dtype=bool), 1)
    a = (a | a.T).astype(float)
    graph = spark.createDataFrame([(f"n{i:02}", f"n{j:02}", 1.0) for i, j in np.argwhere(a)], "src string, dst string, weight double")
    want, _ = embeddings._autoencode(a, 6, 3, 0.5, 4, 1)
    got = {r.node_id: r.vec for r in embeddings.autoencoder(graph, 6, 3, 0.5, 4, 1, block_nodes).collect()}
    assert np.allclose([got[f"n{i:02}"] for i in range(30)], want, rtol=0, atol=1e-12)
    start, _ = embeddings._autoencode(a, 6, 3, 0.5, 0, 1)
    assert len(got) == 30 and np.abs(want - start).max() > 1e-4


def test_the_autoencoder_takes_more_than_5000_nodes(spark):
    pairs = [(f"n{i:04}", f"n{(i + 1) % 5001:04}") for i in range(5001)]
    graph = spark.createDataFrame([(a, b, 1.0) for x in pairs for a, b in (x, x[::-1])], "src string, dst string, weight double")
    assert embeddings.autoencoder(graph, 4, 2, epochs=1).where("size(vec) = 2").count() == 5001


def test_walks_keep_their_steps_in_buckets(spark, monkeypatch):
    made, plain = [], ga._co_partitioned
    monkeypatch.setattr(ga, "_co_partitioned", lambda df, by, name: made.append((name, by)) or plain(df, by, name))
    graph = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, weight double")
    assert [r.path for r in embeddings.walks(graph, 3, 1).orderBy("start").collect()] == [["a", "b", "a"], ["b", "a", "b"]]
    assert made == [("walk_steps", ["src", "k"])]


@pytest.mark.parametrize("block", [gb.MERGED, 3])
def test_pairs_of_a_metapath_are_found_in_blocks_of_starts(spark, block):
    rng = np.random.default_rng(4)
    linked = rng.random((20, 9)) < 0.25
    linked[:, 0] = True
    linked[5:, 0] = False
    nodes = [(f"p{i:02}", "Provider_Org" if i % 2 else "Provider") for i in range(20)] + [(f"b{j}", "Beneficiary") for j in range(8)] + [("b8", "Claim")]
    edges = [(f"p{i:02}", f"b{j}") if i % 3 else (f"b{j}", f"p{i:02}") for i, j in np.argwhere(linked)]
    near = linked[:, :8].astype(int)
    expected = {(f"p{i:02}", f"p{j:02}", 2.0) for i in range(20) for j in range(i + 1, 20) if near[i] @ near[j]}
    made = gb.metapath_graph(spark.createDataFrame(nodes, "id string, node_type string"), spark.createDataFrame(edges * 2, "src string, dst string"), ["Provider", "Patient", "Provider"], block)
    rows = [tuple(r) for r in made.collect()]
    assert len(rows) == len(expected) and set(rows) == expected


def test_moves_of_communities_shuffle_no_edge(spark):
    rows = [(a, b, 1.0) for x in ("ab", "bc", "ca", "de", "ef", "fd", "cd") for a, b in (x, x[::-1])]
    graph = spark.createDataFrame(rows, "src string, dst string, weight double")
    edges = ga._co_partitioned(graph, "src", "graph")
    state = ga.written(edges.groupBy(ga.F.col("src").alias("node_id")).agg(ga.F.sum("weight").alias("k")).withColumn("community", ga.F.col("node_id")))
    plan = ga._best_moves(edges, state, 14.0, True)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(community" in plan and "hashpartitioning(node_id" not in plan and "hashpartitioning(src" not in plan and "hashpartitioning(to" not in plan
    found = [sorted(map(tuple, ga.communities(graph, copied_nodes=n).collect())) for n in (6, 5)]
    assert found[0] == found[1] == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("f", "d")]


def test_attributions_are_worked_out_once_for_a_pattern_and_by_many_tasks(spark, monkeypatch):
    """500 rows of two features know four patterns of a leaf at most; all of them came to one task, row by row."""
    rng = np.random.default_rng(5)
    leaves = [(0.7, np.array([1, 0]), np.array([0.3, 0.6]), np.array([-np.inf, 0.1]), np.array([0.5, 0.9])), (-0.2, np.array([], dtype=int), *[np.array([])] * 3)]
    x, seen, plain = rng.random((500, 2)), [], models._leaf_values
    monkeypatch.setattr(models, "_leaf_values", lambda one, zero: seen.append(len(one)) or plain(one, zero))
    got = models.shapley_values(x, leaves)
    assert seen == [4, 1] and np.allclose(got, np.concatenate([models.shapley_values(r[None], leaves) for r in x]), rtol=0, atol=1e-15)
    assert np.allclose(got.sum(axis=1), 0.7 * ((x[:, 1] <= 0.5) & (x[:, 0] > 0.1) & (x[:, 0] <= 0.9)) - 0.7 * 0.18)
    codes = rng.integers(0, 8, 50) << 20
    found, at = models._patterns(codes, 23)
    assert (found[at] == codes).all() and len(found) == len(set(codes))
    df = spark.createDataFrame([(f"n{k}", float(k), float(k % 7), int(k > 30)) for k in range(60)], "node_id string, x double, y double, label int").coalesce(1)
    parts = models.contributions(models.train(df, "random_forest", trees=2), df)[1]
    assert parts.rdd.getNumPartitions() == 4 and parts.count() == 60


@pytest.mark.parametrize("cell_links", [1000, 10])
def test_links_are_learnt_in_cells_as_by_spark_s_perceptron(spark, monkeypatch, cell_links):
    """Spark's, in blocks of one row, as it weighs a partition's last, shorter block like a whole one. No table holds the links' inputs."""
    rng, tables, plain = np.random.default_rng(6), [], models.written
    monkeypatch.setattr(models, "written", lambda df, name: tables.append(dict(df.dtypes)) or plain(df, name))
    edges = [(f"n{a:02}", f"n{b:02}") for a in range(20) for b in range(20) if a != b and rng.random() < 0.2] + [("n00", "unknown")]
    graph = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src string, dst string, weight double")
    vectors = spark.createDataFrame([(f"n{k:02}", rng.normal(size=3).tolist()) for k in range(20)], "node_id string, vec array<double>").cache()
    model, made = models.pretrain_links(graph, vectors, hidden=4, rounds=12, cell_links=cell_links)
    assert len(tables) == 2 and not any(kind in ("vector", "array<double>") for t in tables for kind in t.values())
    rows = made.collect()
    assert sorted((r.src, r.dst) for r in rows if r.label == 1) == sorted(edges[:-1])
    vec = {r.node_id: np.array(r.vec) for r in vectors.collect()}
    inputs = [np.concatenate((vec[r.src], vec[r.dst], vec[r.src] * vec[r.dst])) for r in rows]
    df = spark.createDataFrame([(r.label, Vectors.dense(x)) for r, x in zip(rows, inputs, strict=True)], ["label", "raw"])
    want = MultilayerPerceptronClassifier(featuresCol="raw", labelCol="label", layers=[9, 4, 2], maxIter=12, seed=42, blockSize=1).fit(df)
    assert np.allclose(model.weights.toArray(), want.weights.toArray(), rtol=1e-7, atol=1e-7)
    assert np.allclose([r.score for r in rows], [model.predictProbability(Vectors.dense(x))[1] for x in inputs], rtol=0, atol=1e-12)


def test_the_quasi_newton_method_reaches_the_least_value():
    by = np.array([1.0, 10.0, 100.0])
    found, told = models.quasi_newton(lambda x: (float(by @ (x - 1) ** 4 + (x - 1) @ (x - 1)), 4 * by * (x - 1) ** 3 + 2 * (x - 1)), np.array([3.0, -2.0, 0.5]), 100)
    assert np.allclose(found, 1, atol=1e-4) and told[-1] < 1e-7 and all(b < a for a, b in zip(told, told[1:], strict=False)) and len(told) < 60
