"""The findings of round 4: rounds that shuffled the edges' sums, or went over the edges more often than asked."""

import numpy as np
import pytest

from riskloom.operators import copied, embeddings, models
from riskloom.operators import graph_algorithms as ga


def _graph(spark, n=30, share=0.3, seed=1):
    rng = np.random.default_rng(seed)
    pairs = [(f"n{a:02d}", f"n{b:02d}", float(rng.integers(1, 4))) for a in range(n) for b in range(a) if rng.random() < share]
    return spark.createDataFrame([(a, b, w) for x, y, w in pairs for a, b in ((x, y), (y, x))], "src string, dst string, weight double")


@pytest.mark.parametrize("seeds", [["n01", "n07", "n07", "elsewhere"], ["elsewhere"]])
def test_an_ensemble_goes_over_the_edges_once_a_round(spark, monkeypatch, seeds):
    graph, seeds = ga.written(_graph(spark)), spark.createDataFrame([(s,) for s in seeds], "node_id string")
    names = ("pagerank", "rwr", "label_propagation")
    parts = ga.personalized_pagerank(graph, seeds, rounds=7, tolerance=None), ga.random_walk_with_restart(graph, seeds, rounds=7, tolerance=None), ga.label_propagation(graph, seeds, rounds=7)
    expected = [{r.node_id: r.score for r in part.collect()} for part in parts]
    monkeypatch.setattr(ga, "propagate", lambda *_, **__: pytest.fail("a loop of its own for one score"))
    rows = ga.baseline_ensemble(graph, seeds, 7).collect()
    for name, scores in zip(names, expected, strict=True):
        assert {r.node_id: r[name] for r in rows} == pytest.approx(scores, abs=1e-12)
    assert all(r.ensemble_score == pytest.approx(sum(r[c] for c in names) / 3) for r in rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_core_numbers_are_equal_either_way(spark, monkeypatch, seed):
    graph = ga.written(_graph(spark, 40, 0.12, seed))
    joined = {r.node_id: r.core for r in ga.core_number(graph, copied_nodes=0).collect()}
    monkeypatch.setattr(ga, "_co_partitioned", lambda *_, **__: pytest.fail("edges were laid out for joins"))
    assert len(set(joined.values())) > 1 and {r.node_id: r.core for r in ga.core_number(graph).collect()} == joined


@pytest.mark.parametrize("symmetric", [True, False])
def test_a_copied_block_has_the_singular_vectors_of_the_matrix(spark, monkeypatch, symmetric):
    rng = np.random.default_rng(3)
    dense = rng.random((24, 24)) * (rng.random((24, 24)) < 0.4)
    dense = dense + dense.T if symmetric else dense
    rows = [(f"n{a:02d}", f"n{b:02d}" if symmetric else f"m{b:02d}", float(dense[a, b])) for a, b in zip(*np.nonzero(dense), strict=True)]
    matrix = ga.written(spark.createDataFrame(rows, "a string, b string, weight double"))
    monkeypatch.setattr(embeddings, "_times", lambda *_, **__: pytest.fail("the matrix was joined with the block"))
    sigma, u = embeddings.singular_vectors(matrix, 3, 8, symmetric=symmetric)
    found = np.array([r.vec for r in u.orderBy("node_id").collect()])
    left, values, _ = np.linalg.svd(dense)
    assert sigma == pytest.approx(values[:3], rel=1e-6) and found.shape == (24, 3)
    assert np.abs(np.diag(found.T @ left[:, :3])) == pytest.approx(1, abs=1e-4)


def _network(spark):
    rng = np.random.default_rng(4)
    edges = [(f"n{a:02d}", f"n{b:02d}", k) for a, b in rng.integers(0, 24, (70, 2)) for k in (("T", "U") if a % 3 else ("T",))] + [("n01", "n02", "T"), ("n02", "n01", "T"), ("n03", "n03", "U")]
    features = [(f"n{k:02d}", [float(v) for v in rng.random(3)]) for k in range(20)] + [("alone", [0.5, 0.1, 0.9])]
    labels = [(f"n{k:02d}", int(k % 4 == 0)) for k in range(0, 23, 2)] + [("n01", None)]
    return [ga.written(df) for df in (spark.createDataFrame(features, "node_id string, vec array<double>"), spark.createDataFrame(edges, "src string, dst string, edge_type string"), spark.createDataFrame(labels, "node_id string, label int"))]


@pytest.mark.parametrize("which", ["forward", "train"])
def test_a_copied_network_equals_the_joined_one(spark, monkeypatch, which):
    features, edges, labels = _network(spark)
    weights = models.layer_weights([3, 5, 2], ["T"])

    def run():
        if which == "forward":
            return {r.node_id: list(r.vec) for r in models.graph_forward(features, edges, weights).collect()}, [], []
        found, scores, losses = models.train_network(features, edges, labels, 4, 3, epochs=3)
        return {r.node_id: [r.score] for r in scores.collect()}, losses, np.concatenate([w.reshape(-1) for w in found])

    with monkeypatch.context() as m:
        m.setattr(copied, "small", lambda *_: False)
        joined, losses, parts = run()
    monkeypatch.setattr(models, "_co_partitioned", lambda *_, **__: pytest.fail("edges were laid out for joins"))
    got, got_losses, got_parts = run()
    assert set(got) == set(joined) and len(got) >= 21
    assert np.array([got[k] for k in sorted(got)]) == pytest.approx(np.array([joined[k] for k in sorted(got)]), abs=1e-9)
    assert got_losses == pytest.approx(losses) and got_parts == pytest.approx(parts, abs=1e-9)
