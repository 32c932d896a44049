import datetime as dt

import numpy as np
import pytest

from riskloom.operators import embeddings, models, ranking
from riskloom.operators import graph_algorithms as ga
from riskloom.operators import graph_build as gb


def graph(spark, *pairs):
    rows = [(a, b, 1.0) for a, b in pairs] + [(b, a, 1.0) for a, b in pairs]
    return spark.createDataFrame(rows, "src string, dst string, weight double")


def found(df, column):
    return {r.node_id: r[column] for r in df.collect()}


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node_id string")


PATH = [("A", "B"), ("B", "C"), ("C", "D")]
CLIQUES = [(x + str(i), x + str(j)) for x in "ab" for i in range(4) for j in range(i)] + [("a0", "b0")]


@pytest.mark.parametrize("hub", [1, 1000])
def test_path(spark, monkeypatch, hub):
    monkeypatch.setattr(ga, "HUB_EDGES", hub)
    g = graph(spark, *PATH)
    ppr = found(ga.personalized_pagerank(g, ids(spark, "A"), rounds=50, tolerance=None), "score")
    assert ppr == pytest.approx({"A": 0.3022, "B": 0.3582, "C": 0.2383, "D": 0.1013}, abs=1e-4)
    rwr = found(ga.random_walk_with_restart(g, ids(spark, "A"), rounds=20), "score")
    assert sum(rwr.values()) == pytest.approx(1)
    assert found(ga.random_walk_with_restart(g, ids(spark, "Z"), rounds=3, tolerance=None), "score") == dict.fromkeys("ABCD", 0.0)


def test_local_structure(spark):
    g = graph(spark, *PATH)
    assert found(ga.seed_distance(g, ids(spark, "A"), ids(spark, *"ABCDZ")), "distance") == {"A": 0, "B": 1, "C": 2, "D": 3, "Z": -1}
    assert set(found(ga.clustering(g), "clustering").values()) == {0.0}
    assert set(found(ga.core_number(g), "core").values()) == {1}
    t = graph(spark, ("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"))
    assert found(ga.clustering(t), "clustering") == pytest.approx({"a": 1, "b": 1, "c": 1 / 3, "d": 0})
    assert found(ga.core_number(t), "core") == {"a": 2, "b": 2, "c": 2, "d": 1}
    assert found(ga.ego_size(t, ids(spark, *"abcdz")), "ego_size") == {"a": 3, "b": 3, "c": 4, "d": 2, "z": 1}


def test_centralities(spark):
    star = spark.createDataFrame([("h", x, "T") for x in "abcd"], "src string, dst string, edge_type string")
    got = found(ga.degree_centrality(star), "degree_centrality")
    assert got == {"h": 1.0, **dict.fromkeys("abcd", 0.25)}
    assert set(found(ga.betweenness(star), "betweenness").values()) == {0.0}
    assert set(found(ga.eigenvector(star, 5), "eigenvector").values()) == {0.0}
    b = found(ga.betweenness(graph(spark, *CLIQUES)), "betweenness")
    assert sorted(b, key=b.get)[-2:] in (["a0", "b0"], ["b0", "a0"])
    assert b["a0"] == pytest.approx((3 * 4 * 2) / (7 * 6))


def test_communities(spark):
    g = graph(spark, *CLIQUES)
    parts = ga.communities(g)
    assert found(parts, "community") == {n: n[0] + "0" for n in (x + str(i) for x in "ab" for i in range(4))}
    assert ga.modularity(g, parts) > 0.4


def test_co_billing_rule(spark):
    d = lambda k: dt.datetime(2023, 1, 1) + dt.timedelta(days=k)
    rows = [("c1", "p", "x", d(0)), ("c2", "q", "x", d(10)), ("c3", "q", "x", d(-20)), ("c4", "p", "x", d(41)), ("c5", "q", "x", d(72)), ("c6", "p", None, d(0))]
    claims = spark.createDataFrame(rows, "claim_id string, provider_npi string, beneficiary_id string, date_of_service timestamp_ntz")
    got = sorted((r.src, r.dst, r.date.day, r.date_diff_days) for r in gb.co_bills_with(claims, 30).collect())
    assert got == [("p", "q", 1, 20)]  # the first in the window, not the closest; 31 days are too many
    assert sorted(r.date_diff_days for r in gb.co_bills_with(claims, 31).collect()) == [20, 31]


def test_similarity_prefixes_lose_nothing(spark):
    rng = np.random.default_rng(3)
    rows = [(f"p{int(rng.integers(12))}", f"c{int(rng.integers(6))}") for _ in range(150)]
    claims = spark.createDataFrame(rows, "provider_npi string, procedure_code string")
    v = {}
    for p, c in rows:
        v.setdefault(p, np.zeros(6))[int(c[1:])] += 1
    expected = {(a, b) for a in v for b in v if a < b and v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b]) >= 0.9}
    assert {(r.src, r.dst) for r in gb.similar_billing(claims, 0.9).collect()} == expected


def test_walks_and_vectors(spark):
    g = graph(spark, *CLIQUES)
    edges = {(r.src, r.dst) for r in g.collect()}
    for p, q in ((1.0, 1.0), (0.5, 2.0)):
        paths = embeddings.walks(g, 5, 3, p, q).collect()
        assert len(paths) == 24 and all(2 <= len(r.path) <= 5 and all(e in edges for e in zip(r.path, r.path[1:], strict=False)) for r in paths)
    assert sorted(map(str, embeddings.walks(g.repartition(7), 5, 3).collect())) == sorted(map(str, embeddings.walks(g, 5, 3).collect()))
    vec = {r.node_id: np.array(r.vec) for r in embeddings.spectral(g, 3).collect()}
    names = sorted(vec)
    a = np.array([[float((x, y) in edges) for y in names] for x in names])
    scale = 1 / np.sqrt(a.sum(axis=1))
    lap = np.eye(len(names)) - a * scale[:, None] * scale[None, :]
    first = np.array([vec[n][0] for n in names])
    assert np.linalg.norm(lap @ first - (first @ lap @ first) * first) < 1e-6
    _, losses = embeddings._autoencode(a, 8, 4, 0.5, 30, 1)
    assert losses[-1] < losses[0]


def test_metrics(spark):
    rows = [("a", 0.9, 1), ("b", 0.8, 0), ("c", 0.8, 1), ("d", 0.1, 0)]
    df = spark.createDataFrame(rows, "id string, score double, label int")
    assert ranking.average_precision(df).first()[0] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)
    assert ranking.roc_auc(df).first()[0] == pytest.approx((2 + 1.5) / 4)
    assert ranking.at_k(df, 8).first().precision_at_k == 0.25
    ones = df.where("label = 1")
    assert ranking.roc_auc(ones, 0.5).first()[0] == 0.5 and ranking.average_precision(df.where("label = 0")).first()[0] == 0.0
    assert ranking.at_k(df.where("label = 0"), 2).first().recall_at_k == 0.0
    assert [r.provider_id for r in ranking.risk_report(df, 3).collect()] == ["a", "b", "c"]


def test_models(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(f"n{k}", float(x), float(y), int(x + 0.1 * y > 0.8)) for k, (x, y) in enumerate(rng.normal(size=(200, 2)))]
    df = spark.createDataFrame(rows, "node_id string, x double, y double, label int")
    for kind in ("gbt", "random_forest", "logistic"):
        model = models.train(df, kind, trees=5)
        scored = models.score(model, df).join(df.select("node_id", "label"), "node_id").selectExpr("node_id as id", "score", "label")
        assert ranking.roc_auc(scored).first()[0] > 0.9
    models.save_model(model, str(tmp_path / "m"))
    assert models.explain(models.load_model(str(tmp_path / "m")), df, 1).first().feature == "x"
    odd = df.select("node_id", "x", "y").union(spark.createDataFrame([("odd", 9.0, -9.0)], "node_id string, x double, y double"))
    assert models.isolation_forest(odd, 20).orderBy("score", ascending=False).first().node_id == "odd"
    vec = df.selectExpr("node_id", "array(x, y) as vec", "label")
    _, losses = models.train_head(vec, 8)
    assert losses[-1] < losses[0]


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        yield [[items[0]], *rest]
        for k in range(len(rest)):
            yield [*rest[:k], [items[0], *rest[k]], *rest[k + 1 :]]


def quality_of(pairs, parts):
    of = {n: k for k, p in enumerate(parts) for n in p}
    m = 2 * len(pairs)
    degree = {}
    for a, b in pairs:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    inside = sum(2 for a, b in pairs if of[a] == of[b]) / m
    return inside - sum(sum(degree[n] for n in p) ** 2 for p in parts) / m**2


def test_communities_are_connected_and_near_the_best(spark):
    rng = np.random.default_rng(6)
    for _ in range(2):
        pairs = sorted({tuple(sorted(map(str, e))) for e in rng.integers(0, 8, (14, 2)).tolist() if e[0] != e[1]})
        g = graph(spark, *pairs)
        parts = ga.communities(g)
        best = max(quality_of(pairs, p) for p in partitions(sorted({n for e in pairs for n in e})))
        assert ga.modularity(g, parts) >= 0.9 * best - 1e-9
        assert sorted(map(tuple, ga.connected_parts(g, parts).collect())) == sorted(map(tuple, parts.collect()))


def test_disconnected_communities_are_cut(spark):
    g = graph(spark, ("a", "b"), ("c", "d"), ("b", "x"), ("x", "c"), *[(f"l{k}", f"l{k + 1}") for k in range(30)])
    parts = spark.createDataFrame([(n, "one") for n in "abcd"] + [("x", "two")] + [(f"l{k}", "line") for k in range(31)], "node_id string, community string")
    got = found(ga.connected_parts(g, parts), "community")
    assert [got[n] for n in "abcdx"] == ["a", "a", "c", "c", "x"] and {got[f"l{k}"] for k in range(31)} == {"l0"}
