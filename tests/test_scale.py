"""Running totals by range partition, validation by the columns present, limits that tell, and the command line."""

import datetime as dt
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import graph_algorithms as ga
from riskloom.operators import graph_build as gb
from riskloom.operators import models, ordered, ranking, validation
from riskloom.plans import cli
from riskloom.sources import synthetic, tables


def test_running_totals(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), int(n)) for k, n in zip(rng.permutation(500), rng.integers(0, 9, 500), strict=True)] + [(None, 4), (600, None)]
    df = spark.createDataFrame(rows, "k int, n int").repartition(5)
    got = {r.k: (r.upto, r.upto_all) for r in ordered.with_running_totals(df, [F.asc("k")], {"upto": "n"}).collect()}
    total, expected = 0, {}
    for k, n in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        total += n or 0
        expected[k] = total
    assert got == {k: (v, total) for k, v in expected.items()}
    assert ordered.with_running_totals(df.limit(0), [F.asc("k")], {"upto": "n"}).count() == 0
    names = ordered.numbered(df.where("k is not null").select("k"), "k", "i").collect()
    assert sorted((r.i, r.k) for r in names) == list(enumerate(sorted(k for k, _ in rows if k is not None)))


def test_curves_need_no_window_over_all_rows(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("id"), (F.col("id") / 100).alias("score"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    plan = ranking._thresholds(df)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Window [" in line and "part_" not in line and "t_" not in line]
    ranks = {r.id: r.score_rank for r in ranking.average_ranks(df, ["score"]).collect()}
    assert ranks["99"] == 1.0 and ranks["0"] == 100.0


def test_negative_edges(spark):
    edges = spark.createDataFrame([(f"a{i}", f"b{j}") for i in range(8) for j in range(i)], "src string, dst string")
    drawn = models.negative_edges(edges).collect()
    assert len(drawn) == edges.count() and {r.dst for r in drawn} <= {f"a{i}" for i in range(8)} | {f"b{i}" for i in range(8)}


def test_contributions_add_up(spark):
    rng = np.random.default_rng(0)
    rows = [(f"n{k}", float(x), float(y), float(z), int(x + 0.2 * y > 0.6)) for k, (x, y, z) in enumerate(rng.normal(size=(300, 3)))]
    df = spark.createDataFrame(rows, "node_id string, x double, y double, z double, label int")
    raw = lambda m, column: {r.node_id: r[column][1] for r in m.transform(df).select("node_id", column).collect()}
    for kind, column, scale in (("random_forest", "probability", 1.0), ("gbt", "rawPrediction", 1.0), ("logistic", "rawPrediction", 1.0)):
        model = models.train(df, kind, trees=6)
        base, parts = models.contributions(model, df)
        expected = raw(model, column)
        for r in parts.collect():
            assert base + sum(r.vec) == pytest.approx(scale * expected[r.node_id], abs=1e-9)
        assert models.explain(model, df, 2).first().feature == "x"


def test_network_training(spark):
    rng = np.random.default_rng(3)
    names = [f"n{k}" for k in range(24)]
    features = spark.createDataFrame([(n, [float(x) for x in rng.normal(size=2)] + [1.0]) for n in names], "node_id string, vec array<double>")
    edges = spark.createDataFrame([(names[i], names[j], "AB"[(i + j) % 2]) for i in range(24) for j in rng.integers(0, 24, 2).tolist() if i != j], "src string, dst string, edge_type string")
    labels = spark.createDataFrame([(n, int(k < 8)) for k, n in enumerate(names[:20])], "node_id string, label int")
    shares = models.written(models.heard_shares(edges), "shares")
    inputs = models.written(models._gathered(features, shares, ["A", "B"], 3), "inputs")
    weights = [rng.normal(size=(9, 3)), rng.normal(size=(9, 2)), rng.normal(size=3)]
    _, slopes = models.network_gradients(inputs, labels, shares, ["A", "B"], weights)
    for k, at in ((0, (1, 2)), (0, (5, 0)), (1, (3, 1)), (2, (2,))):  # against differences of the loss
        step = 1e-5
        up, down = [w.copy() for w in weights], [w.copy() for w in weights]
        up[k][at] += step
        down[k][at] -= step
        loss = [models.network_gradients(inputs, labels, shares, ["A", "B"], w)[0] for w in (up, down)]
        assert slopes[k][at] == pytest.approx((loss[0] - loss[1]) / 2 / step, abs=1e-6)
    _, scores, losses = models.train_network(features, edges, labels, 4, 3, epochs=4)
    assert losses[-1] < losses[0] and scores.count() == 24 and scores.where("score < 0 or score > 1").isEmpty()


def test_link_pretraining(spark):
    pairs = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "ab" for i in range(10) for j in range(10) if i != j]
    edges = spark.createDataFrame(pairs, "src string, dst string, weight double")
    vectors = spark.createDataFrame([(f"{g}{i}", [1.0, i / 10] if g == "a" else [-1.0, i / 10]) for g in "ab" for i in range(10)], "node_id string, vec array<double>")
    _, rows = models.pretrain_links(edges, vectors)
    assert ranking.roc_auc(rows.selectExpr("concat(src, dst) as id", "score", "int(label) as label")).first()[0] > 0.9


def test_relative_improvement():
    assert ranking.relative_improvement(0.6, 0.5) == pytest.approx(20.0) and ranking.relative_improvement(0.6, 0.0) == 0.0


def test_each_check_needs_its_own_columns_only(spark):
    late = dt.datetime.now() + dt.timedelta(days=400)
    dates = spark.createDataFrame([("c", "p", "x"), ("d", "p", late.isoformat(" "))], "claim_id string, provider_npi string, date_of_service string")
    ok, errors = validation.validate("claims", dates)
    assert not ok and errors == ["Found 1 unreadable dates of service", "Found 1 claims with future dates"]
    assert validation.validate("claims", dates, "9999-12-31")[1] == ["Found 1 unreadable dates of service"]
    amounts = spark.createDataFrame([("c", "p", -1.0)], "claim_id string, provider_npi string, billed_amount double")
    assert validation.validate("claims", amounts)[1] == ["Missing required column: date_of_service", "Found 1 claims with negative billed amounts"]
    assert validation.validate("exclusions", amounts)[1] == ["Missing required column: entity_npi", "Missing required column: exclusion_date"]


def test_betweenness_beyond_its_limits_is_told(spark, monkeypatch):
    star = spark.createDataFrame([(f"h{i}", f"t{j}", "T") for i in range(3) for j in range(4)], "src string, dst string, edge_type string")
    monkeypatch.setattr(ga, "BETWEENNESS_NODES", 7)
    assert {r.betweenness for r in ga.betweenness(star).collect()} == {None}


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("Context", (), {"master": "spark://somewhere:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ga.shared_dir(Session)


def test_scans_of_ownership_and_accounts(spark, tmp_path):
    owners = spark.createDataFrame([("1", "o1", "x"), ("0000000002", "o2", "30.5")], "provider_npi string, owner_id string, ownership_percentage string").withColumn("owner_role", F.lit("Owner"))
    accounts = spark.createDataFrame([("1", "h1")], "provider_npi string, account_hash string")
    tables.write_tables({"ownership": owners, "bank_accounts": accounts}, str(tmp_path))
    got = tables.load_ownership(spark, f"{tmp_path}/ownership", "salt").collect()
    assert sorted((r.owner_id, r.ownership_percentage, len(r.owner_hash)) for r in got) == [("o1", 0.0, 64), ("o2", 30.5, 64)]
    assert [r.account_hash for r in tables.load_bank_accounts(spark, f"{tmp_path}/bank_accounts").collect()] == ["h1"]
    with pytest.raises(ValueError, match="account_hash"):
        tables.load_bank_accounts(spark, f"{tmp_path}/ownership")


def test_statistics_in_one_pass(spark):
    made = synthetic.generate(spark, 20, 60)
    nodes, edges = gb.build_graph(made["providers"], made["claims"], made["exclusions"], made["ownership"], made["bank_accounts"])
    rows = edges.select("src", "dst", "edge_type").collect()
    types = {r.id: r.node_type for r in nodes.select("id", "node_type").collect()}
    ends = {x for r in rows for x in (r.src, r.dst)}
    got = {(r.kind, r.type): r.n for r in gb.graph_statistics(nodes, edges).collect()}
    count = Counter(types.values()) + Counter({"Unknown": len(ends - set(types))})
    assert {k: v for (kind, k), v in got.items() if kind == "edge" and k != "total"} == Counter(r.edge_type for r in rows) and got["edge", "total"] == len(rows)
    assert {k: v for (kind, k), v in got.items() if kind == "node" and k != "total"} == +count and got["node", "total"] == sum(count.values())


def test_command_line(spark, tmp_path, monkeypatch):
    made = synthetic.generate(spark, 30, 120)
    tables.write_tables(made, str(tmp_path / "in"))
    args = [x for k in made for x in (f"--{k.replace('_', '-')}", str(tmp_path / "in" / k))] + ["--output-dir", str(tmp_path / "out"), "--capacity", "7"]
    seen = {}

    def run(providers, claims, exclusions, ownership, bank_accounts, settings, trees):
        seen.update(providers=providers.count(), claims=claims.count(), hashed="beneficiary_hash" in claims.columns, owners=ownership.count(), k=settings.investigator_capacity, trees=trees)
        rows = spark.createDataFrame([("1", 0.5, 0.25, 1)], "provider_id string, risk_score double, baseline_score double, label int")
        return cli.pipeline.Result(rows, rows.selectExpr("risk_score as auc_pr"), rows, rows, type("Model", (), {"write": lambda self: self, "overwrite": lambda self: self, "save": lambda self, path: seen.update(model=path)})())

    monkeypatch.setattr(cli.pipeline, "run", run)
    assert cli.main([*args, "--salt", "s"]) == 0
    assert seen == {"providers": made["providers"].count(), "claims": made["claims"].count(), "hashed": True, "owners": made["ownership"].count(), "k": 7, "trees": None, "model": f"{tmp_path}/out/model"}
    assert spark.read.option("header", True).csv(f"{tmp_path}/out/risk_scores").first().provider_id == "1"
    monkeypatch.delenv("HASH_SALT", raising=False)
    with pytest.raises(SystemExit):
        cli.main(args)
    monkeypatch.setattr(cli.pipeline, "run", lambda *a: 1 / 0)
    assert cli.main([*args, "--salt", "s"]) == 1


def test_betweenness_against_brute_force(spark):
    rng = np.random.default_rng(8)
    edges = {(f"n{a}", f"n{b}") for a, b in rng.integers(0, 14, (40, 2)).tolist()}
    df = spark.createDataFrame([(a, b, "T") for a, b in edges] * 2, "src string, dst string, edge_type string")
    out = {}
    for a, b in edges:
        if a != b:
            out.setdefault(a, []).append(b)
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})

    def shortest(s):
        paths, level = {s: [[s]]}, [s]
        while level:
            ahead = {}
            for v in level:
                for w in out.get(v, []):
                    if w not in paths:
                        ahead.setdefault(w, []).extend(p + [w] for p in paths[v])
            paths |= ahead
            level = list(ahead)
        return paths

    every = {s: shortest(s) for s in nodes}
    want = {v: sum(sum(v in p[1:-1] for p in ps) / len(ps) for found in every.values() for ps in found.values()) / ((len(nodes) - 1) * (len(nodes) - 2)) for v in nodes}
    got = {r.node_id: r.betweenness for r in ga.betweenness(df).collect()}
    assert got == pytest.approx(want)
    sampled = {r.node_id: r.betweenness for r in ga.betweenness(df, most_sources=5).collect()}
    assert set(sampled) == set(want) and max(sampled.values()) > 0


def test_a_round_of_propagation_shuffles_once(spark):
    rows = [(f"n{k}", f"n{(k * 7 + j) % 50}", 1.0) for k in range(50) for j in range(1, 4)]
    graph = spark.createDataFrame(rows, "src string, dst string, weight double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        restart = ga.restart_vector(graph, graph.select(F.col("src").alias("node_id")).limit(3))
        plan = ga.propagate(graph, restart, 0.8, rounds=4)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 4
