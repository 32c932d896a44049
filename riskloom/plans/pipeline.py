"""The scoring pipeline: tables to graph to features to model to metrics, and the demonstration on synthetic tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.config import Settings
from riskloom.operators import claim_features, embeddings, models, ranking, validation
from riskloom.operators import graph_algorithms as ga
from riskloom.operators import graph_build as gb
from riskloom.sources import synthetic, tables

EDGE_TYPES = ("CO_BILLS_WITH", "REFERS_TO", "SHARES_FACILITY", "SHARES_BANK_ACCOUNT", "OWNED_BY")


@dataclass
class Result:
    """What a run leaves: scores (provider_id, risk_score, baseline_score, label), one row of metrics, contributions, sizes."""

    scores: DataFrame
    metrics: DataFrame
    explanations: DataFrame
    statistics: DataFrame
    model: PipelineModel


def run(providers: DataFrame, claims: DataFrame, exclusions: DataFrame, ownership: DataFrame | None = None, bank_accounts: DataFrame | None = None, settings: Settings | None = None, trees: int | None = None, edge_types: tuple[str, ...] = EDGE_TYPES) -> Result:
    """The graph and the features are written before what reads them more than once."""
    s = settings or Settings()
    nodes, edges = gb.build_graph(providers, claims, exclusions, ownership, bank_accounts, s.graph.co_billing_window_days, s.graph.similarity_threshold, similarity_code="procedure_code")
    nodes, edges = ga.written(nodes, "nodes"), ga.written(edges, "edges")
    seeds = exclusions.select(F.col("entity_npi").alias("node_id")).where("node_id is not null").distinct()
    who = providers.select(F.col("npi").alias("node_id")).distinct()
    structure = ga.written(ga.structural_features(nodes, edges, seeds, list(edge_types)), "structure")
    behaviour = claim_features.pipeline_claim_features(claims, providers).withColumnRenamed("provider_npi", "node_id")
    labels = seeds.withColumn("label", F.lit(1))
    table = ga.written(models.assemble(who, structure, behaviour).join(labels, "node_id", "left").fillna(0, ["label"]), "features")
    model = models.train(table, "gbt", s.random_seed, trees)
    scored = models.score(model, table).join(table.select("node_id", "label", F.col("pagerank_risk_score").alias("baseline")), "node_id")
    scored = ga.written(scored, "scores")
    rows = scored.select(F.col("node_id").alias("id"), "score", "label")
    base = scored.select(F.col("node_id").alias("id"), F.col("baseline").alias("score"), "label")
    k = s.investigator_capacity
    metrics = ranking.evaluate(rows, k).join(F.broadcast(ranking.lift(base, rows, k)))
    out = scored.select(F.col("node_id").alias("provider_id"), F.col("score").alias("risk_score"), F.col("baseline").alias("baseline_score"), "label")
    return Result(out, metrics, models.explain(model, table), gb.graph_statistics(nodes, edges), model)


def save(result: Result, folder: str) -> None:
    tables.write_scores(result.scores, f"{folder}/risk_scores")
    tables.write_json(result.metrics, f"{folder}/evaluation")
    tables.write_json(result.explanations, f"{folder}/explanations")
    tables.write_json(result.statistics, f"{folder}/graph_statistics")
    models.save_model(result.model, f"{folder}/model")


def demo(spark: SparkSession, folder: str | None = None, n_providers: int = 200, n_claims: int = 5000, seed: int = 42, trees: int = 20, k: int = 20) -> dict[str, DataFrame]:
    """Synthetic tables, validation, and five models compared: the full feature set, graph features, graph baselines with
    claim features, claim features alone, and personalised PageRank alone. With ``folder``, all of it is written."""
    t = {name: ga.written(df, name) for name, df in synthetic.generate(spark, n_providers, n_claims, seed=seed).items()}
    checked = validation.report(spark, t["providers"], t["claims"], t["exclusions"])
    nodes, edges = gb.build_graph(t["providers"], t["claims"], t["exclusions"], t["ownership"], t["bank_accounts"], window_days=1, similarity_threshold=0.98)
    nodes, edges = ga.written(nodes, "nodes"), ga.written(edges, "edges")
    seeds = t["exclusions"].select(F.col("entity_npi").alias("node_id")).distinct()
    who = t["providers"].select(F.col("npi").alias("node_id"))
    structure = ga.written(ga.structural_features(nodes, edges, seeds, ["CO_BILLS_WITH", "SHARES_BANK_ACCOUNT"]), "structure")
    behaviour = ga.written(claim_features.all_claim_features(claim_features.clean_claims(t["claims"]), t["providers"]).withColumnRenamed("provider_npi", "node_id"), "behaviour")
    between = ga.written(gb.project(edges, gb.provider_nodes(nodes), weighted=True), "between")
    baselines = ga.written(ga.baseline_ensemble(ga.written(gb.project(edges), "all-edges"), seeds, 20).join(who, "node_id", "left_semi"), "baselines")
    vectors = embeddings.wide(ga.written(embeddings.spectral(between, 8), "spectral"), "spectral_", 8)
    labels = seeds.withColumn("label", F.lit(1))
    sets = {"full_hybrid": (structure, behaviour, vectors), "graph_only": (structure,), "baseline_enhanced": (behaviour, baselines), "traditional_ml": (behaviour,)}
    scored, explained = {}, None
    for name, parts in sets.items():
        table = ga.written(models.assemble(who, *parts).join(labels, "node_id", "left").fillna(0, ["label"]), name)
        model = models.train(table, "random_forest" if name == "traditional_ml" else "gbt", seed, trees)
        scored[name] = ga.written(models.score(model, table).join(table.select("node_id", "label"), "node_id").select(F.col("node_id").alias("id"), "score", "label"), f"{name}-scores")
        if name == "full_hybrid":
            explained = models.explain(model, table, 10).withColumn("kind", models.feature_kind(F.col("feature")))
    scored["pure_pagerank"] = who.join(baselines, "node_id", "left").join(labels, "node_id", "left").select(F.col("node_id").alias("id"), F.coalesce("pagerank", F.lit(0.0)).alias("score"), F.coalesce("label", F.lit(0)).alias("label"))
    comparison = ga.written(ranking.compare_models(scored, k), "comparison")
    by = {r.model: r.auc_pr for r in comparison.collect()}
    gain = spark.createDataFrame([(ranking.relative_improvement(by["full_hybrid"], by["traditional_ml"]),)], "improvement_percent double")
    out = {"validation": checked, "graph_statistics": gb.graph_statistics(nodes, edges), "comparison": comparison, "explanations": explained, "report": ranking.risk_report(scored["full_hybrid"], k), "improvement": gain, "metrics": tables.long_metrics(comparison.drop("is_best"))}
    if folder:
        tables.write_tables(t, f"{folder}/data")
        for name, df in out.items():
            tables.write_json(df, f"{folder}/{name}")
        for name, df in scored.items():
            tables.write_csv(df, f"{folder}/scores/{name}")
    return out
