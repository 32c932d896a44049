"""Registered queries over the test tables: thin calls into the operators, columns cast and rounded as in ``oracle.py``."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import columns, privacy
from riskloom.operators import claim_features, embeddings, graph_algorithms, graph_build, models, network, ranking, validation
from riskloom.sources import adapters, tables

SALT = "public test salt"
AS_OF = "2001-06-01"
ROUNDS = 20
K = 20
SIMILARITY = 0.975
#: Days of the co-billing graph that the analytics run on, as ``_graph`` has them.
GRAPH_WINDOW = 30

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def shaped(df: DataFrame, digits: int = 9, **exceptions: int) -> DataFrame:
    """Integers as bigint, doubles rounded to ``digits`` (or a column's own number)."""
    out = []
    for name, kind in df.dtypes:
        if kind in ("int", "smallint", "tinyint", "bigint"):
            out.append(F.col(name).cast("bigint").alias(name))
        elif kind in ("double", "float"):
            out.append(F.round(F.col(name), exceptions.get(name, digits)).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def _claims(spark, sf, *extra):
    return adapters.claims(spark, sf, *extra)


@query
def clean_claims(spark, sf):
    raw = _claims(spark, sf, "procedure_code")
    raw = raw.select("claim_id", F.concat(F.lit(" "), "provider_npi").alias("provider_npi"), "date_of_service", F.concat(F.lit("$"), F.col("billed_amount").cast("decimal(18,2)").cast("string")).alias("billed_amount"), (-F.col("paid_amount")).alias("paid_amount"), F.concat(F.lit(" "), F.substring("procedure_code", 1, 2), F.lit("."), F.substring("procedure_code", 3, 3)).alias("procedure_code"))
    return shaped(claim_features.clean_claims(raw).select("claim_id", "provider_npi", "date_of_service", "billed_amount", "paid_amount", "procedure_code"), 4)


@query
def date_parts(spark, sf):
    rows = _claims(spark, sf).select("claim_id", "date_of_service")
    return shaped(rows.select("claim_id", *[c.alias(k) for k, c in columns.date_parts(F.col("date_of_service")).items()], F.date_format(F.to_date("date_of_service"), "yyyy-MM-dd").alias("day")))


@query
def code_lookup(spark, sf):
    rows = _claims(spark, sf, "procedure_code")
    return shaped(rows.groupBy("procedure_code", F.coalesce(columns.em_level(F.col("procedure_code")), F.lit(0)).alias("level"), columns.minutes(F.col("procedure_code")).alias("minutes")).agg(F.count(F.lit(1)).alias("n")))


@query
def scaled_risk(spark, sf):
    rows = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"))
    rows = columns.min_max(rows, "x", "scaled").withColumn("risk", columns.sigmoid(F.col("scaled")))
    return shaped(rows.select("id", "scaled", "risk"))


@query
def hash_columns(spark, sf):
    return privacy.hash_columns(adapters.providers(spark, sf).select("npi", "provider_name"), ["npi", "provider_name", "absent"], SALT)


@query
def entity_id(spark, sf):
    rows = adapters.providers(spark, sf)
    return rows.select("npi", privacy.entity_id(SALT, F.col("npi"), F.lit(None), F.col("specialty")).alias("entity_id"))


@query
def verify_hash(spark, sf):
    rows = privacy.hash_columns(adapters.providers(spark, sf), ["npi"], SALT)
    return rows.select("npi", privacy.verify_hash(F.col("npi"), F.col("npi_hash"), SALT).alias("same"), privacy.verify_hash(F.col("provider_name"), F.col("npi_hash"), SALT).alias("other"))


@query
def token_lookup(spark, sf):
    path = f"{graph_algorithms.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    return privacy.token_table(adapters.providers(spark, sf), "npi", path, 16).select("id", F.length("token").cast("bigint").alias("n"))


@query
def temporal_features(spark, sf):
    return shaped(claim_features.temporal_features(_claims(spark, sf)), monthly_variation=4)


@query
def billing_features(spark, sf):
    return shaped(claim_features.billing_features(_claims(spark, sf, "beneficiary_id", "procedure_code")), total_billed=4, total_paid=4, avg_billed=4, std_billed=4, payment_ratio=8)


@query
def upcoding_features(spark, sf):
    return shaped(claim_features.upcoding_features(_claims(spark, sf, "procedure_code")))


@query
def impossible_days(spark, sf):
    return shaped(claim_features.impossible_days(_claims(spark, sf, "procedure_code")))


@query
def all_claim_features(spark, sf):
    df = claim_features.all_claim_features(_claims(spark, sf, "beneficiary_id", "procedure_code"), adapters.providers(spark, sf))
    return shaped(df, monthly_variation=4, total_billed=4, total_paid=4, avg_billed=4, std_billed=4, payment_ratio=8)


@query
def pipeline_claim_features(spark, sf):
    df = claim_features.pipeline_claim_features(_claims(spark, sf, "beneficiary_id"), adapters.providers(spark, sf))
    return shaped(df, total_billed=4, avg_billed=4)


# -- validation


@query
def validate_providers(spark, sf):
    return shaped(validation.provider_checks(adapters.providers(spark, sf)))


@query
def validate_claims(spark, sf):
    return shaped(validation.claim_checks(_claims(spark, sf), AS_OF))


@query
def validation_statistics(spark, sf):
    return shaped(validation.statistics(adapters.providers(spark, sf), _claims(spark, sf), adapters.exclusions(spark, sf)))


@query
def temporal_consistency(spark, sf):
    return validation.temporal_consistency(_claims(spark, sf), adapters.exclusions(spark, sf, "2001-01-01"))


@query
def validation_report(spark, sf):
    df = validation.report(spark, adapters.providers(spark, sf), _claims(spark, sf), adapters.exclusions(spark, sf), "2010-01-01")
    return df.select("table", "is_valid", "num_records", F.size("errors").cast("bigint").alias("n_errors"))


# -- graph construction


def _edges(spark, sf, kind):
    c = adapters
    return {
        "bills_for": lambda: graph_build.bills_for(_claims(spark, sf)),
        "treats": lambda: graph_build.treats(_claims(spark, sf, "beneficiary_id")),
        "refers_to": lambda: graph_build.refers_to(_claims(spark, sf, "referring_provider_npi")),
        "co_bills": lambda: graph_build.co_bills_with(_claims(spark, sf, "beneficiary_id"), 30),
        "flagged_by": lambda: graph_build.flagged_by(c.exclusions(spark, sf)),
        "owned_by": lambda: graph_build.owned_by(c.ownership(spark, sf)),
        "shares_facility": lambda: graph_build.shares_facility(_claims(spark, sf, "facility_id")),
        "shares_bank": lambda: graph_build.shares_bank_account(c.bank_accounts(spark, sf)),
        "similar_billing": lambda: graph_build.similar_billing(_claims(spark, sf, "brand_code"), SIMILARITY, "brand_code"),
    }[kind]()


EDGE_COLUMNS = {"bills_for": ("date", "amount"), "treats": ("date",), "refers_to": ("date",), "co_bills": ("date", "beneficiary", "date_diff_days"), "flagged_by": ("date",), "owned_by": ("ownership_percentage",), "shares_facility": (), "shares_bank": (), "similar_billing": ("similarity",)}
for _kind, _columns in EDGE_COLUMNS.items():
    QUERIES[f"edges_{_kind}"] = partial(lambda spark, sf, kind, own: shaped(_edges(spark, sf, kind).select("src", "dst", "edge_type", *own)), kind=_kind, own=_columns)


def _graph_claims(spark, sf):
    return graph_algorithms.written(_claims(spark, sf, "beneficiary_id", "facility_id", "referring_provider_npi", "procedure_code"), "claims")


def _graph(spark, sf, types=None, claims=None):
    """The whole graph, or its edges of some ``types``."""
    claims = claims or _graph_claims(spark, sf)
    return graph_build.build_graph(adapters.providers(spark, sf), claims, adapters.exclusions(spark, sf), adapters.ownership(spark, sf), adapters.bank_accounts(spark, sf), edge_types=types)


@query
def graph_nodes(spark, sf):
    return _graph(spark, sf)[0].select("id", "node_type", "specialty", "state", "source", "role")


@query
def graph_statistics(spark, sf):
    """Of the whole graph; the ends of similar pairs, nearly all pairs of providers, are counted where they are found."""
    claims = _graph_claims(spark, sf)
    nodes, edges = _graph(spark, sf, set(graph_build.LINKS) - {"SIMILAR_BILLING_PATTERN"}, claims)
    return shaped(graph_build.graph_statistics(nodes, edges, graph_build.similar_billing_ends(claims)))


@query
def metapath_graph(spark, sf):
    """An id of the test tables has one form for each node type, so the path's edge types are all that it needs."""
    path = ["Provider", "BankAccount", "Provider"]
    nodes, edges = _graph(spark, sf, graph_build.path_edge_types([path]))
    return shaped(graph_build.metapath_graph(nodes, edges, path))


# -- graph analytics, on providers that co-bill within 30 days


def _co_billing(spark, sf):
    return graph_build.co_bills_with(_claims(spark, sf, "beneficiary_id"), GRAPH_WINDOW)


def _projection(spark, sf, weighted=False):
    return graph_algorithms.written(graph_build.project(_co_billing(spark, sf), weighted=weighted), "graph")


def _seeds(spark, sf):
    return adapters.exclusions(spark, sf).select(F.col("entity_npi").alias("node_id"))


@query
def provider_projection(spark, sf):
    return shaped(graph_build.project(_co_billing(spark, sf), adapters.providers(spark, sf).select(F.col("npi").alias("id")), weighted=True))


@query
def degree_centrality(spark, sf):
    edges = _co_billing(spark, sf).unionByName(graph_build.owned_by(adapters.ownership(spark, sf)))
    return shaped(graph_algorithms.degree_centrality(edges))


@query
def degree(spark, sf):
    return shaped(graph_algorithms.degree(_projection(spark, sf)))


@query
def personalized_pagerank(spark, sf):
    return shaped(graph_algorithms.personalized_pagerank(_projection(spark, sf, True), _seeds(spark, sf), rounds=ROUNDS, tolerance=None))


@query
def pagerank_by_joins(spark, sf):
    """The loop with every node's edges outside the buckets, as those of hubs are."""
    graph = _projection(spark, sf, True)
    return shaped(graph_algorithms.personalized_pagerank(graph, _seeds(spark, sf), rounds=ROUNDS, tolerance=None, hub_edges=0))


@query
def random_walk_restart(spark, sf):
    return shaped(graph_algorithms.random_walk_with_restart(_projection(spark, sf), _seeds(spark, sf), rounds=ROUNDS, tolerance=None))


@query
def label_propagation(spark, sf):
    return shaped(graph_algorithms.label_propagation(_projection(spark, sf), _seeds(spark, sf), rounds=ROUNDS))


def _ensemble(spark, sf):
    return graph_algorithms.written(shaped(graph_algorithms.baseline_ensemble(_projection(spark, sf), _seeds(spark, sf), ROUNDS), 7), "ensemble")


@query
def baseline_ensemble(spark, sf):
    return _ensemble(spark, sf)


@query
def consensus_risk(spark, sf):
    return shaped(ranking.consensus(_ensemble(spark, sf), ["pagerank", "rwr", "label_propagation"], K).select("node_id", "avg_rank"))


@query
def top_risk_providers(spark, sf):
    scores = shaped(graph_algorithms.personalized_pagerank(_projection(spark, sf, True), _seeds(spark, sf), rounds=ROUNDS, tolerance=None), 7)
    return graph_algorithms.top_risk(scores, K, _seeds(spark, sf))


@query
def clustering_coefficient(spark, sf):
    return shaped(graph_algorithms.clustering(_projection(spark, sf)))


@query
def ego_network_size(spark, sf):
    return shaped(graph_algorithms.ego_size(_projection(spark, sf), adapters.providers(spark, sf).select(F.col("npi").alias("node_id"))))


@query
def distance_to_seeds(spark, sf):
    return shaped(graph_algorithms.seed_distance(_projection(spark, sf), _seeds(spark, sf), adapters.providers(spark, sf).select(F.col("npi").alias("node_id"))))


@query
def core_number(spark, sf):
    return shaped(graph_algorithms.core_number(_projection(spark, sf)))


@query
def betweenness(spark, sf):
    return shaped(graph_algorithms.betweenness(_co_billing(spark, sf)))


@query
def eigenvector(spark, sf):
    return shaped(graph_algorithms.eigenvector(_projection(spark, sf), 10), 7)


@query
def louvain(spark, sf):
    graph = _projection(spark, sf, True)
    who = adapters.providers(spark, sf).select(F.col("npi").alias("node_id"))
    return shaped(graph_algorithms.community_features(graph_algorithms.communities(graph), who, _seeds(spark, sf)))


@query
def community_statistics(spark, sf):
    """Sizes and rates of a given partition: providers by their state, of those that co-bill."""
    nodes = graph_algorithms.vertices(_projection(spark, sf))
    who = adapters.providers(spark, sf).select(F.col("npi").alias("node_id"), F.col("license_state").alias("community"))
    parts = nodes.join(who, "node_id")
    return shaped(graph_algorithms.community_features(parts, who.select("node_id"), _seeds(spark, sf)))


@query
def baseline_evaluation(spark, sf):
    """Mean scores of seeds and of others."""
    labels = adapters.providers(spark, sf).select(F.col("npi").alias("node_id")).join(_seeds(spark, sf).distinct().withColumn("label", F.lit(1)), "node_id", "left").fillna(0, ["label"])
    scores = _ensemble(spark, sf).select("node_id", F.col("ensemble_score").alias("score"))
    return shaped(graph_algorithms.evaluate_scores(scores, labels), 6)


@query
def predicted_risk(spark, sf):
    """Scores of all providers, 0 where the graph doesn't know them."""
    scores = shaped(graph_algorithms.personalized_pagerank(_projection(spark, sf, True), _seeds(spark, sf), rounds=ROUNDS, tolerance=None), 7)
    return graph_algorithms.predict_risk(scores, adapters.providers(spark, sf).select(F.col("npi").alias("node_id")))


@query
def embedding_lookup(spark, sf):
    """The vectors of the seeds, one column for each dimension."""
    vectors = spark.read.parquet(f"{sf}/supplier.parquet").select(F.lpad(F.col("s_suppkey").cast("string"), 10, "0").alias("node_id"), F.array(F.col("s_acctbal"), F.col("s_nationkey").cast("double")).alias("vec"))
    return shaped(embeddings.wide(embeddings.lookup(vectors, _seeds(spark, sf)), "e", 3))


# -- sources and sinks: written, read again


def _read_again(spark, sf, table, df, load, *columns):
    folder = f"{graph_algorithms.shared_dir(spark)}/tables-{uuid.uuid4().hex}"
    tables.write_tables({table: df}, folder)
    return load(f"{folder}/{table}").select(*columns)


@query
def scan_providers(spark, sf):
    df = _read_again(spark, sf, "providers", adapters.providers(spark, sf), lambda p: tables.load_providers(spark, p, SALT), "npi", "provider_name", "specialty", "license_state", "provider_name_hash", "node_type")
    return df


@query
def scan_claims(spark, sf):
    return shaped(_read_again(spark, sf, "claims", _claims(spark, sf, "beneficiary_id"), lambda p: tables.load_claims(spark, p, SALT), "claim_id", "provider_npi", "beneficiary_id", "date_of_service", "billed_amount", "beneficiary_hash"), 4)


@query
def scan_exclusions(spark, sf):
    return _read_again(spark, sf, "exclusions", adapters.exclusions(spark, sf), lambda p: tables.load_exclusions(spark, p), "entity_npi", "exclusion_date", "exclusion_source")


@query
def scan_ownership(spark, sf):
    return shaped(_read_again(spark, sf, "ownership", adapters.ownership(spark, sf), lambda p: tables.load_ownership(spark, p, SALT), "provider_npi", "owner_id", "ownership_percentage", "owner_hash"))


@query
def scan_bank_accounts(spark, sf):
    return _read_again(spark, sf, "bank_accounts", adapters.bank_accounts(spark, sf), lambda p: tables.load_bank_accounts(spark, p), "provider_npi", "account_hash")


@query
def score_sink(spark, sf):
    """Scores written as the pipeline writes them, and read again."""
    path = f"{graph_algorithms.shared_dir(spark)}/scores-{uuid.uuid4().hex}"
    scores = _scored(spark, sf).select(F.col("id").alias("provider_id"), F.col("score").alias("risk_score"), (F.col("score") / 2).alias("baseline_score"), "label")
    tables.write_scores(scores, path)
    return shaped(spark.read.option("header", True).schema(scores.schema).csv(path))


@query
def json_sink(spark, sf):
    path = f"{graph_algorithms.shared_dir(spark)}/metrics-{uuid.uuid4().hex}"
    rows = ranking.at_k(_scored(spark, sf), K)
    tables.write_json(rows, path)
    return shaped(spark.read.schema(rows.schema).json(path))


# -- ranking, of scores that both engines compute alike


def _scored(spark, sf, by: int = 7):
    s = F.col("s_suppkey")
    return spark.read.parquet(f"{sf}/supplier.parquet").select(F.lpad(s.cast("string"), 10, "0").alias("id"), ((s * by % 50) / 50.0).alias("score"), F.when(s % 10 == 3, 1).otherwise(0).alias("label"))


@query
def pr_curve(spark, sf):
    return shaped(ranking.pr_curve(_scored(spark, sf)))


@query
def average_precision(spark, sf):
    return shaped(ranking.average_precision(_scored(spark, sf)))


@query
def roc_auc(spark, sf):
    return shaped(ranking.roc_auc(_scored(spark, sf)))


@query
def precision_recall_at_k(spark, sf):
    return shaped(ranking.at_k(_scored(spark, sf), K))


@query
def lift_at_k(spark, sf):
    return shaped(ranking.lift(_scored(spark, sf, 3), _scored(spark, sf), K))


@query
def optimal_threshold(spark, sf):
    return shaped(ranking.optimal_threshold(_scored(spark, sf)))


@query
def risk_report(spark, sf):
    return shaped(ranking.risk_report(_scored(spark, sf), K))


@query
def model_comparison(spark, sf):
    df = ranking.compare_models({f"model_{b}": _scored(spark, sf, b) for b in (3, 7, 9)}, K)
    return shaped(df.select("model", "auc_pr", "auc_roc", "precision_at_k", "recall_at_k", "is_best"))


# -- embeddings and models: rows only, or checked by their invariants in the tests


@query
def cooccurrence(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderpriority"))).alias("o"))
    paths = rows.select(F.col("o_custkey").alias("walk_id"), F.transform("o", lambda x: x["o_orderpriority"]).alias("path"))
    return shaped(embeddings.cooccurrence(paths, 3), 6)


@query
def node2vec(spark, sf):
    return embeddings.node2vec(_projection(spark, sf), 16, 8, 5, window=3)


@query
def spectral(spark, sf):
    return embeddings.spectral(_projection(spark, sf), 8)


@query
def structural_embedding(spark, sf):
    return embeddings.structural(_projection(spark, sf))


@query
def metapath_embedding(spark, sf):
    """All default metapaths, over the edges that they can go over."""
    nodes, edges = _graph(spark, sf, graph_build.path_edge_types(embeddings.METAPATHS))
    nodes = graph_algorithms.written(nodes.select("id", "node_type"), "nodes")
    edges = graph_algorithms.written(edges.select("src", "dst").distinct(), "edges")
    return embeddings.metapath(nodes, edges, dimensions=8, length=5, per_node=10)


@query
def graph_autoencoder(spark, sf):
    return embeddings.autoencoder(_projection(spark, sf), 32, 8, epochs=20)


def _labelled(spark, sf):
    features = all_claim_features(spark, sf).withColumnRenamed("provider_npi", "node_id")
    seeds = _seeds(spark, sf).distinct().withColumn("label", F.lit(1))
    return graph_algorithms.written(features.join(seeds, "node_id", "left").fillna(0, ["label"]), "labelled")


@query
def risk_scores_gbt(spark, sf):
    df = _labelled(spark, sf)
    return models.score(models.train(df, "gbt", trees=10), df)


@query
def risk_scores_forest(spark, sf):
    df = _labelled(spark, sf)
    return models.score(models.train(df, "random_forest", trees=20), df)


@query
def risk_scores_logistic(spark, sf):
    df = _labelled(spark, sf)
    return models.score(models.train(df, "logistic"), df)


@query
def isolation_forest(spark, sf):
    return models.isolation_forest(_labelled(spark, sf).drop("label"), trees=25)


@query
def explanations(spark, sf):
    df = _labelled(spark, sf)
    return models.explain(models.train(df, "random_forest", trees=10), df, 5).withColumn("kind", models.feature_kind(F.col("feature")))


@query
def graph_network(spark, sf):
    features = _labelled(spark, sf).select("node_id", F.array(F.log1p("total_claims"), "weekend_ratio", "high_value_ratio").alias("vec"))
    weights = models.layer_weights([3, 8, 4], ["CO_BILLS_WITH"])
    return models.graph_forward(features, _co_billing(spark, sf).select("src", "dst", "edge_type"), weights)


@query
def trained_network(spark, sf):
    """Scores of the network trained end to end on the seeds."""
    df = _labelled(spark, sf)
    features = df.select("node_id", F.array(F.log1p("total_claims"), "weekend_ratio", "high_value_ratio", F.lit(1.0)).alias("vec"))
    return models.train_network(features, _co_billing(spark, sf).select("src", "dst", "edge_type"), df.select("node_id", "label"), epochs=5)[1]


@query
def sampled_network(spark, sf):
    """Scores of a network of three layers, trained on sampled neighbourhoods in mini-batches."""
    df = _labelled(spark, sf)
    features = df.select("node_id", F.array(F.log1p("total_claims"), "weekend_ratio", "high_value_ratio", F.lit(1.0)).alias("vec"))
    return network.train(features, _co_billing(spark, sf).select("src", "dst", "edge_type"), df.select("node_id", "label"), sizes=(8, 8, 4), fanout=3, batches=2, epochs=3)[1]


@query
def assembled_features(spark, sf):
    """Baseline scores of all providers with claim and graph features beside them, 0 where one knows no value."""
    claims = _claims(spark, sf, "procedure_code")
    rename = lambda df: df.withColumnRenamed("provider_npi", "node_id")
    base = adapters.providers(spark, sf).select(F.col("npi").alias("node_id"))
    return shaped(models.assemble(base, rename(claim_features.upcoding_features(claims)), rename(claim_features.impossible_days(claims)), graph_algorithms.degree(_projection(spark, sf))))


@query
def class_weights(spark, sf):
    """The weight of each provider's row in training, seeds against others."""
    seeds = _seeds(spark, sf).distinct().withColumn("label", F.lit(1))
    rows = adapters.providers(spark, sf).select(F.col("npi").alias("node_id")).join(seeds, "node_id", "left").fillna(0, ["label"])
    return shaped(models.with_weights(rows))


@query
def embedding_ensemble(spark, sf):
    return embeddings.ensemble(_projection(spark, sf))


@query
def link_prediction(spark, sf):
    graph = _projection(spark, sf)
    return models.pretrain_links(graph, graph_algorithms.written(embeddings.spectral(graph, 8), "spectral"))[1]


@query
def focal_loss(spark, sf):
    rows = _scored(spark, sf).select("id", models.focal_loss(F.col("label"), F.col("score")).alias("loss"))
    return shaped(rows)


@query
def metrics_long(spark, sf):
    return shaped(tables.long_metrics(model_comparison(spark, sf).drop("is_best")))


def queries() -> dict[str, Query]:
    return dict(QUERIES)
