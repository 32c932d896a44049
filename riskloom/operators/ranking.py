"""Ranking metrics of scored, labelled rows (id, score, label 0 or 1). Ties of top-k and reports go by ascending id.

Curves and average ranks work on counts by distinct score, added before the shuffle; their running totals are taken within range
partitions and added up over these, so that no task needs all scores however many are distinct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.ordered import with_running_totals


def _thresholds(scored: DataFrame) -> DataFrame:
    """By descending distinct score: score, n, pos, and running totals (n_upto, pos_upto); totals of all rows (n_all, pos_all)."""
    by = scored.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"))
    return with_running_totals(by, [F.desc("score")], {"n_upto": "n", "pos_upto": "pos"}).withColumnsRenamed({"n_upto_all": "n_all", "pos_upto_all": "pos_all"})


def pr_curve(scored: DataFrame) -> DataFrame:
    """(threshold, precision, recall) at each distinct score, and the end point (null, 1, 0)."""
    points = _thresholds(scored).select(F.col("score").alias("threshold"), (F.col("pos_upto") / F.col("n_upto")).alias("precision"), F.coalesce(F.try_divide("pos_upto", "pos_all"), F.lit(1.0)).alias("recall"))
    return points.union(scored.sparkSession.createDataFrame([(None, 1.0, 0.0)], "threshold double, precision double, recall double"))


def average_precision(scored: DataFrame) -> DataFrame:
    """One row: sum over thresholds of recall gained times precision; 0 without positives."""
    gain = F.try_divide("pos", "pos_all") * F.col("pos_upto") / F.col("n_upto")
    return _thresholds(scored).agg(F.coalesce(F.sum(gain), F.lit(0.0)).alias("average_precision"))


def roc_auc(scored: DataFrame, one_class: float = 0.0) -> DataFrame:
    """One row: share of (positive, negative) pairs in the right order, ties half; ``one_class`` if a class is missing."""
    neg = F.col("n") - F.col("pos")
    below = (F.col("n_all") - F.col("pos_all")) - (F.col("n_upto") - F.col("pos_upto"))
    wins = F.sum(F.col("pos") * (below + neg / 2))
    pairs = F.max("pos_all") * (F.max("n_all") - F.max("pos_all"))
    return _thresholds(scored).agg(F.coalesce(F.try_divide(wins, pairs), F.lit(float(one_class))).alias("roc_auc"))


def top_k(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), "id").limit(k)


def at_k(scored: DataFrame, k: int) -> DataFrame:
    """One row: precision_at_k (over k, even of fewer rows) and recall_at_k (0 without positives)."""
    hits = top_k(scored, k).agg(F.coalesce(F.sum("label"), F.lit(0)).alias("hits"))
    totals = scored.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("pos"))
    return hits.join(F.broadcast(totals)).select((F.col("hits") / F.lit(k)).alias("precision_at_k"), F.coalesce(F.try_divide("hits", "pos"), F.lit(0.0)).alias("recall_at_k"))


def lift(baseline: DataFrame, model: DataFrame, k: int) -> DataFrame:
    """One row: relative gain in precision at k; infinite if only the model has hits, 0 if neither."""
    b, m = at_k(baseline, k).select(F.col("precision_at_k").alias("b")), at_k(model, k).select(F.col("precision_at_k").alias("m"))
    gain = F.when(F.col("b") > 0, F.try_divide(F.col("m") - F.col("b"), F.col("b"))).when(F.col("m") > 0, F.lit(float("inf"))).otherwise(0.0)
    return b.join(F.broadcast(m)).select(gain.alias("lift_at_k"))


def optimal_threshold(scored: DataFrame) -> DataFrame:
    """One row: the lowest threshold of greatest F1, and that F1."""
    p, r = F.col("precision"), F.col("recall")
    points = pr_curve(scored).where("threshold is not null").withColumn("f1", 2 * p * r / (p + r + 1e-10))
    best = F.max_by(F.struct("threshold", "f1"), F.struct(F.round("f1", 12), -F.col("threshold")))
    return points.agg(best.alias("b")).select(F.col("b.threshold").alias("optimal_threshold"), F.col("b.f1").alias("optimal_f1"))


def risk_report(scored: DataFrame, k: int = 20) -> DataFrame:
    """The top k: provider_id, risk_score, is_fraud, rank, cumulative_fraud, cumulative_precision. Its window has k rows."""
    order = Window.orderBy(F.desc("score"), "id")
    rows = top_k(scored, k).withColumns({"rank": F.row_number().over(order), "cumulative_fraud": F.sum("label").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return rows.select(F.col("id").alias("provider_id"), F.col("score").alias("risk_score"), F.col("label").alias("is_fraud"), F.col("rank").cast("long").alias("rank"), F.col("cumulative_fraud").cast("long").alias("cumulative_fraud"), (F.col("cumulative_fraud") / F.col("rank")).alias("cumulative_precision"))


def evaluate(scored: DataFrame, k: int) -> DataFrame:
    """One row of all scalar metrics."""
    out = average_precision(scored).withColumnRenamed("average_precision", "auc_pr")
    for part in (roc_auc(scored).withColumnRenamed("roc_auc", "auc_roc"), at_k(scored, k), optimal_threshold(scored)):
        out = out.join(F.broadcast(part))
    return out


def compare_models(models: dict[str, DataFrame], k: int) -> DataFrame:
    """A row for each model: its metrics, and whether it is the best by auc_pr (ties: the first name)."""
    rows = None
    for name, scored in models.items():
        one = evaluate(scored, k).withColumn("model", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    first = F.row_number().over(Window.orderBy(F.desc("auc_pr"), "model")) == 1
    return rows.withColumn("is_best", first).select("model", *[c for c in rows.columns if c != "model"], "is_best")


def relative_improvement(value: float, base: float) -> float:
    """Per cent by which ``value`` is above ``base``; 0 where that is not positive."""
    return (value / base - 1) * 100 if base > 0 else 0.0


def average_ranks(scores: DataFrame, columns: list[str], id_col: str = "node_id") -> DataFrame:
    """Adds ``{column}_rank``: descending rank, ties averaged; from counts by distinct value, joined back."""
    for c in columns:
        by = scores.groupBy(c).agg(F.count(F.lit(1)).alias("n_"))
        upto = with_running_totals(by, [F.desc(c)], {"upto_": "n_"})
        ranks = upto.select(F.col(c).alias("value_"), (F.col("upto_") - (F.col("n_") - 1) / 2).alias(f"{c}_rank"))
        scores = scores.join(ranks, scores[c].eqNullSafe(ranks["value_"])).drop("value_")
    return scores


def consensus(scores: DataFrame, columns: list[str], n: int = 20, id_col: str = "node_id") -> DataFrame:
    """The ``n`` ids of the best mean rank over ``columns``."""
    ranked = average_ranks(scores.select(id_col, *columns), columns, id_col)
    mean = sum(F.col(f"{c}_rank") for c in columns) / len(columns)
    return ranked.withColumn("avg_rank", mean).orderBy("avg_rank", id_col).limit(n)
