from riskloom.config import GraphSettings, Settings
from riskloom.operators import graph_algorithms as ga
from riskloom.plans import pipeline
from riskloom.sources import synthetic


def test_pipeline(spark, tmp_path):
    made = {k: ga.written(v, k) for k, v in synthetic.generate(spark, 60, 600, 8).items()}
    settings = Settings(GraphSettings(co_billing_window_days=1, similarity_threshold=0.99), investigator_capacity=10)
    result = pipeline.run(made["providers"], made["claims"], made["exclusions"], made["ownership"], made["bank_accounts"], settings, 5, ("SHARES_BANK_ACCOUNT",))
    assert result.scores.count() == 60 and result.metrics.first().auc_pr > 0.5
    pipeline.save(result, str(tmp_path))
    assert spark.read.option("header", True).csv(f"{tmp_path}/risk_scores").count() == 60
