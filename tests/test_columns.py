import datetime as dt
import hashlib
import hmac

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions import columns, privacy
from riskloom.operators import claim_features, validation
from riskloom.sources import synthetic, tables

SALT = "s" * 70


def values(spark, data, kind, f):
    return [r.y for r in spark.createDataFrame([(k, v) for k, v in enumerate(data)], f"k int, x {kind}").orderBy("k").select(f(F.col("x")).alias("y")).collect()]


def test_money_and_codes(spark):
    assert values(spark, ["$1,234.50", "-5", "x", None, "NaN"], "string", columns.money) == [1234.5, 0, 0, 0, 0]
    assert values(spark, [" 99.213 ", "i10", None], "string", columns.code) == ["99213", "I10", None]
    assert values(spark, ["2023-01-07", "x", None], "string", columns.lenient_date) == [dt.datetime(2023, 1, 7), None, None]
    assert values(spark, [float("inf"), float("nan"), None, 2.0], "double", columns.finite) == [0, 0, 0, 2]
    assert values(spark, ["99215", "nope", None], "string", columns.minutes) == [40, 15, 15]


def test_hmac(spark):
    data = ["abc", "é1", "", "   ", None]
    expected = [hmac.new(SALT.encode(), x.encode(), hashlib.sha256).hexdigest() if x is not None else None for x in data]
    assert values(spark, data, "string", lambda c: privacy.hmac_sha256(c, SALT)) == [*expected[:2], None, None, None]
    assert values(spark, data, "string", lambda c: privacy.hmac_sha256(c, SALT, strict_blank=False)) == [*expected[:2], None, expected[3], None]


def test_tokens(spark, tmp_path):
    df = privacy.token_table(spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "x string"), "x", str(tmp_path / "t"), 8)
    rows = df.collect()
    assert len(rows) == 3 and len({r.token for r in rows}) == 3 and all(len(r.token) == 16 for r in rows)


def test_percentiles(spark):
    rng = np.random.default_rng(1)
    data = [(int(k), float(x)) for k in range(3) for x in rng.integers(0, 20, 5 + 20 * k)] + [(9, None)]
    got = {r.k: (r.a, r.b) for r in columns.percentiles(spark.createDataFrame(data, "k int, x double"), "k", "x", a=0.5, b=0.95).collect()}
    for k in range(3):
        own = [x for key, x in data if key == k]
        assert got[k] == pytest.approx((np.quantile(own, 0.5), np.quantile(own, 0.95)))
    assert 9 not in got


def test_single_claim(spark):
    rows = [("p", "b", dt.datetime(2023, 1, 7), 10.0, 5.0, "99215")]
    claims = spark.createDataFrame(rows, "provider_npi string, beneficiary_id string, date_of_service timestamp_ntz, billed_amount double, paid_amount double, procedure_code string")
    providers = spark.createDataFrame([("p",), ("idle",)], "npi string")
    got = {r.provider_npi: r for r in claim_features.all_claim_features(claims, providers).collect()}
    assert (got["p"].active_days, got["p"].velocity_change, got["p"].std_billed, got["p"].high_value_ratio, got["p"].weekend_ratio) == (1, 0, 0, 0, 1)
    assert got["idle"].total_claims == 0 and got["idle"].avg_billed == 0
    assert claim_features.all_claim_features(claims.limit(0), providers).count() == 2


def test_validation(spark):
    df = spark.createDataFrame([("1234567890",), ("123",), ("123456789012",), ("abcdefghij",), (None,), (None,)], "npi string")
    ok, errors = validation.validate("providers", df)
    assert not ok and errors == ["Found 2 missing NPI values", "Found 1 duplicate NPIs", "Found 5 invalid NPI formats"]
    assert validation.validate("claims", df) == (False, [f"Missing required column: {c}" for c in ("claim_id", "provider_npi", "date_of_service")])
    claims = spark.createDataFrame([("1", "p", "2023-01-01", -1.0), ("2", "p", "bad", 1.0), ("3", "p", "2030-01-01", 2e6)], "claim_id string, provider_npi string, date_of_service string, billed_amount double")
    assert validation.validate("claims", claims, "2024-01-01")[1] == ["Found 1 unreadable dates of service", "Found 1 claims with future dates", "Found 1 claims with negative billed amounts"]


def test_round_trip(spark, tmp_path):
    made = synthetic.generate(spark, 40, 300)
    tables.write_tables(made, str(tmp_path))
    claims = tables.load_claims(spark, f"{tmp_path}/claims", SALT)
    assert claims.count() == 300 and claims.where("beneficiary_hash is null").isEmpty()
    assert dict(claims.dtypes)["date_of_service"] == "timestamp_ntz" and claims.where("modifier is not null").isEmpty()
    assert tables.load_providers(spark, f"{tmp_path}/providers", SALT).where("length(npi) <> 10").isEmpty()
    with pytest.raises(ValueError, match="entity_npi"):
        tables.load_exclusions(spark, f"{tmp_path}/claims")
