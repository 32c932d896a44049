"""Validation of the input tables: one pass of conditional counts for each table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.columns import lenient_date

REQUIRED = {"providers": ["npi"], "claims": ["claim_id", "provider_npi", "date_of_service"], "exclusions": ["entity_npi", "exclusion_date"]}
HIGH_AMOUNT = 1_000_000


def is_npi(c) -> F.Column:
    return F.coalesce(c.cast("string").rlike("^[0-9]{10}$"), F.lit(False))


def provider_checks(providers: DataFrame) -> DataFrame:
    """One row: n_rows, missing_npi, duplicate_npi (null counts as one value), invalid_npi."""
    by_npi = providers.groupBy("npi").agg(F.count(F.lit(1)).alias("n"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return by_npi.agg(
        total("n").alias("n_rows"),
        total(F.when(F.col("npi").isNull(), F.col("n")).otherwise(0)).alias("missing_npi"),
        total(F.col("n") - 1).alias("duplicate_npi"),
        total(F.when(~is_npi(F.col("npi")), F.col("n")).otherwise(0)).alias("invalid_npi"),
    )


def claim_checks(claims: DataFrame, as_of: str | None = None) -> DataFrame:
    """One row: n_rows, bad_dates, future_dates (after ``as_of``, or now), negative_amounts, high_amounts; the counts of a column
    that the table doesn't have are left out."""
    checks = [F.count(F.lit(1)).alias("n_rows")]
    if "date_of_service" in claims.columns:
        at = lenient_date(F.col("date_of_service"))
        limit = F.lit(as_of).cast("timestamp_ntz") if as_of else F.current_timestamp().cast("timestamp_ntz")
        checks += [F.count_if(at.isNull() & F.col("date_of_service").isNotNull()).alias("bad_dates"), F.count_if(at > limit).alias("future_dates")]
    if "billed_amount" in claims.columns:
        checks += [F.count_if(F.col("billed_amount") < 0).alias("negative_amounts"), F.count_if(F.col("billed_amount") > HIGH_AMOUNT).alias("high_amounts")]
    return claims.agg(*checks)


def validate(kind: str, df: DataFrame, as_of: str | None = None) -> tuple[bool, list[str]]:
    """(valid, errors) of a table; missing columns are found before any job runs, and each check needs only its own. Dates after
    ``as_of`` (now, by default) are future ones. High amounts are no error."""
    errors = [f"Missing required column: {c}" for c in REQUIRED[kind] if c not in df.columns]
    said, row = {}, {}
    if kind == "providers" and "npi" in df.columns:
        said = {"missing_npi": "missing NPI values", "duplicate_npi": "duplicate NPIs", "invalid_npi": "invalid NPI formats"}
        row = provider_checks(df).first().asDict()
    elif kind == "claims":
        said = {"bad_dates": "unreadable dates of service", "future_dates": "claims with future dates", "negative_amounts": "claims with negative billed amounts"}
        row = claim_checks(df, as_of).first().asDict()
    errors += [f"Found {row[k]} {v}" for k, v in said.items() if row.get(k)]
    return not errors, errors


def temporal_consistency(claims: DataFrame, exclusions: DataFrame) -> DataFrame:
    """One row: both date ranges, and whether the last claim is after the first exclusion."""
    left = claims.agg(F.min("date_of_service").alias("claims_min"), F.max("date_of_service").alias("claims_max"))
    right = exclusions.agg(F.min("exclusion_date").alias("exclusions_min"), F.max("exclusion_date").alias("exclusions_max"))
    return left.join(F.broadcast(right)).withColumn("potential_leakage", F.coalesce(F.col("claims_max") > F.col("exclusions_min"), F.lit(False)))


def statistics(providers: DataFrame, claims: DataFrame, exclusions: DataFrame) -> DataFrame:
    """(statistic, value): table sizes, providers that claim, providers without claims."""
    billing = claims.where(F.col("provider_npi").isNotNull()).select("provider_npi").distinct()
    silent = providers.select("npi").distinct().join(billing, F.col("npi") == F.col("provider_npi"), "left_anti")
    parts = {"total_providers": providers, "total_claims": claims, "total_exclusions": exclusions, "unique_providers_in_claims": billing, "providers_without_claims": silent}
    rows = [df.agg(F.lit(name).alias("statistic"), F.count(F.lit(1)).alias("value")) for name, df in parts.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def report(spark: SparkSession, providers: DataFrame, claims: DataFrame, exclusions: DataFrame, as_of: str | None = None) -> DataFrame:
    """(table, is_valid, num_records, errors) for each table, and the statistics as rows of table ``statistics``."""
    rows = []
    for kind, df in (("providers", providers), ("claims", claims), ("exclusions", exclusions)):
        ok, errors = validate(kind, df, as_of)
        rows.append((kind, ok, df.count(), errors))
    rows += [(f"statistics.{r.statistic}", True, r.value, []) for r in statistics(providers, claims, exclusions).collect()]
    return spark.createDataFrame(rows, "table string, is_valid boolean, num_records long, errors array<string>")
