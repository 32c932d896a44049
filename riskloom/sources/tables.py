"""Input tables with declared schemas, required-column checks, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.columns import as_npi
from riskloom.functions.privacy import hmac_sha256

#: By table: required columns, then optional ones, with their types.
SCHEMAS = {
    "providers": ({"npi": "string", "provider_type": "string", "taxonomy_code": "string", "specialty": "string"}, {"provider_name": "string", "license_state": "string", "enrollment_date": "date"}),
    "claims": (
        {"claim_id": "string", "provider_npi": "string", "beneficiary_id": "string", "date_of_service": "timestamp_ntz", "billed_amount": "double", "paid_amount": "double"},
        {"allowed_amount": "double", "procedure_code": "string", "diagnosis_code": "string", "modifier": "string", "facility_id": "string", "service_location": "string", "referring_provider_npi": "string", "referring_npi": "string", "claim_received_date": "timestamp_ntz", "adjudication_date": "timestamp_ntz"},
    ),
    "exclusions": ({"entity_npi": "string", "exclusion_date": "timestamp_ntz", "exclusion_source": "string"}, {"reinstatement_date": "timestamp_ntz"}),
    "ownership": ({"provider_npi": "string", "owner_id": "string", "ownership_percentage": "double", "owner_role": "string"}, {}),
    "bank_accounts": ({"provider_npi": "string", "account_hash": "string"}, {}),
}
ORGANIZATIONS = ("Organization", "Facility")


def require(df: DataFrame, columns: list[str], table: str) -> DataFrame:
    """``df``, or ValueError naming what is missing, before any job runs."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{table}: missing required columns {missing}")
    return df


def read_table(spark: SparkSession, path: str, table: str, form: str = "csv") -> DataFrame:
    """A table with its declared columns and types. CSV is read as text; amounts that are no number become 0, dates must
    be readable (an unreadable one fails the job). Optional columns that a file lacks are typed nulls."""
    required, optional = SCHEMAS[table]
    reader = spark.read.option("header", True) if form == "csv" else spark.read
    df = require(reader.format(form).load(path), list(required), table)
    out = []
    for name, kind in {**required, **optional}.items():
        if name not in df.columns:
            out.append(F.lit(None).cast(kind).alias(name))
        elif kind == "double":
            out.append(F.coalesce(F.col(name).cast("string").try_cast("double"), F.lit(0.0)).alias(name))
        elif name.endswith("npi"):
            out.append(as_npi(F.col(name)).alias(name))
        else:
            out.append(F.col(name).cast(kind).alias(name))
    return df.select(*out, *[c for c in df.columns if c not in required and c not in optional])


def node_type(kind) -> F.Column:
    return F.when(kind.isin(*ORGANIZATIONS), "Provider_Org").otherwise("Provider_Ind")


def load_providers(spark: SparkSession, path: str, salt: str, form: str = "csv") -> DataFrame:
    df = read_table(spark, path, "providers", form)
    return df.withColumns({"provider_name_hash": hmac_sha256(F.col("provider_name"), salt, strict_blank=False), "node_type": node_type(F.col("provider_type"))})


def load_claims(spark: SparkSession, path: str, salt: str, form: str = "csv") -> DataFrame:
    return read_table(spark, path, "claims", form).withColumn("beneficiary_hash", hmac_sha256(F.col("beneficiary_id"), salt, strict_blank=False))


def load_exclusions(spark: SparkSession, path: str, form: str = "csv") -> DataFrame:
    return read_table(spark, path, "exclusions", form)


def load_ownership(spark: SparkSession, path: str, salt: str, form: str = "csv") -> DataFrame:
    return read_table(spark, path, "ownership", form).withColumn("owner_hash", hmac_sha256(F.col("owner_id"), salt, strict_blank=False))


def load_bank_accounts(spark: SparkSession, path: str, form: str = "csv") -> DataFrame:
    return read_table(spark, path, "bank_accounts", form)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        write_csv(df, f"{folder}/{name}")


def write_scores(scores: DataFrame, path: str) -> None:
    """provider_id, risk_score, baseline_score, label."""
    write_csv(scores.select("provider_id", "risk_score", "baseline_score", "label"), path)


def long_metrics(metrics: DataFrame, key: str = "model") -> DataFrame:
    """A row for each model and metric, from a row for each model."""
    names = [c for c in metrics.columns if c != key]
    return metrics.unpivot(key, [F.col(c).cast("double").alias(c) for c in names], "metric", "value")
