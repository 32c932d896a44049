"""Seeded synthetic domain tables with one fraud ring, for demonstrations and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Domains of the columns.
SPECIALTIES = ("Family Medicine", "Internal Medicine", "Nurse Practitioner", "Radiology")
TAXONOMIES = ("207Q00000X", "208D00000X", "363LF0000X", "207R00000X")
STATES = ("NY", "CA", "TX", "FL", "PA", "IL")
PROCEDURES = ("99213", "99214", "99215", "99203", "99204", "97110", "90837")
DIAGNOSES = ("I10", "E11", "J45", "M54", "F41")
SOURCES = ("OIG", "SAM.gov", "State Medicaid")
ROLES = ("Owner", "Managing Member", "Director")


def _unit(seed: int, name: str, key="id"):
    """Uniform on [0, 1) from a hash, whatever the partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col(key)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _pick(values: tuple[str, ...], u):
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(u * len(values)) + 1).cast("int"))


def generate(spark: SparkSession, providers: int = 200, claims: int = 5000, ring: int = 15, seed: int = 42) -> dict[str, DataFrame]:
    """providers, claims, exclusions, ownership, bank_accounts. The first ``ring`` providers bill more, share patients, an
    owner and an account, and are excluded."""
    u = lambda name: _unit(seed, name)
    npi = F.lpad((F.col("id") * 7919 + 1_000_000_007).cast("string"), 10, "0")
    people = spark.range(providers).select(
        "id",
        npi.alias("npi"),
        F.concat(F.lit("Provider_"), F.col("id")).alias("provider_name"),
        F.when(u("type") < 0.85, "Individual").otherwise("Organization").alias("provider_type"),
        _pick(TAXONOMIES, u("spec")).alias("taxonomy_code"),
        _pick(SPECIALTIES, u("spec")).alias("specialty"),
        _pick(STATES, u("state")).alias("license_state"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.floor(u("day") * 730).cast("int")).alias("enrollment_date"),
    )
    in_ring = u("ring") < 0.3
    who = F.when(in_ring, F.floor(u("who") * ring)).otherwise(F.floor(ring + u("who") * max(1, providers - ring))).cast("long")
    billed = F.when(in_ring, 500 + 1500 * u("billed")).otherwise(-300 * F.log(1 - u("billed")))
    made = spark.range(claims).withColumn("who", who)
    made = made.select(
        F.concat(F.lit("CLAIM_"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("claim_id"),
        F.lpad((F.col("who") * 7919 + 1_000_000_007).cast("string"), 10, "0").alias("provider_npi"),
        F.when(in_ring, F.concat(F.lit("RINGMEMBER_"), F.lpad(F.floor(u("pat") * 20).cast("string"), 3, "0"))).otherwise(F.concat(F.lit("PERSON_"), F.lpad(F.floor(u("pat") * 500).cast("string"), 4, "0"))).alias("beneficiary_id"),
        F.date_add(F.lit("2023-01-01").cast("date"), F.floor(u("date") * 365).cast("int")).cast("timestamp_ntz").alias("date_of_service"),
        F.round(billed, 2).alias("billed_amount"),
        F.round(billed * (0.6 + 0.35 * u("paid")), 2).alias("paid_amount"),
        _pick(PROCEDURES, u("proc")).alias("procedure_code"),
        _pick(DIAGNOSES, u("diag")).alias("diagnosis_code"),
        F.concat(F.lit("FAC00"), (F.floor(u("fac") * 5) + 1).cast("string")).alias("facility_id"),
    )
    first = people.where(F.col("id") < ring)
    exclusions = first.select(F.col("npi").alias("entity_npi"), F.date_add(F.lit("2024-01-16").cast("date"), F.floor(u("excl") * 98).cast("int")).cast("timestamp_ntz").alias("exclusion_date"), _pick(SOURCES, u("src")).alias("exclusion_source"))
    few = people.where(F.col("id") < ring + 5)
    ownership = few.select(F.col("npi").alias("provider_npi"), F.when(F.col("id") < ring, "RING_OWNER").otherwise(F.concat(F.lit("OWNER_"), F.col("id"))).alias("owner_id"), F.round(25 + 75 * u("pct"), 1).alias("ownership_percentage"), _pick(ROLES, u("role")).alias("owner_role"))
    banks = people.where(F.col("id") < ring + 35).select(F.col("npi").alias("provider_npi"), F.when(F.col("id") < ring, "RING_ACCOUNT").otherwise(F.concat(F.lit("BANK_"), F.col("id"))).alias("account_hash"))
    return {"providers": people.drop("id"), "claims": made, "exclusions": exclusions, "ownership": ownership, "bank_accounts": banks}
