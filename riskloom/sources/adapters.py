"""The domain tables as a fixed mapping of the test tables (region nation customer supplier part orders lineitem)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CODES = ("99213", "99214", "99215", "99203", "99204", "97110", "90837")


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _npi(c) -> F.Column:
    return F.lpad(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), 10, "0")


def providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return (
        _t(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .select(
            _npi("s_suppkey").alias("npi"),
            F.col("s_name").alias("provider_name"),
            F.when(F.col("s_suppkey") % 5 == 0, "Organization").otherwise("Individual").alias("provider_type"),
            F.col("n_name").alias("specialty"),
            F.concat(F.lit("T"), F.lpad(F.col("s_nationkey").cast("string"), 3, "0")).alias("taxonomy_code"),
            F.col("r_name").alias("license_state"),
            F.lit(None).cast("date").alias("enrollment_date"),
        )
    )


def claims(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """claim_id, provider_npi, date_of_service, billed_amount, paid_amount, and of ``extra`` what is asked for: beneficiary_id,
    facility_id (joins orders, customer), procedure_code, brand_code (join part), referring_provider_npi (joins a count)."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long").cast("string")
    key = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    key += [F.date_format("l_shipdate", "yyyyMMdd"), cents("l_quantity"), cents("l_extendedprice")]
    df = _t(spark, sf_dir, "lineitem")
    columns = [
        F.concat_ws("-", *key).alias("claim_id"),
        _npi("l_suppkey").alias("provider_npi"),
        F.col("l_shipdate").alias("date_of_service"),
        F.col("l_extendedprice").alias("billed_amount"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("paid_amount"),
    ]
    if {"beneficiary_id", "facility_id"} & set(extra):
        df = df.join(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
        columns.append(F.col("o_custkey").cast("string").alias("beneficiary_id"))
    if "facility_id" in extra:
        df = df.join(_t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
        columns.append(F.concat(F.lit("FAC"), F.lpad(F.col("c_nationkey").cast("string"), 3, "0")).alias("facility_id"))
    if {"procedure_code", "brand_code"} & set(extra):
        df = df.join(_t(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand"), F.col("l_partkey") == F.col("p_partkey"), "left")
        columns += [F.element_at(F.array(*map(F.lit, CODES)), F.col("p_size") % 7 + 1).alias("procedure_code"), F.col("p_brand").alias("brand_code")]
    if "referring_provider_npi" in extra:
        df = df.join(F.broadcast(_t(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n_suppliers"))))
        columns.append(F.when(F.col("l_returnflag") == "R", _npi(F.col("l_partkey") % F.col("n_suppliers"))).alias("referring_provider_npi"))
    return df.select(*columns)


def exclusions(spark: SparkSession, sf_dir: str, first_day: str = "2002-01-01") -> DataFrame:
    day = F.date_add(F.lit(first_day).cast("date"), (F.col("s_suppkey") % 100).cast("int")).cast("timestamp_ntz")
    rows = _t(spark, sf_dir, "supplier").where(F.col("s_suppkey") % 10 == 3)
    return rows.select(_npi("s_suppkey").alias("entity_npi"), day.alias("exclusion_date"), F.lit("LIST").alias("exclusion_source"), F.lit(None).cast("timestamp_ntz").alias("reinstatement_date"))


def ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "supplier").where(F.col("s_suppkey") % 2 == 0)
    return rows.select(_npi("s_suppkey").alias("provider_npi"), F.concat(F.lit("OWNER_"), (F.col("s_suppkey") % 30).cast("string")).alias("owner_id"), (25 + F.col("s_suppkey") % 75).cast("double").alias("ownership_percentage"), F.lit("Owner").alias("owner_role"))


def bank_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "supplier").where(F.col("s_suppkey") % 2 == 1)
    return rows.select(_npi("s_suppkey").alias("provider_npi"), F.concat(F.lit("BANK_"), F.floor(F.col("s_suppkey") / 6).cast("string")).alias("account_hash"))


#: The same tables for DuckDB, as common table expressions.
SQL = """
providers as (select lpad(cast(s_suppkey as varchar), 10, '0') as npi, s_name as provider_name, case when s_suppkey % 5 = 0 then 'Organization' else 'Individual' end as provider_type,
  n_name as specialty, 'T' || lpad(cast(s_nationkey as varchar), 3, '0') as taxonomy_code, r_name as license_state from supplier left join (select * from nation join region on n_regionkey = r_regionkey) on s_nationkey = n_nationkey),
claims as (select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'), cast(round(l_quantity * 100) as bigint), cast(round(l_extendedprice * 100) as bigint)) as claim_id,
  lpad(cast(l_suppkey as varchar), 10, '0') as provider_npi, cast(o_custkey as varchar) as beneficiary_id, l_shipdate as date_of_service, l_extendedprice as billed_amount, l_extendedprice * (1 - l_discount) as paid_amount,
  ['99213', '99214', '99215', '99203', '99204', '97110', '90837'][p_size % 7 + 1] as procedure_code, p_brand as brand_code, 'FAC' || lpad(cast(c_nationkey as varchar), 3, '0') as facility_id,
  case when l_returnflag = 'R' then lpad(cast(l_partkey % (select count(*) from supplier) as varchar), 10, '0') end as referring_provider_npi
  from lineitem left join orders on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey left join part on l_partkey = p_partkey),
exclusions as (select lpad(cast(s_suppkey as varchar), 10, '0') as entity_npi, timestamp '2002-01-01' + to_days(cast(s_suppkey % 100 as integer)) as exclusion_date, 'LIST' as exclusion_source from supplier where s_suppkey % 10 = 3),
ownership as (select lpad(cast(s_suppkey as varchar), 10, '0') as provider_npi, 'OWNER_' || (s_suppkey % 30) as owner_id, cast(25 + s_suppkey % 75 as double) as ownership_percentage, 'Owner' as owner_role from supplier where s_suppkey % 2 = 0),
bank_accounts as (select lpad(cast(s_suppkey as varchar), 10, '0') as provider_npi, 'BANK_' || cast(floor(s_suppkey / 6) as bigint) as account_hash from supplier where s_suppkey % 2 = 1)
"""
