"""Behavioural features of each provider from its claims: one row a provider, plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.columns import code, em_level, exact_sum, finite_columns, is_weekend, lenient_date, minutes, money
from riskloom.operators.graph_algorithms import written

KEY = "provider_npi"
MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', date_of_service)"
DAY = 86_400_000_000


def clean_claims(claims: DataFrame) -> DataFrame:
    """Lenient dates, amounts as numbers of 0 or more, normalised codes and ids; only of the columns that are there."""
    kinds = {"date_of_service": lenient_date, "claim_received_date": lenient_date, "adjudication_date": lenient_date}
    kinds |= dict.fromkeys(("billed_amount", "paid_amount", "allowed_amount"), money)
    kinds |= dict.fromkeys(("procedure_code", "diagnosis_code", "modifier"), code)
    kinds |= {KEY: lambda c: F.trim(c.cast("string"))}
    return claims.withColumns({c: kind(F.col(c)) for c, kind in kinds.items() if c in claims.columns})


def _days(low: str, high: str):
    return F.floor((F.col(high) - F.col(low)) / DAY)


#: Kinds of the roll-up: what each counts a provider's claims by.
TIMES, AMOUNTS, PATIENTS, CODES = range(4)


def rolled_up(claims: DataFrame, *kinds: int, patient: str = "beneficiary_id") -> DataFrame:
    """Claims counted by provider and one value for each kind: (provider_npi, kind, v, s, n, m), v a time in microseconds or an amount,
    s a patient or code, m the minutes of a time or what was paid at an amount. Claims are read once; equal values are added up before
    the shuffle, so that a provider with a large part of all claims is many rows of many keys. Null times, patients and codes are left out."""
    have = lambda c, t: F.col(c) if c in claims.columns else F.lit(None).cast(t)
    number, none, m = F.lit(None).cast("double"), F.lit(None).cast("string"), "decimal(28,6)"
    sources = {
        TIMES: lambda: (F.expr(MICROS).cast("double"), none, minutes(have("procedure_code", "string")).cast(m)),
        AMOUNTS: lambda: (have("billed_amount", "double").cast("double"), none, have("paid_amount", "double").cast(m)),
        PATIENTS: lambda: (number, have(patient, "string").cast("string"), F.lit(None).cast(m)),
        CODES: lambda: (number, have("procedure_code", "string").cast("string"), F.lit(None).cast(m)),
    }
    each = F.array(*[F.struct(F.lit(k).cast("tinyint").alias("kind"), *[x.alias(c) for c, x in zip("vsm", sources[k](), strict=True)]) for k in kinds])
    rows = claims.select(KEY, F.inline(each)).where((F.col("kind") == AMOUNTS) | F.col("v").isNotNull() | F.col("s").isNotNull())
    return rows.groupBy(KEY, "kind", "v", "s").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("m"))


def _ordered(rolled: DataFrame) -> DataFrame:
    """One row a provider from its times and amounts. Both kinds go through one shuffle to windows in order of value, which give the
    median time, the 95th percentile of the amounts and their mean, and the minutes of a day; the aggregation needs no further one."""
    rows = rolled.where(F.col("kind").isin(TIMES, AMOUNTS))
    by = Window.partitionBy(KEY, "kind")
    time, amount = F.col("kind") == TIMES, F.col("kind") == AMOUNTS
    known = F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)
    rows = rows.withColumns({"upto": F.sum(known).over(by.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)), "all_": F.sum(known).over(by), "mean": F.sum(F.col("v") * F.col("n")).over(by) / F.sum(known).over(by)})
    place = (F.col("all_") - 1) * F.when(time, 0.5).otherwise(0.95)
    low = F.min(F.when(F.col("upto") > F.floor(place), F.col("v"))).over(by)
    high = F.min(F.when(F.col("upto") > F.ceil(place), F.col("v"))).over(by)
    at = F.when(time, F.expr("timestampadd(MICROSECOND, cast(v as bigint), timestamp_ntz'1970-01-01 00:00:00')"))
    rows = rows.withColumns({"cut": low + (high - low) * (place - F.floor(place)), "at": at, "day_": F.when(time, F.floor(F.col("v") / DAY))})
    days = Window.partitionBy(KEY, "kind", "day_")
    rows = rows.withColumns({"day_minutes": F.when(time, F.sum("m").over(days)), "first_": F.row_number().over(days.orderBy("v")) == 1})
    day = F.when(time & F.col("first_"), F.col("day_minutes"))
    recent = F.col("v") >= F.col("cut")
    n, when = F.when(time, F.col("n")), F.when(time, F.col("v"))
    halves = [f(F.when(half, c)).alias(f"{name}_{k}") for name, half in (("recent", recent), ("older", ~recent)) for k, f, c in (("n", F.sum, n), ("low", F.min, when), ("high", F.max, when))]
    months = [F.sum(F.when(F.month("at") == k, n)) for k in range(1, 13)]
    sold = F.when(amount & F.col("v").isNotNull(), F.col("n"))
    rows = rows.groupBy(KEY, "kind").agg(
        F.sum(n).alias("n_times"),
        F.sum(F.when(is_weekend(F.col("at")), n).otherwise(F.when(time, 0))).alias("weekend"),
        F.min(when).alias("low"),
        F.max(when).alias("high"),
        F.array_compact(F.array(*months)).alias("months"),
        *halves,
        F.when(F.max(time), F.count_if(day > 1440)).alias("over"),
        F.when(F.max(time), F.count(day)).alias("n_days"),
        F.sum(day).cast("double").alias("all_minutes"),
        F.max(day).cast("double").alias("top_minutes"),
        F.sum(F.when(amount, F.col("n"))).alias("total_claims"),
        F.sum(F.when(sold.isNotNull(), F.col("v").cast("decimal(28,6)") * F.col("n"))).cast("double").alias("total_billed"),
        F.sum(F.when(amount, F.col("m"))).cast("double").alias("total_paid"),
        F.sum(sold).alias("n_billed"),
        F.sum(sold * (F.col("v") - F.col("mean")) * (F.col("v") - F.col("mean"))).alias("squares"),
        F.max(F.when(amount, F.col("v"))).alias("max_billed"),
        F.sum(F.when(F.col("v") > F.col("cut"), sold)).alias("n_high"),
    )
    names = [c for c in rows.columns if c not in (KEY, "kind", "months")]
    # The times' row has nulls where the amounts' has values, and the other way round.
    months_ = F.max(F.when(time, F.col("months"))).alias("months")
    return rows.groupBy(KEY).agg(*[F.max(c).alias(c) for c in names], months_)


def _counted(rolled: DataFrame) -> DataFrame:
    """One row a provider from its patients and codes."""
    rows = rolled.where(F.col("kind").isin(PATIENTS, CODES))
    code = F.col("kind") == CODES
    level = F.when(code, em_level(F.col("s")))
    return rows.groupBy(KEY).agg(
        F.count_if(F.col("kind") == PATIENTS).alias("unique_patients"),
        F.count_if(code).alias("unique_procedures"),
        F.max(F.when(code, F.col("n"))).alias("top"),
        F.sum(F.when(level.isNotNull(), F.col("n"))).alias("n_levels"),
        F.sum(level * F.col("n")).alias("levels"),
        F.sum(F.when(level >= 4, F.col("n"))).alias("high_levels"),
        F.sum(F.when(level == 5, F.col("n"))).alias("top_levels"),
    )


def _temporal() -> list[Column]:
    rate = lambda half: F.col(f"{half}_n") / F.greatest(_days(f"{half}_low", f"{half}_high"), F.lit(1))
    active = F.greatest(_days("low", "high"), F.lit(1))
    k, total = F.size("months"), F.aggregate("months", F.lit(0).cast("long"), lambda s, x: s + x)
    mean = total / k
    spread = F.sqrt(F.aggregate("months", F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / (k - 1))
    return [
        active.cast("long").alias("active_days"),
        (F.col("n_times") / active).alias("claims_per_day"),
        (F.col("weekend") / F.col("n_times")).alias("weekend_ratio"),
        F.when(k > 1, spread / F.greatest(mean, F.lit(1.0))).when(k == 1, 0.0).alias("monthly_variation"),
        F.when(F.col("older_n") > 0, (rate("recent") - rate("older")) / F.greatest(rate("older"), F.lit(0.001))).when(F.col("n_times") > 0, 0.0).alias("velocity_change"),
    ]


def _billing() -> list[Column]:
    n, own = F.col("total_claims"), F.coalesce("unique_patients", F.lit(0))
    return [
        n,
        F.col("total_billed"),
        F.col("total_paid"),
        F.try_divide("total_billed", "n_billed").alias("avg_billed"),
        F.when(F.col("n_billed") > 1, F.sqrt(F.col("squares") / (F.col("n_billed") - 1))).otherwise(0.0).alias("std_billed"),
        F.col("max_billed"),
        (F.coalesce("n_high", F.lit(0)) / n).alias("high_value_ratio"),
        F.when(F.col("total_billed") > 0, F.col("total_paid") / F.col("total_billed")).otherwise(0.0).alias("payment_ratio"),
        own.alias("unique_patients"),
        (n / F.greatest(own, F.lit(1))).alias("claims_per_patient"),
        F.coalesce("unique_procedures", F.lit(0)).alias("unique_procedures"),
        (F.coalesce("top", F.lit(0)) / n).alias("top_procedure_concentration"),
    ]


def _upcoding() -> list[Column]:
    ratio = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("n_levels")), F.lit(0.0))
    return [ratio("levels").alias("avg_complexity"), ratio("high_levels").alias("high_complexity_ratio"), ratio("top_levels").alias("level_5_ratio")]


def _impossible() -> list[Column]:
    n = F.col("n_days")
    return [F.col("over").alias("impossible_days_count"), F.try_divide("over", n).alias("impossible_days_ratio"), (F.try_divide("all_minutes", n) / 60).alias("avg_daily_hours"), (F.col("top_minutes") / 60).alias("max_daily_hours")]


def temporal_features(claims: DataFrame) -> DataFrame:
    """active_days (1 at least), claims_per_day, weekend_ratio, monthly_variation, velocity_change. The median splits a provider's
    claims into older (before it) and recent."""
    df = _ordered(rolled_up(claims, TIMES))
    return df.select(KEY, *_temporal())


def billing_features(claims: DataFrame, patient: str = "beneficiary_id") -> DataFrame:
    """Counts, sums, mean, deviation, greatest amount, high_value_ratio (above the provider's own 95th percentile),
    payment_ratio, patients and procedures."""
    rolled = rolled_up(claims, AMOUNTS, PATIENTS, CODES, patient=patient)
    df = _ordered(rolled).join(_counted(rolled), KEY, "left")
    return df.select(KEY, *_billing())


def upcoding_features(claims: DataFrame) -> DataFrame:
    """Mean level, share of level 4 and 5, share of level 5 among evaluation-and-management codes; 0 without any."""
    every = claims.select(KEY).distinct()
    df = every.join(_counted(rolled_up(claims, CODES)), KEY, "left")
    return df.select(KEY, *_upcoding())


def impossible_days(claims: DataFrame) -> DataFrame:
    """Days of more than 1440 billed minutes, their share of the provider's days, mean and greatest daily hours."""
    df = _ordered(rolled_up(claims, TIMES))
    return df.select(KEY, *_impossible())


def all_claim_features(claims: DataFrame, providers: DataFrame, patient: str = "beneficiary_id") -> DataFrame:
    """All of the above for every provider, 0 where it has no claims or a value isn't finite. Claims are read once: their roll-up is
    written, and both halves of the features read that."""
    rolled = written(rolled_up(claims, TIMES, AMOUNTS, PATIENTS, CODES, patient=patient), "rolled")
    df = _ordered(rolled).join(_counted(rolled), KEY, "full")
    parts = df.select(KEY, *_temporal(), *_billing(), *_upcoding(), *_impossible())
    return finite_columns(providers.select(F.col("npi").alias(KEY)).join(parts, KEY, "left"), KEY)


def pipeline_claim_features(claims: DataFrame, providers: DataFrame, patient: str = "beneficiary_id") -> DataFrame:
    """The smaller set of the scoring pipeline; active_days is not raised to 1 here."""
    sums = claims.withColumn("at", F.expr(MICROS)).groupBy(KEY).agg(F.count(F.lit(1)).alias("claim_count"), exact_sum(F.col("billed_amount")).alias("total_billed"), F.min("at").alias("low"), F.max("at").alias("high"))
    patients = claims.where(F.col(patient).isNotNull()).groupBy(KEY, patient).agg(F.lit(1)).groupBy(KEY).agg(F.count(F.lit(1)).alias("unique_patients"))
    df = providers.select(F.col("npi").alias(KEY)).join(sums, KEY, "left").join(patients, KEY, "left")
    df = df.withColumn("active_days", _days("low", "high").cast("long"))
    df = df.select(KEY, "claim_count", "total_billed", F.try_divide("total_billed", "claim_count").alias("avg_billed"), "unique_patients", "active_days", (F.col("claim_count") / F.greatest("active_days", F.lit(1))).alias("claims_per_day"))
    return finite_columns(df, KEY)
