"""Cleaning and scalar column expressions. All are built-in expressions; null stays null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Evaluation-and-management levels and minutes by procedure code.
EM_LEVELS = {
    "99201": 1, "99202": 2, "99203": 3, "99204": 4, "99205": 5,
    "99211": 1, "99212": 2, "99213": 3, "99214": 4, "99215": 5,
    "99281": 1, "99282": 2, "99283": 3, "99284": 4, "99285": 5,
}
PROCEDURE_MINUTES = {"99213": 15, "99214": 25, "99215": 40, "90837": 60, "97110": 15}
DEFAULT_MINUTES = 15


def as_npi(c: Column) -> Column:
    return F.trim(c.cast("string"))


def money(c: Column) -> Column:
    """``$1,234.50`` as 1234.5; null and what is no number as 0; negatives as 0."""
    parsed = F.translate(c.cast("string"), "$,", "").try_cast("double")
    return F.greatest(F.coalesce(F.nanvl(parsed, F.lit(0.0)), F.lit(0.0)), F.lit(0.0))


def lenient_date(c: Column) -> Column:
    """A timestamp without zone; null where it can't be read."""
    return c.cast("string").try_cast("timestamp_ntz")


def code(c: Column) -> Column:
    return F.replace(F.upper(F.trim(c.cast("string"))), F.lit("."), F.lit(""))


def weekday(c: Column) -> Column:
    """Monday is 0."""
    return F.weekday(c)


def is_weekend(c: Column) -> Column:
    return F.weekday(c) >= 5


def date_parts(c: Column) -> dict[str, Column]:
    return {"day_of_week": F.weekday(c), "month": F.month(c), "quarter": F.quarter(c), "year": F.year(c), "is_weekend": is_weekend(c).cast("int")}


def lookup(c: Column, values: dict, default=None) -> Column:
    """The value of a small fixed map; ``default`` for other keys and null."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v))]
    found = F.element_at(F.create_map(*pairs), c)
    return found if default is None else F.coalesce(found, F.lit(default))


def em_level(c: Column) -> Column:
    return lookup(c, EM_LEVELS)


def minutes(c: Column) -> Column:
    return lookup(c, PROCEDURE_MINUTES, DEFAULT_MINUTES)


def finite(c: Column) -> Column:
    """0 for null, NaN and the infinities."""
    return F.when(c.isNull() | F.isnan(c) | c.isin(float("inf"), float("-inf")), F.lit(0.0)).otherwise(c)


def finite_columns(df: DataFrame, *keep: str) -> DataFrame:
    """0 instead of null in all numeric columns but ``keep``, and instead of NaN and infinities in doubles."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if name in keep:
            out.append(c)
        elif kind in ("double", "float"):
            out.append(finite(c).alias(name))
        elif kind in ("bigint", "int", "smallint", "tinyint"):
            out.append(F.coalesce(c, F.lit(0).cast(kind)).alias(name))
        else:
            out.append(c)
    return df.select(*out)


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(c, F.lit(500.0)), F.lit(-500.0))))


def min_max(df: DataFrame, column: str, out: str) -> DataFrame:
    """``column`` scaled to 0 .. 1 over the whole table; its one-row bounds are broadcast."""
    bounds = df.agg(F.min(column).alias("low_"), F.max(column).alias("high_"))
    scaled = (F.col(column) - F.col("low_")) / (F.col("high_") - F.col("low_") + 1e-10)
    return df.join(F.broadcast(bounds)).withColumn(out, scaled).drop("low_", "high_")


def exact_sum(c: Column) -> Column:
    """A sum of money that doesn't depend on the order of its rows: over decimals of six places."""
    return F.sum(c.cast("decimal(28,6)")).cast("double")


def percentiles(df: DataFrame, key: str, value: str, **shares: float) -> DataFrame:
    """(key, one column for each share): exact percentiles, linear between neighbours, nulls left out.

    Counts of equal values are added before the shuffle and run through a window that spills, so a key with a large part of
    all rows needs no memory for them; percentile() would hold a key's values in one buffer.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n_"))
    by_key = Window.partitionBy(key)
    counts = counts.withColumns({"upto_": F.sum("n_").over(by_key.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "all_": F.sum("n_").over(by_key)})
    out = []
    for name, share in shares.items():
        place = (F.col("all_") - 1) * F.lit(float(share))
        low = F.min(F.when(F.col("upto_") > F.floor(place), F.col(value)))
        high = F.min(F.when(F.col("upto_") > F.ceil(place), F.col(value)))
        part = F.max(place - F.floor(place))
        out.append((low + (high - low) * part).alias(name))
    return counts.groupBy(key).agg(*out)
