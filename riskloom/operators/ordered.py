"""Running totals over a whole table in order, without a window that draws all rows into one task.

Rows are range-partitioned by the order, written with the number of their partition, and summed within it; the totals of the
partitions before, one row for each partition, are added back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.graph_algorithms import written


def with_running_totals(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``df`` with, for each ``{name: column}`` of ``sums``, the total of the column up to and with the row, and ``{name}_all``, the
    total of all rows. Ties of ``order`` may stand either way. Null counts as 0."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(parts, *order).withColumn("part_", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("part_").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"t_{n}") for n, c in sums.items()])
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    offsets = totals.select("part_", *[F.coalesce(F.sum(f"t_{n}").over(before), F.lit(0)).alias(f"b_{n}") for n in sums], *[F.sum(f"t_{n}").over(every).alias(f"{n}_all") for n in sums])
    within = Window.partitionBy("part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = ranged.withColumns({f"w_{n}": F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()})
    rows = rows.join(F.broadcast(offsets), "part_")
    return rows.select(*df.columns, *[(F.col(f"w_{n}") + F.col(f"b_{n}")).alias(n) for n in sums], *[f"{n}_all" for n in sums])


def numbered(ids: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct ids numbered from 0 on in order."""
    rows = with_running_totals(ids.select(column, F.lit(1).cast("long").alias("one_")), [F.col(column)], {name: "one_"})
    return rows.select(column, (F.col(name) - 1).alias(name))
