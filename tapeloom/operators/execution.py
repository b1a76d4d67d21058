"""Execution schedules: an order (order_id, quantity, start, ...) becomes slices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shares of a day's volume, from its beginning to its end.
PROFILE = (0.15, 0.10, 0.08, 0.07, 0.06, 0.05, 0.05, 0.05, 0.05, 0.05, 0.06, 0.08, 0.10, 0.15)


def twap(orders: DataFrame, slices: int = 10, minutes: float = 30) -> DataFrame:
    """Equal slices, an equal time apart."""
    x = orders.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return x.select("order_id", "slice", (F.col("quantity") / slices).alias("slice_quantity"), (F.col("slice") * F.lit(minutes * 60 / slices)).alias("offset_seconds"))


def vwap(orders: DataFrame, profile: tuple[float, ...] = PROFILE, minutes: float = 60) -> DataFrame:
    """Slices by the profile; those below one unit are left out, and the next follows without a wait in their place."""
    total = sum(profile)
    parts = F.array(*[F.struct(F.lit(i).alias("slice"), (F.col("quantity") * F.lit(p / total)).alias("q")) for i, p in enumerate(profile)])
    x = orders.select("order_id", F.posexplode(F.filter(parts, lambda x: x["q"] >= 1)).alias("sent", "x"))
    return x.select("order_id", "x.slice", F.col("x.q").alias("slice_quantity"), (F.col("sent") * F.lit(minutes * 60 / len(profile))).alias("offset_seconds"))


def iceberg(orders: DataFrame, visible: int = 10) -> DataFrame:
    n = F.ceil(F.col("quantity") / visible).cast("int")
    x = orders.where("quantity > 0").withColumn("slice", F.explode(F.sequence(F.lit(0), n - 1)))
    return x.select("order_id", "slice", F.least(F.lit(visible), F.col("quantity") - F.col("slice") * visible).cast("long").alias("slice_quantity"))
