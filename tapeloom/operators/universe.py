"""Point-in-time universes (symbol, start_date, end_date or null, reason) and as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load_csv(spark: SparkSession, path: str) -> DataFrame:
    x = spark.read.option("header", True).schema("symbol string, start_date date, end_date date, reason string").csv(path)
    return x.withColumn("reason", F.coalesce("reason", F.lit("")))


def add_member(members: DataFrame, symbol: str, start: str, end: str | None = None, reason: str = "") -> DataFrame:
    """members and one more."""
    row = members.sparkSession.createDataFrame([(symbol, start, end, reason)], "symbol string, start_date string, end_date string, reason string")
    return members.unionByName(row.select(*[F.col(f.name).cast(f.dataType) for f in members.schema.fields]))


def export(members: DataFrame) -> DataFrame:
    """Members in the order of symbol and start, as a table to keep."""
    return members.select("symbol", "start_date", "end_date", F.coalesce("reason", F.lit("")).alias("reason")).orderBy("symbol", "start_date")


def active(members: DataFrame, dates: DataFrame) -> DataFrame:
    """(d, symbol) of the members on each date, ends included, open-ended ones always.

    An interval join turned into an equality: dates and intervals meet by month, so no pair of a date and a member of
    other months is formed.
    """
    last = dates.agg(F.max("d").alias("last"))
    m = members.join(F.broadcast(last), F.lit(True)).withColumn("upto", F.coalesce(F.least("end_date", "last"), F.col("last"))).where(F.col("start_date") <= F.col("upto"))
    m = m.withColumn("month", F.explode(F.sequence(F.trunc("start_date", "month"), F.trunc("upto", "month"), F.expr("interval 1 month"))))
    x = dates.withColumn("month", F.trunc("d", "month")).join(m, "month")
    return x.where((F.col("start_date") <= F.col("d")) & (F.col("end_date").isNull() | (F.col("end_date") >= F.col("d")))).select("d", "symbol")


def on(members: DataFrame, day: Column) -> DataFrame:
    return members.where((F.col("start_date") <= day) & (F.col("end_date").isNull() | (F.col("end_date") >= day))).select("symbol").orderBy("symbol")


def additions(members: DataFrame, start: str, end: str) -> DataFrame:
    return members.where(F.col("start_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def removals(members: DataFrame, start: str, end: str) -> DataFrame:
    return members.where(F.col("end_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def changes(members: DataFrame, start: str, end: str) -> DataFrame:
    a = additions(members, start, end).select("symbol", F.col("start_date").alias("d"), F.lit("added").alias("change"))
    return a.unionByName(removals(members, start, end).select("symbol", F.col("end_date").alias("d"), F.lit("removed").alias("change")))


def as_of(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """left (key, ts, ...) with the value of right's latest row of the key at or before ts: one sort of the union, no range join."""
    r = right.select(key, "ts", F.col(value).alias("_v"), F.lit(0).alias("_side"))
    both = left.withColumn("_v", F.lit(None).cast(r.schema["_v"].dataType)).withColumn("_side", F.lit(1)).unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select(*left.columns, value)


def adjusted(prices: DataFrame, factors: DataFrame) -> DataFrame:
    """prices (symbol, ts, close) times the product of the symbol's factors (symbol, ts, factor) dated up to each bar."""
    f = factors.select("symbol", "ts", "factor", F.lit(0).alias("_side"))
    both = prices.withColumn("factor", F.lit(1.0)).withColumn("_side", F.lit(1)).unionByName(f, allowMissingColumns=True)
    w = Window.partitionBy("symbol").orderBy("ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("adjustment", F.product("factor").over(w)).where("_side = 1").select(*prices.columns, "adjustment", (F.col("close") * F.col("adjustment")).alias("adjusted_close"))


def compose(snapshot: Column, added: Column, removed: Column) -> Column:
    """The next set of constituents."""
    return F.array_except(F.array_union(snapshot, added), removed)
