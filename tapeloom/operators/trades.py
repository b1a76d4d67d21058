"""Statistics of trades (timestamp, trade_id, symbol, price, pnl)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.windows import td


def _with_pnl(trades: DataFrame) -> DataFrame:
    return trades if "pnl" in trades.columns else trades.withColumn("pnl", F.lit(None).cast("double"))


def stats(trades: DataFrame, *keys: str) -> DataFrame:
    """One row (per key): counts, averages, extremes, ratios, and the system quality number (0 below 30 trades)."""
    p = F.col("pnl")
    g = _with_pnl(trades).groupBy(*keys).agg(
        F.count("*").alias("total_trades"), F.count("pnl").alias("n"), F.count_if(p > 0).alias("winning_trades"), F.count_if(p < 0).alias("losing_trades"),
        F.coalesce(F.avg(F.when(p > 0, p)), F.lit(0.0)).alias("average_win"), F.coalesce(F.avg(F.when(p < 0, p)), F.lit(0.0)).alias("average_loss"), F.coalesce(F.avg(p), F.lit(0.0)).alias("average_trade"),
        F.coalesce(F.max(p), F.lit(0.0)).alias("largest_win"), F.coalesce(F.min(p), F.lit(0.0)).alias("largest_loss"), F.coalesce(F.sum(F.when(p > 0, p)), F.lit(0.0)).alias("won"),
        F.coalesce(-F.sum(F.when(p < 0, p)), F.lit(0.0)).alias("lost"), F.stddev_pop(p).alias("sd"),
    )
    g = g.withColumn("win_rate", F.when(F.col("n") == 0, 0.0).otherwise(td(F.col("winning_trades"), F.col("n"))))

    def ratio(a, b):
        return F.when(b == 0, F.when(a > 0, float("inf")).otherwise(0.0)).otherwise(td(a, b))

    return g.select(
        *keys, "total_trades", "winning_trades", "losing_trades", "win_rate", "average_win", "average_loss", "average_trade", "largest_win", "largest_loss", ratio(F.col("won"), F.col("lost")).alias("profit_factor"),
        (F.col("win_rate") * F.col("average_win") - (1 - F.col("win_rate")) * F.abs("average_loss")).alias("expectancy"), ratio(F.col("average_win"), F.abs("average_loss")).alias("payoff_ratio"),
        F.when((F.col("n") < 30) | (F.coalesce("sd", F.lit(0.0)) == 0), 0.0).otherwise(td(F.sqrt(F.col("n").cast("double")) * F.col("average_trade"), F.col("sd"))).alias("sqn"),
        F.lit(0.0).alias("avg_holding_period"),
    )


def streaks(trades: DataFrame, *keys: str) -> DataFrame:
    """The longest runs of wins and of losses, in order of time and id; a flat trade ends both.

    Runs are found within months, each a task's worth; of a month only its first and last run and its longest ones go on,
    and those of neighbouring months are joined. So no task sees all trades of a key.
    """
    part = [*keys, F.date_trunc("month", "timestamp").alias("month")]
    x = trades.select(*part, "timestamp", "trade_id", F.signum(F.coalesce("pnl", F.lit(0.0))).alias("s"))
    order, same = (Window.partitionBy(*keys, "month", *more).orderBy("timestamp", "trade_id") for more in ((), ("s",)))
    x = x.withColumn("n", F.row_number().over(order)).withColumn("island", F.col("n") - F.row_number().over(same))
    runs = x.groupBy(*keys, "month", "s", "island").agg(F.count("*").alias("size"), F.min("n").alias("at"))
    run = F.struct("at", "s", "size")
    m = runs.groupBy(*keys, "month").agg(F.min(run).alias("head"), F.max(run).alias("tail"), *[F.max(F.when(F.col("s") == sign, F.col("size"))).alias(f"most{sign}") for sign in (1, -1)])
    # a month of several runs breaks the chain between its first and its last
    ends = F.when(F.col("head.at") == F.col("tail.at"), F.array("head")).otherwise(F.array("head", F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("size")), "tail"))
    e = m.select(*keys, "month", F.posexplode(ends).alias("pos", "x")).select(*keys, "month", "pos", "x.s", "x.size")
    order, same = (Window.partitionBy(*keys, *more).orderBy("month", "pos") for more in ((), ("s",)))
    e = e.withColumn("island", F.row_number().over(order) - F.row_number().over(same))
    joined = e.groupBy(*keys, "s", "island").agg(F.sum("size").alias("size"))
    every = joined.select(*keys, "s", "size")
    for sign in (1, -1):
        every = every.unionByName(m.where(F.col(f"most{sign}").isNotNull()).select(*keys, F.lit(float(sign)).alias("s"), F.col(f"most{sign}").alias("size")))
    return every.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("s") > 0, F.col("size"))), F.lit(0)).alias("max_consecutive_wins"), F.coalesce(F.max(F.when(F.col("s") < 0, F.col("size"))), F.lit(0)).alias("max_consecutive_losses")
    )


def summary(trades: DataFrame) -> DataFrame:
    """The summary's fifteen entries in one row: statistics and longest runs."""
    s = stats(trades).drop("avg_holding_period")
    return s.join(F.broadcast(streaks(_with_pnl(trades))), F.lit(True))  # one row each


def monthly(trades: DataFrame) -> DataFrame:
    """Trades, total and mean pnl by month; without a pnl column the latter two are counts."""
    month = F.date_trunc("month", "timestamp").cast("date").alias("month")
    sums = (F.sum("pnl"), F.avg("pnl")) if "pnl" in trades.columns else (F.count("price"), F.count("price"))
    return trades.groupBy(month).agg(F.count("price").alias("n_trades"), sums[0].alias("total_pnl"), sums[1].alias("mean_pnl"))


def by_symbol(trades: DataFrame) -> DataFrame:
    return trades.groupBy("symbol").agg(F.count("price").alias("n_trades"), F.sum("pnl").alias("total_pnl"), F.avg("pnl").alias("mean_pnl")).orderBy(F.desc("total_pnl"))


def rollup(trades: DataFrame) -> DataFrame:
    """By symbol and month, by symbol, and in all (an extension)."""
    return trades.rollup("symbol", F.date_trunc("month", "timestamp").cast("date").alias("month")).agg(F.count("price").alias("n_trades"), F.sum("pnl").alias("total_pnl"))
