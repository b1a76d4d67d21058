"""The vectorised backtest: lagged signals, costs, equity and summary, for any number of keys in one plan.

All windows share one partitioning and order, so signals, returns and equity need one exchange; the summary needs one more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.config import EngineConfig
from tapeloom.functions.costs import bar_commission, bar_slippage
from tapeloom.functions.windows import ordered, so_far, td
from tapeloom.operators.signals import Strategy, with_signal


def ledger(signals: DataFrame, *keys: str, config: EngineConfig | None = None, capital: float | None = None) -> DataFrame:
    """signals with change, cost, gross, net and equity of every bar.

    The signal of a bar earns the return of the next; a change of position costs what the bar that decided it says. The
    first bar's equity is the capital; later ones multiply one plus net returns.
    """
    config = config or EngineConfig()
    start = float(capital or config.default_capital)
    keys = keys or ("symbol",)
    w = ordered(*keys)
    change = F.col("held") - F.coalesce(F.lag("signal", 2).over(w), F.lit(0.0))
    x = signals.withColumn("held", F.lag("signal").over(w)).withColumn("last_close", F.lag("close").over(w)).withColumn("last_volume", F.lag("volume").over(w))
    x = x.withColumn("change", change)
    cost = bar_slippage(F.col("change"), F.col("last_volume"), config.slippage.model, config.slippage.base_bps, config.slippage.impact_factor)
    cost = cost + bar_commission(F.col("change"), F.col("last_close"), config.commission.per_share)
    x = x.withColumn("gross", F.col("held") * F.col("ret")).withColumn("cost", cost).withColumn("net", F.col("gross") - F.col("cost"))
    grown = F.product(F.lit(1.0) + F.coalesce("net", F.lit(0.0))).over(so_far(*keys))
    return x.withColumn("equity", F.lit(start) * grown).drop("last_close", "last_volume")


def run(bars: DataFrame, strategy: Strategy, *keys: str, config: EngineConfig | None = None, capital: float | None = None) -> DataFrame:
    return ledger(with_signal(bars, strategy, *keys), *keys, config=config, capital=capital)


def trades(book: DataFrame, least: float = 0.01) -> DataFrame:
    return book.where(F.abs("change") > least)


def _ratio(a: Column, b: Column) -> Column:
    return td(a, F.greatest(b, F.lit(1e-10)))


def figures(x: DataFrame, *keys: str, capital: Column | None = None, trades: Column | None = None) -> DataFrame:
    """The engine's ten figures (population deviations, floors of 1e-10), dates and capital of (keys, ts, equity, net, dd).

    capital: what equity starts from, by default its first value; trades: their number, by default the changes above 0.01.
    """
    first = F.min_by("equity", "ts") if capital is None else F.first(capital)
    n_trades = F.count_if(F.abs("change") > 0.01) if trades is None else F.max(trades)
    g = x.groupBy(*keys).agg(
        F.count("net").alias("n"), first.alias("initial_capital"), F.max_by("equity", "ts").alias("final_capital"), F.avg("net").alias("mean"), F.stddev_pop("net").alias("sd"),
        F.coalesce(F.stddev_pop(F.when(F.col("net") < 0, F.col("net"))), F.lit(1e-10)).alias("down"), F.min("dd").alias("max_drawdown"),
        n_trades.alias("total_trades"), F.avg(F.when(F.col("net") > 0, 1.0).when(F.col("net").isNotNull(), 0.0)).alias("win_rate"),
        F.coalesce(F.sum(F.when(F.col("net") > 0, F.col("net"))), F.lit(0.0)).alias("won"), F.coalesce(F.sum(F.when(F.col("net") < 0, F.col("net"))), F.lit(0.0)).alias("lost"),
        F.min("ts").alias("start_date"), F.max("ts").alias("end_date"),
    )
    total = F.col("final_capital") / F.col("initial_capital") - 1
    g = g.withColumn("total_return", total)
    g = g.withColumn("annual_return", F.when(F.col("total_return") > -1, F.pow(1 + F.col("total_return"), 1 / F.greatest(F.col("n") / F.lit(252.0), F.lit(0.01)))) - 1)
    root = F.sqrt(F.lit(252.0))
    return g.select(
        *keys, "total_return", "annual_return", (_ratio(F.col("mean"), F.col("sd")) * root).alias("sharpe_ratio"), (_ratio(F.col("mean"), F.col("down")) * root).alias("sortino_ratio"),
        "max_drawdown", _ratio(F.col("annual_return"), F.abs("max_drawdown")).alias("calmar_ratio"), "total_trades", "win_rate", _ratio(F.col("won"), F.abs("lost")).alias("profit_factor"),
        F.col("mean").alias("avg_trade_return"), "start_date", "end_date", "initial_capital", "final_capital",
    )


def summary(book: DataFrame, *keys: str) -> DataFrame:
    """One row per key of a ledger: the engine's figures."""
    keys = keys or ("symbol",)
    top = F.max("equity").over(so_far(*keys))
    return figures(book.withColumn("dd", F.col("equity") / top - 1), *keys)


def report(result: DataFrame, *keys: str) -> DataFrame:
    """The summary as (key, metric, text)."""
    keys = keys or ("symbol",)
    share = [F.format_string("%.2f%%", F.col(c) * 100).alias(c) for c in ("total_return", "annual_return", "max_drawdown", "win_rate")]
    plain = [F.format_string("%.2f", F.col(c)).alias(c) for c in ("sharpe_ratio", "sortino_ratio", "calmar_ratio", "profit_factor")]
    x = result.select(*keys, *share, *plain, F.col("total_trades").cast("string").alias("total_trades"))
    return x.unpivot(list(keys), [c for c in x.columns if c not in keys], "metric", "text")
