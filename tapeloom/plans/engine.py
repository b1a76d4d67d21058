"""One entry to both ways of running a strategy over bars of many symbols."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.config import EngineConfig
from tapeloom.functions.windows import ordered
from tapeloom.operators import backtest, orders
from tapeloom.operators.signals import Strategy
from tapeloom.plans import optimize


@dataclass(frozen=True)
class Result:
    """Of a run: the mode, and frames with a row per symbol (summary), per bar (equity) and per change of position (trades)."""

    mode: str
    summary: DataFrame
    equity: DataFrame
    trades: DataFrame


def select_mode(strategy: Strategy) -> str:
    """Vectorized where the strategy has a signal, else event-driven."""
    return "vectorized" if strategy.signal is not None else "event_driven"


def run(bars: DataFrame, strategy: Strategy, mode: str | None = None, config: EngineConfig | None = None, capital: float | None = None) -> Result:
    """mode: vectorized or event_driven; without it the configuration's, and with that hybrid the strategy decides."""
    config = config or EngineConfig()
    mode = mode or config.mode
    if mode == "hybrid":
        mode = select_mode(strategy)
    if mode == "vectorized":
        if strategy.signal is None:
            raise ValueError(f"{strategy.name} has no signal")
        book = backtest.run(bars, strategy, config=config, capital=capital)
        return Result(mode, backtest.summary(book), book.select("symbol", "ts", "net", "equity"), backtest.trades(book))
    money = float(capital or config.default_capital)
    if strategy.on_bar is not None:
        x = orders.run_on_bar(bars, strategy.on_bar, money, config)
        before = F.coalesce(F.lag("position").over(ordered("symbol")), F.lit(0.0))
        fills = x.withColumn("quantity", F.col("position") - before).where("quantity <> 0")
        curve = x.select("symbol", "ts", "equity")
    elif strategy.event:
        fills = orders.fold_fills(orders.ma_decisions(bars, **strategy.params), config, money)
        curve = orders.equity(bars, fills, money)
    else:
        raise ValueError(f"{strategy.name} doesn't trade bar by bar")
    return Result("event_driven", orders.summary(curve, fills, money), curve, fills)


def validate(bars: DataFrame, strategy: Strategy, **options) -> Result:
    """The event-driven run, by which a vectorized one is checked."""
    return run(bars, strategy, "event_driven", **options)


def compare_modes(bars: DataFrame, strategy: Strategy, **options) -> DataFrame:
    """(symbol, sharpe_gap, return_gap): vectorized less event-driven."""
    v, e = (run(bars, strategy, m, **options).summary for m in ("vectorized", "event_driven"))
    e = e.select("symbol", F.col("sharpe_ratio").alias("es"), F.col("total_return").alias("er"))
    return v.join(e, "symbol").select("symbol", (F.col("sharpe_ratio") - F.col("es")).alias("sharpe_gap"), (F.col("total_return") - F.col("er")).alias("return_gap"))


def run_batch(bars: DataFrame, make: Callable[..., Strategy], values: dict[str, list], mode: str = "vectorized", **options) -> DataFrame:
    """The summaries of all combinations, with combo_idx and parameters; event-driven ones are one plan for each combination."""
    if mode != "event_driven":
        return optimize.sweep(bars, make, values, **options)
    every = None
    for i, strategy in enumerate(optimize.combinations(make, values)):
        one = run(bars, strategy, mode, **options).summary.withColumn("combo_idx", F.lit(i))
        every = one if every is None else every.unionByName(one)
    return every.join(F.broadcast(optimize.grid(bars.sparkSession, **values)), "combo_idx")
