"""Trading signals as columns over windows; a strategy is a function of the keys that gives a column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.windows import forbid_lookahead, last_rows, row_index, simple_return


@dataclass(frozen=True)
class Strategy:
    """signal(keys) gives the position a bar decides on, in -1..1.

    event: whether the event-driven engine knows its decisions; on_bar: what decides bar by bar otherwise (see
    orders.run_on_bar). A strategy may have either or both; params are those it was made with.
    """

    name: str
    signal: Callable[..., Column] | None = None
    event: bool = False
    on_bar: Callable | None = None
    params: dict = field(default_factory=dict)


def momentum(lookback: int = 20) -> Strategy:
    """Sign of the mean of the last `lookback` returns; 0 until there are as many."""

    def signal(*keys: str) -> Column:
        return F.when(F.col("row_idx") < lookback, 0.0).otherwise(F.signum(F.avg("ret").over(last_rows(lookback, *keys))))

    return Strategy(f"momentum({lookback})", signal, params={"lookback": lookback})


def ma_cross(fast: int = 10, slow: int = 30) -> Strategy:
    """+1 where the fast moving average is above the slow one, else -1; 0 until both are full."""
    if fast >= slow:
        raise ValueError("the fast period must be shorter than the slow one")

    def signal(*keys: str) -> Column:
        above = F.avg("close").over(last_rows(fast, *keys)) > F.avg("close").over(last_rows(slow, *keys))
        return F.when(F.col("row_idx") < slow - 1, 0.0).otherwise(F.when(above, 1.0).otherwise(-1.0))

    return Strategy(f"ma_cross({fast},{slow})", signal, event=True, params={"fast": fast, "slow": slow})


def prepared(bars: DataFrame, *keys: str) -> DataFrame:
    """Bars with row_idx and ret, which strategies read."""
    return bars.withColumn("row_idx", row_index(*keys)).withColumn("ret", simple_return(F.col("close"), *keys))


def with_signal(bars: DataFrame, strategy: Strategy, *keys: str) -> DataFrame:
    keys = keys or ("symbol",)
    return prepared(bars, *keys).withColumn("signal", forbid_lookahead(strategy.signal(*keys)))
