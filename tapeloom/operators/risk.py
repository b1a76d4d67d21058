"""Position sizing, limits and exposure control as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.folds import fold, kind
from tapeloom.functions.windows import last_rows, ordered, so_far, td


def kelly(win_rate: Column, win_loss: Column, value: Column, price: Column, signal: Column, fraction: float = 0.25, cap: float = 0.10, least: float = 0.01) -> Column:
    """Signed shares: a fraction of Kelly's bet, within 0..cap, 0 below `least`, scaled by the signal's strength."""
    f = td(win_rate * win_loss - (1 - win_rate), win_loss) * F.lit(float(fraction))
    bounded = F.least(F.greatest(f, F.lit(0.0)), F.lit(float(cap)))
    share = F.when(bounded < least, 0.0).otherwise(bounded) * F.abs(signal)
    return F.floor(td(value * share, price)) * F.signum(signal)


def fixed_fractional(value: Column, price: Column, stop: Column, risk: float = 0.02, cap: float = 0.10) -> Column:
    """Shares that lose `risk` of the value at the stop distance, at most `cap` of it."""
    return F.floor(F.least(td(value * F.lit(float(risk)), stop), td(value * F.lit(float(cap)), price)))


def volatility_target(value: Column, price: Column, volatility: Column, signal: Column, target: float = 0.15, cap: float = 0.25) -> Column:
    share = F.least(td(F.lit(float(target)), volatility), F.lit(float(cap))) * F.abs(signal)
    return F.floor(td(value * share, price)) * F.signum(signal)


def equal_weight(value: Column, price: Column, n: Column, cap: float = 0.10) -> Column:
    return F.floor(td(value * F.least(td(F.lit(1.0), n), F.lit(float(cap))), price))


def pre_trade(orders: DataFrame, max_position: float = 0.10, max_exposure: float = 1.0, max_orders: int = 100, max_daily_loss: float = 0.03) -> DataFrame:
    """orders (order_value, portfolio_value, exposure, orders_today, daily_pnl) with the first limit they break, or null."""
    share = td(F.col("order_value"), F.col("portfolio_value"))
    reason = F.coalesce(
        F.when(share > max_position, "position limit"), F.when(td(F.col("exposure") + F.col("order_value"), F.col("portfolio_value")) > max_exposure, "exposure limit"),
        F.when(F.col("orders_today") >= max_orders, "order limit"), F.when(td(-F.col("daily_pnl"), F.col("portfolio_value")) > max_daily_loss, "daily loss limit"),
    )
    return orders.withColumn("reason", reason).withColumn("approved", reason.isNull())


def utilisation(current: Column, limit: Column) -> Column:
    return td(current, limit)


def derisk(drawdown: Column) -> Column:
    """The share of exposure kept at a drawdown (positive), in steps."""
    return F.when(drawdown < 0.05, 1.0).when(drawdown < 0.10, 0.75).when(drawdown < 0.15, 0.5).when(drawdown < 0.20, 0.25).otherwise(0.0)


def rolling_var(returns: DataFrame, key: str = "run_id", n: int = 252, least: int = 20, p: float = 0.05) -> DataFrame:
    """(key, ts, var, cvar) over the last n returns, once `least` are there."""
    w = last_rows(n, key)
    x = returns.withColumn("var", F.when(F.count("r").over(w) >= least, F.percentile("r", F.lit(p)).over(w))).withColumn("_seen", F.collect_list("r").over(w))
    below = F.filter("_seen", lambda v: v <= F.col("var"))
    mean = F.aggregate(below, F.lit(0.0), lambda a, v: a + v) / F.size(below)
    return x.select(key, "ts", "var", F.when(F.col("var").isNotNull(), mean).alias("cvar"))


def var_alerts(returns: DataFrame, key: str = "run_id", n: int = 252, least: int = 20, p: float = 0.05, limit: float = 0.05) -> DataFrame:
    """rolling_var() with an alarm where the value at risk is beyond the limit."""
    return rolling_var(returns, key, n, least, p).withColumn("alert", F.coalesce(F.abs("var") > limit, F.lit(False)))


def shaped_reward(steps: DataFrame, key: str = "run_id", risk: float = 0.5, drawdown: float = 2.0, turnover: float = 0.01, window: int = 20) -> DataFrame:
    """(key, ts, reward) of steps (key, ts, value, position): the return less penalties on its recent deviation, the drawdown squared and turnover.

    A key's first row only sets what the first step is measured against.
    """
    w = ordered(key)
    before = F.lag("value").over(w)
    x = steps.withColumn("r", (F.col("value") - before) / (before + F.lit(1e-8))).withColumn("moved", F.abs(F.col("position") - F.lag("position").over(w))).where("r is not null")
    recent = last_rows(window, key)
    deviation = F.when(F.count("r").over(recent) >= window, F.stddev_pop("r").over(recent)).otherwise(0.0)
    top = F.max("value").over(so_far(key))
    fall = (top - F.col("value")) / top
    return x.select(key, "ts", (F.col("r") - F.lit(risk) * deviation - F.lit(drawdown) * fall * fall - F.lit(turnover) * F.col("moved")).alias("reward"))


def differential_sharpe(returns: DataFrame, key: str = "run_id", eta: float = 0.001) -> DataFrame:
    """(key, ts, reward): what each return adds to an exponentially weighted Sharpe ratio; a fold carries the two moments."""

    def step(state, row):
        a, b = state
        r = row["r"]
        da, db, spread = r - a, r * r - b, b - a * a
        gain = (b * da - 0.5 * a * db) / spread**1.5 if spread > 0 else 0.0
        return (a + eta * da, b + eta * db), [(row[key], row["ts"], gain)]

    rows = returns.where("r is not null").select(key, "ts", "r")
    return fold(rows, (key,), ("ts",), lambda: (0.0, 0.0), step, f"{key} {kind(returns, key)}, ts {kind(returns, 'ts')}, reward double")


def softmax(x: Column, *keys: str) -> Column:
    """Weights of actions within a group."""
    w = Window.partitionBy(*keys)
    e = F.exp(x - F.max(x).over(w))
    return e / F.sum(F.exp(x - F.max(x).over(w))).over(w)


def directions(weight: Column, before: Column, least: float = 0.01) -> Column:
    """What a change of weight asks for."""
    return F.when(weight - before > least, "BUY").when(weight - before < -least, "SELL").otherwise("HOLD")


def controls(signal: Column, drawdown: Column, heat: Column, max_position: float = 0.10, max_heat: float = 0.20) -> Column:
    """A signal within the position limit, scaled down by drawdown, and 0 where the portfolio is too hot."""
    bounded = F.greatest(F.least(signal, F.lit(float(max_position))), F.lit(-float(max_position)))
    return F.when(heat >= max_heat, 0.0).otherwise(bounded * derisk(drawdown))
