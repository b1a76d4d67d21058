"""Return and risk metrics of series (key, ts, r): sample deviations, zero guards, all from one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.windows import so_far, td


def clean(returns: DataFrame) -> DataFrame:
    return returns.where(F.col("r").isNotNull() & ~F.isnan("r"))


def _guarded(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0, null where b is null."""
    return F.when(b == 0, 0.0).otherwise(td(a, b))


def _or_inf(gain: Column, loss: Column) -> Column:
    return F.when(loss == 0, F.when(gain > 0, float("inf")).otherwise(0.0)).otherwise(td(gain, loss))


def report(returns: DataFrame, key: str = "run_id", rf: float = 0.0, periods: int = 252, threshold: float = 0.0, confidence: float = 0.95) -> DataFrame:
    """One row per key with every metric; moments are bias-corrected, percentiles exact and linear."""
    tail = round(1 - confidence, 12)
    r = F.col("r")
    x = clean(returns).withColumn("grown", F.product(1 + r).over(so_far(key)))
    x = x.withColumn("dd", F.col("grown") / F.max("grown").over(so_far(key)) - 1)
    level = clean(returns).groupBy(key).agg(F.percentile("r", F.lit(tail)).alias("var_"), F.percentile("r", F.lit(0.95)).alias("p95"), F.percentile("r", F.lit(0.05)).alias("p05"))
    excess = r - rf / periods
    g = x.join(level, key).groupBy(key).agg(
        F.count("r").alias("n"), (F.product(1 + r) - 1).alias("total_return"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"),
        F.stddev_samp(F.when(r < threshold, r)).alias("down"), F.count_if(r < threshold).alias("n_down"), F.avg(excess).alias("ex_mean"), F.stddev_samp(excess).alias("ex_sd"),
        F.stddev_samp(F.when(excess < threshold, excess)).alias("ex_down"), F.count_if(excess < threshold).alias("n_ex_down"), F.min("dd").alias("max_drawdown"),
        F.first("var_").alias("var"), F.avg(F.when(r <= F.col("var_"), r)).alias("cvar"), F.first("p95").alias("p95"), F.first("p05").alias("p05"),
        F.avg((r > 0).cast("double")).alias("win_rate"), F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)).alias("won"), F.coalesce(-F.sum(F.when(r < 0, r)), F.lit(0.0)).alias("lost"),
        F.sum(F.greatest(r - threshold, F.lit(0.0))).alias("above"), F.sum(F.greatest(threshold - r, F.lit(0.0))).alias("below"), F.skewness("r").alias("g1"), F.kurtosis("r").alias("g2"),
        F.min("r").alias("worst"), F.max("r").alias("best"),
    )
    n, root = F.col("n").cast("double"), F.sqrt(F.lit(float(periods)))
    annual = F.pow(1 + F.col("total_return"), td(F.lit(float(periods)), n)) - 1
    g = g.withColumn("annual_return", F.when(F.col("total_return") > -1, annual))
    return g.select(
        key, "n", "total_return", "annual_return", (F.col("sd") * root).alias("volatility"),
        F.when(F.col("n_down") == 0, 0.0).otherwise(F.col("down") * root).alias("downside_volatility"), (_guarded(F.col("ex_mean"), F.col("ex_sd")) * root).alias("sharpe_ratio"),
        F.when(F.col("n_ex_down") == 0, 0.0).otherwise(_guarded(F.col("ex_mean"), F.col("ex_down")) * root).alias("sortino_ratio"), _guarded(F.col("annual_return"), F.abs("max_drawdown")).alias("calmar_ratio"),
        "max_drawdown", "var", "cvar", F.abs(_guarded(F.col("p95"), F.col("p05"))).alias("tail_ratio"), "win_rate", _or_inf(F.col("won"), F.col("lost")).alias("profit_factor"), _or_inf(F.col("above"), F.col("below")).alias("omega_ratio"),
        F.when(F.col("n") >= 3, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"), F.when(F.col("n") >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)).alias("kurtosis"),
        F.col("mean").alias("daily_mean"), F.col("best").alias("best_day"), F.col("worst").alias("worst_day"),
    )


def information_ratio(returns: DataFrame, benchmark: DataFrame, key: str = "run_id", periods: int = 252) -> DataFrame:
    """Mean over deviation of active returns on the dates both series have, annualised."""
    b = clean(benchmark).select("ts", F.col("r").alias("b"))
    active = clean(returns).join(b, "ts").withColumn("a", F.col("r") - F.col("b"))
    g = active.groupBy(key).agg(F.avg("a").alias("m"), F.stddev_samp("a").alias("s"))
    return g.select(key, (_guarded(F.col("m"), F.col("s")) * F.sqrt(F.lit(float(periods)))).alias("information_ratio"))


def long_form(wide: DataFrame, key: str = "run_id") -> DataFrame:
    """(key, metric, value) of a one-row-per-key report."""
    numbers = [c for c in wide.columns if c != key]
    return wide.select(key, *[F.col(c).cast("double").alias(c) for c in numbers]).unpivot(key, numbers, "metric", "value")


#: Entries of the report in their order, with how they are written.
ENTRIES = {
    "total_return": "%.2f%%", "annual_return": "%.2f%%", "volatility": "%.2f%%", "sharpe_ratio": "%.2f", "sortino_ratio": "%.2f", "calmar_ratio": "%.2f", "max_drawdown": "%.2f%%", "var": "%.2f%%", "cvar": "%.2f%%",
    "skewness": "%.2f", "kurtosis": "%.2f", "tail_ratio": "%.2f", "win_rate": "%.2f%%", "profit_factor": "%.2f", "omega_ratio": "%.2f", "n": "%.0f",
}


def written(wide: DataFrame, key: str = "run_id") -> DataFrame:
    """(key, metric, text): the report's sixteen entries as text, shares in per cent."""
    parts = [F.format_string(f, F.col(c).cast("double") * (100 if f.endswith("%%") else 1)).alias(c) for c, f in ENTRIES.items()]
    return wide.select(key, *parts).unpivot(key, list(ENTRIES), "metric", "text")


def monthly_returns(returns: DataFrame, key: str = "run_id") -> DataFrame:
    """(key, month, monthly_return)."""
    return clean(returns).groupBy(key, F.trunc("ts", "month").alias("month")).agg((F.product(1 + F.col("r")) - 1).alias("monthly_return"))
