"""Drawdowns of equity curves (key, ts, equity): series, statistics and periods as islands between recoveries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.folds import fold, kind
from tapeloom.functions.windows import ordered, so_far, td


def series(equity: DataFrame, key: str = "run_id") -> DataFrame:
    top = F.max("equity").over(so_far(key))
    return equity.select(key, "ts", "equity", top.alias("running_max"), (F.col("equity") / top - 1).alias("dd"))


def stats(equity: DataFrame, key: str = "run_id") -> DataFrame:
    g = series(equity, key).groupBy(key).agg(
        F.min("dd").alias("max_drawdown"), F.coalesce(F.avg(F.when(F.col("dd") < 0, F.col("dd"))), F.lit(0.0)).alias("average_drawdown"), F.avg((F.col("dd") < 0).cast("double")).alias("time_underwater"),
        (F.max_by("equity", "ts") / F.min_by("equity", "ts") - 1).alias("gain"), F.sqrt(F.avg(F.col("dd") * F.col("dd"))).alias("ulcer_index"), F.abs(F.avg("dd")).alias("pain_index"),
    )
    return g.select(
        key, "max_drawdown", "average_drawdown", "time_underwater", F.when(F.col("max_drawdown") == 0, 0.0).otherwise(td(F.col("gain"), F.abs("max_drawdown"))).alias("recovery_factor"), "ulcer_index", "pain_index"
    )


def periods(equity: DataFrame, key: str = "run_id", least: float = -0.01) -> DataFrame:
    """Spells below the last peak that reach `least`: from the first bar below it to the first bar back at the peak.

    end_date is the trough's date if the spell has ended, else null; duration_days counts from start to trough or, if it
    hasn't ended, to the last bar.
    """
    w = so_far(key)
    x = series(equity, key).withColumn("seg", F.sum((F.col("dd") >= 0).cast("long")).over(w))
    x = x.withColumn("next_seg_ts", F.max(F.when(F.col("dd") >= 0, F.col("ts"))).over(Window.partitionBy(key, "seg")))
    starts = x.where("dd >= 0").select(key, (F.col("seg") - 1).alias("seg"), F.col("ts").alias("recovery_date"))
    g = x.where("dd < 0").groupBy(key, "seg").agg(
        F.min(F.when(F.col("dd") < least, F.col("ts"))).alias("start_date"), F.max("running_max").alias("peak"), F.min("equity").alias("trough"),
        F.min_by("ts", F.struct("equity", "ts")).alias("trough_date"), F.max("ts").alias("last_ts"), F.min("dd").alias("deepest"),
    )
    g = g.where(F.col("deepest") < least).join(starts, [key, "seg"], "left")
    return g.select(
        key, "start_date", F.when(F.col("recovery_date").isNotNull(), F.col("trough_date")).alias("end_date"), "trough_date", "recovery_date", "peak", "trough",
        (F.col("trough") / F.col("peak") - 1).alias("drawdown"), F.datediff(F.when(F.col("recovery_date").isNotNull(), F.col("trough_date")).otherwise(F.col("last_ts")), F.col("start_date")).alias("duration_days"),
    )


def deepest(found: DataFrame, key: str = "run_id", n: int = 5) -> DataFrame:
    w = Window.partitionBy(key).orderBy("drawdown", "start_date")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def longest(found: DataFrame, key: str = "run_id") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("duration_days"), "start_date")
    return found.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def monitor(equity: DataFrame, key: str = "run_id", warning: float = 0.10, critical: float = 0.15) -> DataFrame:
    """The level of alarm at every bar."""
    fall = -F.col("dd")
    return series(equity, key).select(key, "ts", "dd", F.when(fall >= critical, "CRITICAL").when(fall >= warning, "WARNING").otherwise("OK").alias("level"))


def breaker(checks: DataFrame, key: str = "run_id", limit: float = 0.15, daily_limit: float = 0.03, cooldown_minutes: int = 60) -> DataFrame:
    """checks (key, ts, drawdown, daily_loss) with what a circuit breaker does at each: reason where it triggers, active while it holds.

    It triggers at a drawdown of `limit` or a daily loss of one and a half times `daily_limit` (the reason named last where
    both hold), then holds for the cooldown; the first check later than that is judged anew. Triggers depend on each other,
    so a fold over the checks at a limit, in order of time, finds them.
    """
    hot = checks.where((F.col("drawdown") >= limit) | (F.col("daily_loss") >= daily_limit * 1.5))
    wait = dt.timedelta(minutes=cooldown_minutes)

    def step(last, row):
        if last is not None and row["ts"] - last <= wait:
            return last, []
        reason = "daily loss" if row["daily_loss"] is not None and row["daily_loss"] >= daily_limit * 1.5 else "drawdown"
        return row["ts"], [(row[key], row["ts"], reason)]

    found = fold(hot.select(key, "ts", "daily_loss"), (key,), ("ts",), lambda: None, step, f"{key} {kind(checks, key)}, ts {kind(checks, 'ts')}, reason string")
    since = F.last(F.when(F.col("reason").isNotNull(), F.col("ts")), ignorenulls=True).over(so_far(key))
    x = checks.join(found, [key, "ts"], "left")
    return x.select(*checks.columns, "reason", F.coalesce(F.col("ts") - since <= F.lit(wait), F.lit(False)).alias("active"))


def checks(equity: DataFrame, key: str = "run_id") -> DataFrame:
    """equity (key, ts, equity) with drawdown and daily_loss, the fall since the day's first value (0 above it), both positive."""
    day = Window.partitionBy(key, F.to_date("ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    fall = 1 - F.col("equity") / F.first("equity").over(day)
    return equity.select(key, "ts", "equity", (1 - F.col("equity") / F.max("equity").over(so_far(key))).alias("drawdown"), F.greatest(fall, F.lit(0.0)).alias("daily_loss"))


def report(equity: DataFrame, key: str = "run_id") -> DataFrame:
    """The summary's eight entries, per key: statistics, the number of periods and the days of the longest."""
    n = periods(equity, key).groupBy(key).agg(F.count("*").alias("n_drawdowns"), F.max("duration_days").alias("longest_days"))
    x = stats(equity, key).join(n, key, "left")
    return x.select(key, "max_drawdown", "average_drawdown", "time_underwater", F.coalesce("n_drawdowns", F.lit(0)).alias("n_drawdowns"), F.coalesce("longest_days", F.lit(0)).alias("longest_days"), "recovery_factor", "ulcer_index", "pain_index")


def lagged(equity: DataFrame, key: str = "run_id") -> DataFrame:
    """Simple returns of an equity curve, (key, ts, r)."""
    before = F.lag("equity").over(ordered(key))
    return equity.select(key, "ts", td(F.col("equity") - before, before).alias("r")).where("r is not null")
