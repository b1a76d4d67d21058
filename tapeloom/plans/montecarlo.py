"""Simulated paths of an equity curve, by drawing from its returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Returns that a row of paths may carry: 8 bytes each, so 16 MB.
MOST_RETURNS = 2_000_000


def bootstrap(returns: DataFrame, paths: int = 10_000, steps: int = 252, key: str = "run_id", seed: int = 42) -> DataFrame:
    """(key, path, total_return, max_drawdown) of `paths` paths of `steps` returns, each drawn at random, with repetition, from the key's.

    What a path draws follows from a hash of seed, path and step, so that a task that is run again draws alike. Paths are
    rows and their steps a fold within the row: nothing is shuffled but the key's returns, gathered once.
    """
    drawn = returns.where("r is not null").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ts", "r"))).alias("x")).select(key, F.transform("x", lambda v: v["r"]).alias("x"))
    if not drawn.where(F.size("x") > MOST_RETURNS).isEmpty():
        raise ValueError(f"a key has more than {MOST_RETURNS} returns")
    spark = returns.sparkSession
    every = drawn.crossJoin(spark.range(paths).withColumnRenamed("id", "path"))  # paths times keys, as asked for

    def step(acc, i):
        r = F.get("x", F.pmod(F.xxhash64(F.lit(seed), "path", i), F.size("x").cast("long")).cast("int"))
        worth = acc["worth"] * (1 + r)
        top = F.greatest(acc["top"], worth)
        return F.struct(worth.alias("worth"), top.alias("top"), F.least(acc["worst"], worth / top - 1).alias("worst"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(1.0).alias("worth"), F.lit(1.0).alias("top"), F.lit(0.0).alias("worst")), step)
    return every.withColumn("_end", end).select(key, "path", (F.col("_end.worth") - 1).alias("total_return"), F.col("_end.worst").alias("max_drawdown"))


def summary(paths: DataFrame, key: str = "run_id") -> DataFrame:
    """(key, n_paths, mean_return, p05, p50, p95, loss_share, mean_drawdown) of simulated paths."""
    r = F.col("total_return")
    return paths.groupBy(key).agg(
        F.count("*").alias("n_paths"), F.avg(r).alias("mean_return"), *[F.percentile("total_return", F.lit(p)).alias(n) for p, n in ((0.05, "p05"), (0.5, "p50"), (0.95, "p95"))],
        F.avg((r < 0).cast("double")).alias("loss_share"), F.avg("max_drawdown").alias("mean_drawdown"),
    )
