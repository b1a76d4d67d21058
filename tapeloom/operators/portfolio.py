"""Portfolios: covariance in Spark, allocation in numpy over the few hundred assets of a portfolio, rebalancing as joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.functions.windows import td

#: Assets whose matrix may come to the driver: n squared numbers, 8 MB.
MOST_ASSETS = 1_000


def pairs(returns: DataFrame, key: str = "symbol") -> DataFrame:
    """(a, b, cov, corr) of every ordered pair of assets over the dates both have.

    Rows are dealt by date. A task adds up, for all its dates at once, products, sums and counts of pairs as matrices, so
    that it passes on a row per pair of assets and not per pair and date; values are taken less their asset's mean, which
    keeps the sums exact. Assets beyond MOST_ASSETS are joined on the date instead, of which there's a row per pair and date.
    """
    rows = returns.where(F.col("r").isNotNull()).select("ts", F.col(key).alias("a"), "r")
    means = [(x["a"], x["m"]) for x in rows.groupBy("a").agg(F.avg("r").alias("m")).orderBy("a").limit(MOST_ASSETS + 1).collect()]
    if len(means) > MOST_ASSETS:
        return rows.join(rows.select("ts", F.col("a").alias("b"), F.col("r").alias("y")), "ts").groupBy("a", "b").agg(F.covar_samp("r", "y").alias("cov"), F.corr("r", "y").alias("corr"))
    names, mean = [n for n, _ in means], np.array([m for _, m in means])
    at, n = {x: i for i, x in enumerate(names)}, len(means)

    def run(batches):
        sums, left = np.zeros((5, n, n)), []
        for batch in batches:
            left.append((batch.column("ts").to_pylist(), [at[x] for x in batch.column("a").to_pylist()], batch.column("r").to_numpy(zero_copy_only=False)))
            if sum(len(x[0]) for x in left) > 1 << 16:
                left = add(sums, left, False)
        add(sums, left, True)
        i, j = np.nonzero(sums[4])
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), *(pa.array(s[i, j]) for s in sums)], names=["i", "j", "xy", "x", "y", "xx", "k"])

    def add(sums, parts, last):
        """Adds up the dates that are complete (rows are sorted by date); gives back the others."""
        if not parts:
            return []
        ts = [t for p in parts for t in p[0]]
        asset, r = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        cut = len(ts) if last else next(k for k in range(len(ts) - 1, -1, -1) if k == 0 or ts[k] != ts[k - 1])
        days = {t: k for k, t in enumerate(dict.fromkeys(ts[:cut]))}
        x, there = np.zeros((len(days), n)), np.zeros((len(days), n))
        day = np.array([days[t] for t in ts[:cut]], dtype=np.int64)
        x[day, asset[:cut]], there[day, asset[:cut]] = r[:cut] - mean[asset[:cut]], 1.0
        for s, one, two in zip(sums, (x, x, there, x * x, there), (x, there, x, there, there), strict=True):
            s += one.T @ two
        return [(ts[cut:], asset[cut:], r[cut:])]

    parts = rows.repartition("ts").sortWithinPartitions("ts").mapInArrow(run, "i long, j long, xy double, x double, y double, xx double, k double")
    g = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("xy", "x", "y", "xx", "k")])
    other = g.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("xx").alias("yy"))
    label = F.array(*[F.lit(x) for x in names]) if names else F.array(F.lit(None).cast(rows.schema["a"].dataType))
    both = g.join(other, ["i", "j"])
    top = F.col("xy") - F.col("x") * F.col("y") / F.col("k")
    spread = (F.col("xx") - F.col("x") * F.col("x") / F.col("k")) * (F.col("yy") - F.col("y") * F.col("y") / F.col("k"))
    return both.select(F.get(label, F.col("i").cast("int")).alias("a"), F.get(label, F.col("j").cast("int")).alias("b"), td(top, F.col("k") - 1).alias("cov"), td(top, F.sqrt(F.greatest(spread, F.lit(0.0)))).alias("corr"))


def matrix(found: DataFrame, value: str = "cov") -> tuple[list[str], np.ndarray]:
    """The matrix on the driver; raises beyond MOST_ASSETS."""
    got = found.select("a", "b", value).limit(MOST_ASSETS**2 + 1).toArrow()
    if got.num_rows > MOST_ASSETS**2:
        raise ValueError(f"more than {MOST_ASSETS} assets")
    a, b, v = (got.column(k).to_pylist() for k in range(3))
    names = sorted(set(a))
    at = {n: i for i, n in enumerate(names)}
    out = np.zeros((len(names), len(names)))
    for p, q, x in zip(a, b, v, strict=True):
        out[at[p], at[q]] = x if x is not None else 0.0
    return names, out


def recent_correlation(returns: DataFrame, key: str = "strategy", n: int = 60) -> DataFrame:
    """(a, b, corr) of the last n returns of every pair of strategies that have as many, by their place from the end; none if fewer than two do."""
    last = Window.partitionBy(key).orderBy(F.desc("ts"))
    x = returns.where("r is not null").withColumn("ts", -F.row_number().over(last)).where(F.col("ts") >= -n)
    long = x.groupBy(key).count().where(F.col("count") >= n).select(key)
    found = pairs(x.join(long, key, "left_semi"), key).select("a", "b", "corr")
    return found.withColumn("_many", F.count("*").over(Window.partitionBy())).where("_many > 1").drop("_many")


def mean_variance(mu: np.ndarray, cov: np.ndarray, aversion: float = 1.0, cap: float = 0.20, steps: int = 20_000) -> np.ndarray:
    """Weights within 0..cap (raised to 1/n where that's needed) that sum to 1, of greatest return less aversion times volatility.

    Weight moves from the asset of the least gradient to that of the greatest, as far as that helps, until none gains; the
    aim is concave, so that is the best.
    """
    n = len(mu)
    cap = max(cap, 1 / n)
    x = np.full(n, 1 / n)
    s = cov @ x
    for _ in range(steps):
        risk = np.sqrt(max(x @ s, 1e-18))
        g = mu - aversion * s / risk
        to, source = int(np.where(x < cap - 1e-12, g, -np.inf).argmax()), int(np.where(x > 1e-12, g, np.inf).argmin())
        if not g[to] - g[source] > 1e-12 * np.abs(g).max():
            break
        a, b, c = mu[to] - mu[source], s[to] - s[source], cov[to, to] + cov[source, source] - 2 * cov[to, source]
        lo, hi = 0.0, min(cap - x[to], x[source])

        def slope(t, q=risk * risk, a=a, b=b, c=c):
            return a - aversion * (b + t * c) / np.sqrt(max(q + 2 * t * b + t * t * c, 1e-18))

        if slope(hi) > 0:
            lo = hi
        else:
            for _ in range(60):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if slope(mid) > 0 else (lo, mid)
        x[to], x[source] = x[to] + lo, x[source] - lo
        s = s + lo * (cov[:, to] - cov[:, source])
    return x


def frontier(mu: np.ndarray, cov: np.ndarray, n: int = 50, cap: float = 1.0) -> np.ndarray:
    """(volatility, return) of portfolios over a range of aversions."""
    out = [mean_variance(mu, cov, a, cap) for a in np.geomspace(0.001, 10, n)]
    return np.array([[np.sqrt(x @ cov @ x), x @ mu] for x in out])


def risk_parity(cov: np.ndarray, steps: int = 500) -> np.ndarray:
    """Weights of equal risk contributions, by cyclical coordinate descent."""
    n = len(cov)
    x = 1 / np.sqrt(np.maximum(np.diag(cov), 1e-18))
    for _ in range(steps):
        last = x.copy()
        for i in range(n):
            b = cov[i] @ x - cov[i, i] * x[i]
            x[i] = (-b + np.sqrt(b * b + 4 * cov[i, i] / n)) / (2 * cov[i, i])
        if np.abs(x - last).max() < 1e-14:
            break
    return x / x.sum()


def hierarchical_risk_parity(cov: np.ndarray, corr: np.ndarray) -> np.ndarray:
    """Single linkage on correlation distances, then bisection of its leaf order by inverse variance."""
    n = len(cov)
    d = np.sqrt(np.clip((1 - corr) / 2, 0, 1))
    groups: dict[int, list[int]] = {i: [i] for i in range(n)}
    far = d + np.diag(np.full(n, np.inf))
    while len(groups) > 1:
        i, j = divmod(int(far.argmin()), n)
        i, j = min(i, j), max(i, j)
        groups[i] += groups.pop(j)
        far[i] = far[:, i] = np.minimum(far[i], far[j])
        far[i, i] = np.inf
        far[j] = far[:, j] = np.inf
    order = next(iter(groups.values()))
    x = np.ones(n)

    def variance(part: list[int]) -> float:
        w = 1 / np.maximum(np.diag(cov)[part], 1e-18)
        w /= w.sum()
        return float(w @ cov[np.ix_(part, part)] @ w)

    todo = [order]
    while todo:
        part = todo.pop()
        if len(part) < 2:
            continue
        a, b = part[: len(part) // 2], part[len(part) // 2 :]
        va, vb = variance(a), variance(b)
        share = 1 - va / (va + vb) if va + vb > 0 else 0.5
        x[a] *= share
        x[b] *= 1 - share
        todo += [a, b]
    return x


def black_litterman(cov: np.ndarray, market: np.ndarray, picks: np.ndarray, views: np.ndarray, aversion: float = 2.5, tau: float = 0.05) -> np.ndarray:
    """Posterior expected returns."""
    prior = aversion * cov @ market
    omega = np.diag(np.diag(picks @ (tau * cov) @ picks.T))
    a = np.linalg.pinv(tau * cov)
    return np.linalg.solve(a + picks.T @ np.linalg.pinv(omega) @ picks, a @ prior + picks.T @ np.linalg.pinv(omega) @ views)


def weights_frame(spark: SparkSession, names: list[str], x: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, x, strict=True)], "symbol string, weight double")


def equal_weights(strategies: DataFrame, key: str = "symbol") -> DataFrame:
    return strategies.select(key).distinct().select(key, (1 / F.count("*").over(Window.partitionBy())).alias("weight"))


def inverse_volatility(returns: DataFrame, key: str = "symbol", n: int = 60, default: float = 0.20) -> DataFrame:
    """Weights in inverse proportion to the annual deviation of the last n returns; with fewer the default stands in."""
    last = Window.partitionBy(key).orderBy(F.desc("ts"))
    g = returns.withColumn("k", F.row_number().over(last)).where(F.col("k") <= n).groupBy(key).agg(F.stddev_pop("r").alias("sd"), F.count("r").alias("n"))
    vol = F.when((F.col("n") >= n) & (F.col("sd") > 0), F.col("sd") * F.sqrt(F.lit(252.0))).otherwise(default)
    g = g.withColumn("raw", 1 / vol)
    return g.select(key, (F.col("raw") / F.sum("raw").over(Window.partitionBy())).alias("weight"))


def momentum_weights(returns: DataFrame, key: str = "symbol", n: int = 63) -> DataFrame:
    """Weights in proportion to the gain over the last n returns, 0 for losses and for fewer returns, equal if all are 0."""
    last = Window.partitionBy(key).orderBy(F.desc("ts"))
    g = returns.withColumn("k", F.row_number().over(last)).where(F.col("k") <= n).groupBy(key).agg((F.product(1 + F.col("r")) - 1).alias("gain"), F.count("r").alias("n"))
    g = g.withColumn("raw", F.when(F.col("n") >= n, F.greatest("gain", F.lit(0.0))).otherwise(0.0))
    every = Window.partitionBy()
    return g.select(key, F.when(F.sum("raw").over(every) > 0, td(F.col("raw"), F.sum("raw").over(every))).otherwise(1 / F.count("*").over(every)).alias("weight"))


def cost_aware(current: np.ndarray, target: np.ndarray, cov: np.ndarray, value: float, cost: float = 0.001, aversion: float = 10.0, least: float = 0.001) -> np.ndarray:
    """The changes of weight that are worth their cost: cost times value times turnover plus aversion times the squared tracking error is least.

    Weights stay within 0 and 1 and keep their sum, 1. Weight is moved between the best pair of assets, exactly along that
    line, until no pair gains. Changes up to `least` are 0.
    """
    x, c = current / current.sum(), cost * value
    curve = np.maximum(np.diag(cov)[:, None] + np.diag(cov)[None, :] - 2 * cov, 1e-18) * aversion  # of a move from one to another
    n = len(x)
    for _ in range(200 * n):
        slope = 2 * aversion * (cov @ (x - target))
        best, move = 1e-15, None
        up = np.where(x >= current - 1e-15, c, -c)  # what more of an asset costs, and less of it
        down = np.where(x <= current + 1e-15, c, -c)
        rate = slope[:, None] + up[:, None] - slope[None, :] + down[None, :]  # to row, from column
        room = np.minimum.outer(np.where(x < current - 1e-15, current - x, 1 - x), np.where(x > current + 1e-15, x - current, x))
        step = np.clip(-rate / (2 * curve), 0, room)
        gain = -(rate * step + curve * step * step)
        np.fill_diagonal(gain, 0.0)
        i, j = divmod(int(gain.argmax()), n)
        if gain[i, j] > best:
            move = step[i, j]
        if move is None:
            break
        x[i], x[j] = x[i] + move, x[j] - move
    change = x - current
    return np.where(np.abs(change) > least, change, 0.0)


def rebalance(target: DataFrame, current: DataFrame, value: float, least: float = 100.0, drift: float = 0.05, cost_bps: float = 10.0, due: bool = False) -> DataFrame:
    """(symbol, target, current, drift, trade_value, cost) of the trades of at least `least`, if any weight is off by more than drift or the calendar says so."""
    x = target.select("symbol", F.col("weight").alias("t")).join(current.select("symbol", F.col("weight").alias("c")), "symbol", "full_outer")
    x = x.select("symbol", F.coalesce("t", F.lit(0.0)).alias("target"), F.coalesce("c", F.lit(0.0)).alias("current")).withColumn("drift", F.col("target") - F.col("current"))
    x = x.withColumn("_most", F.max(F.abs("drift")).over(Window.partitionBy()))
    x = x.where(((F.col("_most") > drift) | F.lit(due)) & (F.abs(F.col("drift") * value) >= least)).drop("_most")
    return x.withColumn("trade_value", F.col("drift") * value).withColumn("cost", F.abs(F.col("drift") * value) * F.lit(cost_bps / 1e4))


def due(last: Column, today: Column, rule: str) -> Column:
    """Whether a calendar rebalancing is due; always if none has been."""
    days = {"daily": 1, "weekly": 7, "monthly": 30, "quarterly": 90}[rule]
    return F.coalesce(F.datediff(today, last) >= days, F.lit(True))


def combined(positions: DataFrame, weights: DataFrame) -> DataFrame:
    """positions (strategy, symbol, position) summed by symbol, times the strategies' weights (missing: 0)."""
    x = positions.join(weights, "strategy", "left")
    return x.groupBy("symbol").agg(F.sum(F.col("position") * F.coalesce("weight", F.lit(0.0))).alias("position"))
