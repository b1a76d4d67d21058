"""Parameter sweeps, walk-forward evaluation and purged splits, each as one plan."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.config import EngineConfig
from tapeloom.functions.windows import forbid_lookahead, last_rows, ordered, row_index, simple_return, td
from tapeloom.operators import backtest
from tapeloom.operators.signals import Strategy, momentum, prepared


def grid(spark: SparkSession, **values: list) -> DataFrame:
    """(combo_idx, one column per parameter) of the product, the last parameter running fastest."""
    names = list(values)
    rows = [(i, *combo) for i, combo in enumerate(itertools.product(*values.values()))]
    return spark.createDataFrame(rows, f"combo_idx int, {', '.join(f'{n} int' for n in names)}")


def combinations(make: Callable[..., Strategy], values: dict[str, list]) -> list[Strategy]:
    """The strategies of a grid, the last parameter running fastest."""
    return [make(**dict(zip(values, combo, strict=True))) for combo in itertools.product(*values.values())]


def multiplied(bars: DataFrame, strategies: list[Strategy], *keys: str) -> DataFrame:
    """bars (keys, ts, row_idx, ret, close, volume) times the strategies (combo_idx, their order), with each one's signal.

    All rolling statistics share one sort of the bars and are taken before the bars are multiplied; then the rows are dealt
    by all keys, so that a key's combinations are worked on by as many tasks as there are.
    """
    each = [F.struct(F.lit(i).alias("combo_idx"), forbid_lookahead(s.signal(*keys)).cast("double").alias("signal")) for i, s in enumerate(strategies)]
    x = bars.select("*", F.array(*each).alias("_each")).select(*bars.columns, F.explode("_each").alias("_x")).select(*bars.columns, "_x.combo_idx", "_x.signal")
    return x.repartition(*keys, "combo_idx")


def sweep(bars: DataFrame, make: Callable[..., Strategy], values: dict[str, list], *keys: str, **options) -> DataFrame:
    """The summary of every (key, combination) with its parameters; returns are computed once, before the grid is joined."""
    keys = keys or ("symbol",)
    ready = prepared(bars, *keys).select(*keys, "ts", "row_idx", "ret", "close", "volume")
    book = backtest.ledger(multiplied(ready, combinations(make, values), *keys), *keys, "combo_idx", **options)
    return backtest.summary(book, *keys, "combo_idx").join(F.broadcast(grid(bars.sparkSession, **values)), "combo_idx")


def sweep_momentum(bars: DataFrame, lookbacks: list[int], *keys: str, **options) -> DataFrame:
    return sweep(bars, momentum, {"lookback": lookbacks}, *keys, **options)


_SERIES = (
    "total_return double, annual_return double, sharpe_ratio double, sortino_ratio double, max_drawdown double, calmar_ratio double, total_trades long, win_rate double, profit_factor double, avg_trade_return double,"
    " start_date {ts}, end_date {ts}, initial_capital double, final_capital double"
)


def sweep_series(bars: DataFrame, kind: str, values: dict[str, list], *keys: str, config: EngineConfig | None = None, capital: float | None = None, chunk: int = 32) -> DataFrame:
    """sweep() of momentum (lookback) or ma_cross (fast, slow) for very many combinations of not too long series.

    A key's bars travel as one row, 24 bytes each, to every `chunk` combinations, whose signals, costs and figures a task
    computes as matrices. A row must stay below 2 GB, about 80 million bars; sweep() has no such bound.
    """
    keys = keys or ("symbol",)
    config = config or EngineConfig()
    start = float(capital or config.default_capital)
    slip, per_share = config.slippage, config.commission.per_share
    combos = list(itertools.product(*values.values()))
    if kind not in ("momentum", "ma_cross"):
        raise ValueError(f"unknown strategy {kind!r}")
    if kind == "ma_cross" and any(a >= b for a, b in combos):
        raise ValueError("the fast period must be shorter than the slow one")
    names = list(keys)
    stamp = bars.schema["ts"].dataType.simpleString()
    series = bars.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ts", F.col("close").cast("double").alias("close"), F.col("volume").cast("double").alias("volume")))).alias("bars"))
    parts = -(-len(combos) // chunk)
    dealt = series.crossJoin(F.broadcast(bars.sparkSession.range(parts).withColumnRenamed("id", "part"))).repartition(4 * bars.sparkSession.sparkContext.defaultParallelism, *keys, "part")  # combos times keys

    def rolling(x: np.ndarray, n: int) -> np.ndarray:
        """Means of the last n values from the n-th on, of values less the first, so that equal values have equal means."""
        total = np.concatenate([[0.0], np.cumsum(x - x[0])])
        return (total[n:] - total[:-n]) / n

    def signals(close: np.ndarray, ret: np.ndarray, chosen: list[tuple]) -> np.ndarray:
        out, n = np.zeros((len(chosen), len(close))), len(close)
        known: dict[int, np.ndarray] = {}
        for row, combo in zip(out, chosen, strict=True):
            if kind == "momentum":
                if n > combo[0]:
                    total = np.concatenate([[0.0], np.cumsum(ret)])
                    row[combo[0] :] = np.sign(total[combo[0] :] - total[: len(total) - combo[0]])
            elif n >= combo[1]:
                fast, slow = (known.setdefault(k, rolling(close, k)) for k in combo)
                row[combo[1] - 1 :] = np.where(fast[combo[1] - combo[0] :] > slow, 1.0, -1.0)
        return out

    def run(batches):
        with np.errstate(invalid="ignore", divide="ignore"):
            for batch in batches:
                for i in range(batch.num_rows):
                    flat = batch.column("bars")[i].values
                    close, volume = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("close", "volume"))
                    first = batch.column("part")[i].as_py() * chunk
                    chosen = combos[first : first + chunk]
                    ret = np.diff(close) / close[:-1]
                    s = signals(close, ret, chosen)
                    held = s[:, :-1]
                    change = np.abs(np.diff(held, prepend=0.0, axis=1))
                    if slip.model == "volume_dependent":
                        cost = slip.impact_factor * np.sqrt(change / np.maximum(volume[:-1], 1.0))
                    else:
                        cost = change * slip.base_bps / 10000.0
                    net = held * ret - (cost + change * per_share / close[:-1])
                    equity = start * np.cumprod(np.concatenate([np.ones((len(chosen), 1)), 1 + net], axis=1), axis=1)
                    worst = (equity / np.maximum.accumulate(equity, axis=1) - 1).min(axis=1)
                    n = net.shape[1]
                    total = equity[:, -1] / equity[:, 0] - 1
                    annual = np.where(total > -1, np.power(1 + total, 1 / max(n / 252.0, 0.01)), np.nan) - 1
                    if n:
                        mean, sd, won = net.mean(axis=1), net.std(axis=1), (net > 0).mean(axis=1)
                    else:
                        mean = sd = won = np.full(len(chosen), np.nan)
                    lost = net < 0
                    many = lost.sum(axis=1)
                    middle = np.where(lost, net, 0).sum(axis=1) / many
                    down = np.where(many > 0, np.sqrt(np.where(lost, (net - middle[:, None]) ** 2, 0).sum(axis=1) / many), 1e-10)
                    gain, loss = np.where(net > 0, net, 0).sum(axis=1), np.abs(np.where(lost, net, 0).sum(axis=1))
                    root = np.sqrt(252.0)
                    figures = [
                        total, annual, mean / np.maximum(sd, 1e-10) * root, mean / np.maximum(down, 1e-10) * root, worst, annual / np.maximum(np.abs(worst), 1e-10), (change > 0.01).sum(axis=1), won,
                        gain / np.maximum(loss, 1e-10), mean,
                    ]
                    count = len(chosen)
                    ts = flat.field("ts")
                    edge = [pa.concat_arrays([ts.slice(k, 1)] * count) for k in (0, len(ts) - 1)]
                    columns = [pa.concat_arrays([batch.column(c).slice(i, 1)] * count) for c in names]
                    columns += [pa.array(np.arange(first, first + count, dtype=np.int32)), *(pa.array(f, from_pandas=True) for f in figures), *edge, pa.array(np.full(count, start)), pa.array(equity[:, -1])]
                    yield pa.RecordBatch.from_arrays(columns, names=[*names, "combo_idx", *(f.split()[0] for f in _SERIES.split(","))])

    schema = ", ".join([*(f"`{c}` {bars.schema[c].dataType.simpleString()}" for c in names), "combo_idx int", _SERIES.format(ts=stamp)])
    return dealt.mapInArrow(run, schema).join(F.broadcast(grid(bars.sparkSession, **values)), "combo_idx")


def ranked(results: DataFrame, metric: str, *keys: str, ascending: bool = False, keep: Column | None = None) -> DataFrame:
    """Sweep results with their place by metric; ties keep the grid's order; an unknown metric keeps the grid's order throughout."""
    known = metric in results.columns
    by = [] if not known else [F.col(metric).asc_nulls_last() if ascending else F.col(metric).desc_nulls_last()]
    out = results.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*by, "combo_idx")))
    return out if keep is None else out.where(keep)


def window_table(spark: SparkSession, n: int, train: int, test: int, step: int | None = None, anchored: bool = False, gap: int = 0) -> DataFrame:
    """(window_id, train_start, train_end, test_start, test_end), row numbers, ends included; none if n is too small."""
    step = step or test
    count = max(0, (n - train - gap - test) // step + 1) if n >= train + gap + test else 0
    return spark.range(count).select(
        F.col("id").cast("int").alias("window_id"), (F.lit(0) if anchored else F.col("id") * step).cast("int").alias("train_start"), (F.col("id") * step + train - 1).cast("int").alias("train_end"),
        (F.col("id") * step + train + gap).cast("int").alias("test_start"), (F.col("id") * step + train + gap + test - 1).cast("int").alias("test_end"),
    )


def members(bars: DataFrame, train: int, test: int, step: int, *keys: str, anchored: bool = False) -> DataFrame:
    """bars (with row_idx) once for each window and role that holds them, by arithmetic instead of a range join.

    An anchored window trains on all bars from the first on; a bar is then in as many windows as follow it.
    """
    size = F.max("row_idx").over(Window.partitionBy(*keys)) + 1
    x = bars.withColumn("last", F.floor((size - train - test) / step).cast("int")).where("last >= 0")
    lo = F.greatest(F.lit(0), F.ceil((F.col("row_idx") - train - test + 1) / step).cast("int"))
    hi = F.col("last") if anchored else F.least(F.col("last"), F.floor(F.col("row_idx") / step).cast("int"))
    x = x.withColumn("lo", lo).withColumn("hi", hi).where("lo <= hi").withColumn("window_id", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi", "last")
    return x.withColumn("role", F.when(F.col("row_idx") - F.col("window_id") * step < train, "train").otherwise("test"))


def walk_forward(bars: DataFrame, make: Callable[..., Strategy], values: dict[str, list], train: int = 252, test: int = 63, step: int | None = None, metric: str = "sharpe_ratio", min_trades: int = 30, anchored: bool = False, **options) -> DataFrame:
    """Per symbol and window: the best combination on the train slice and its figures on the test slice, which starts afresh.

    Train and test runs of all combinations are one plan; windows whose best train run has fewer than min_trades go.
    """
    step = step or test
    ready = bars.withColumn("row_idx", row_index("symbol")).select("symbol", "ts", "row_idx", "close", "volume")
    keys = ("symbol", "window_id", "role")
    x = members(ready, train, test, step, "symbol", anchored=anchored).repartition(*keys)
    x = x.withColumn("row_idx", row_index(*keys)).withColumn("ret", simple_return(F.col("close"), *keys))
    params = grid(bars.sparkSession, **values)
    book = backtest.ledger(multiplied(x, combinations(make, values), *keys), *keys, "combo_idx", **options)
    s = backtest.summary(book, *keys, "combo_idx")
    best = ranked(s.where("role = 'train'"), metric, "symbol", "window_id").where("place = 1")
    tested = s.where("role = 'test'").select(
        "symbol", "window_id", "combo_idx", F.col("sharpe_ratio").alias("test_sharpe"), F.col("total_return").alias("test_return"), F.col("start_date").alias("test_start"), F.col("end_date").alias("test_end")
    )
    out = best.join(tested, ["symbol", "window_id", "combo_idx"]).join(F.broadcast(params), "combo_idx").where(F.col("total_trades") >= min_trades)
    return out.select(
        "symbol", "window_id", F.col("start_date").alias("train_start"), F.col("end_date").alias("train_end"), "test_start", "test_end", *values, F.col("sharpe_ratio").alias("train_sharpe"),
        F.col("total_return").alias("train_return"), "test_sharpe", "test_return", (F.col("sharpe_ratio") - F.col("test_sharpe")).alias("degradation"),
    )


def walk_forward_momentum(bars: DataFrame, lookbacks: list[int], train: int, test: int, step: int | None = None, metric: str = "sharpe_ratio", min_trades: int = 30, **options) -> DataFrame:
    return walk_forward(bars, momentum, {"lookback": lookbacks}, train, test, step, metric, min_trades, **options)


def walk_forward_summary(found: DataFrame, *keys: str) -> DataFrame:
    g = found.groupBy(*keys).agg(
        F.count("*").alias("n_windows"), F.avg("test_sharpe").alias("mean_test_sharpe"), F.stddev_pop("test_sharpe").alias("std_test_sharpe"), F.avg((F.col("test_sharpe") > 0).cast("double")).alias("consistency"),
        F.avg("train_sharpe").alias("mean_train"),
    )
    return g.select(*keys, "n_windows", "mean_test_sharpe", "std_test_sharpe", "consistency", F.when(F.col("mean_train") == 0, 0.0).otherwise(td(F.col("mean_test_sharpe"), F.col("mean_train"))).alias("efficiency"))


def get_n_splits(k: int) -> int:
    """The splits asked for; purged_kfold gives one less, since nothing lies before the first."""
    return k


def purged_kfold(rows: DataFrame, n: int, k: int = 5, embargo: int = 5, purge: int = 0) -> DataFrame:
    """(fold, row_idx, role): contiguous test folds, the last with the remainder, training on what lies embargo + purge before."""
    if k < 2:
        raise ValueError("at least two splits are needed")
    size = n // k
    own = F.least(F.floor(F.col("row_idx") / F.lit(size)).cast("int"), F.lit(k - 1))
    first = (F.ceil((F.col("row_idx") + 1 + embargo + purge) / F.lit(size))).cast("int")
    x = rows.select("row_idx", own.alias("own"), F.greatest(first, F.lit(1)).alias("from"))
    train = x.where(F.col("from") <= k - 1).select(F.explode(F.sequence("from", F.lit(k - 1))).alias("fold"), "row_idx", F.lit("train").alias("role"))
    usable = train.select("fold").distinct()
    test = x.select(F.col("own").alias("fold"), "row_idx", F.lit("test").alias("role")).join(F.broadcast(usable), "fold", "left_semi")
    return train.unionByName(test)


def combinatorial(spark: SparkSession, n: int, k: int = 5, t: int = 2, embargo: int = 5) -> DataFrame:
    """(split, test_groups, train_groups) of all sets of t test groups; a train group must lie beyond the embargo on one side of them all.

    Sets that leave no train group are skipped.
    """
    size = n // k
    spans = [(g * size, (g + 1) * size - 1 if g < k - 1 else n - 1) for g in range(k)]
    out = []
    for test in itertools.combinations(range(k), t):
        low, high = spans[test[0]][0], spans[test[-1]][1]
        train = [g for g in range(k) if g not in test and (spans[g][1] < low - embargo or spans[g][0] > high + embargo)]
        if train:
            out.append((len(out), ",".join(map(str, test)), ",".join(map(str, train))))
    return spark.createDataFrame(out, "split int, test_groups string, train_groups string")


def sliding_samples(series: DataFrame, length: int, x: str, *keys: str) -> DataFrame:
    """Windows of the last `length` values with the next value as target."""
    w = last_rows(length, *keys)
    return series.select(*keys, "ts", F.collect_list(x).over(w).alias("window"), F.lead(x).over(ordered(*keys)).alias("target")).where((F.size("window") == length) & F.col("target").isNotNull())
