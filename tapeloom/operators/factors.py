"""Factor research on panels (symbol, ts, open, high, low, close, volume, vwap): formulas, alphas, ICs, combination."""

from __future__ import annotations

import ast
import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import windows as w
from tapeloom.functions.folds import fold, kind
from tapeloom.functions.windows import td

_K = "symbol"


def ready(panel: DataFrame) -> DataFrame:
    """The panel with vwap (typical price where missing), ret and row_idx."""
    vwap = F.coalesce("vwap", (F.col("high") + F.col("low") + F.col("close")) / 3) if "vwap" in panel.columns else (F.col("high") + F.col("low") + F.col("close")) / 3
    return panel.withColumn("vwap", vwap).withColumn("ret", w.simple_return(F.col("close"), _K)).withColumn("row_idx", w.row_index(_K))


# A formula language: names and functions from a whitelist, parsed and never evaluated as Python.

_SERIES = {
    "ts_sum": w.ts_sum, "ts_mean": w.ts_mean, "ts_std": w.ts_std, "ts_max": w.ts_max, "ts_min": w.ts_min, "ts_argmax": w.ts_argmax, "ts_argmin": w.ts_argmin, "ts_rank": w.ts_rank, "delta": w.delta, "delay": w.delay,
}
_PAIR = {"ts_corr": w.ts_corr, "ts_cov": w.ts_cov}
_SCALAR = {"abs": F.abs, "log": lambda x: F.when(x > 0, F.ln(x)), "sign": F.signum, "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)), "exp": F.exp}
_COLUMNS = ("open", "high", "low", "close", "volume", "vwap", "returns")


class Formula:
    """Compiles a formula step by step: windows may not nest in Spark, so each windowed part becomes a column of its own."""

    def __init__(self, panel: DataFrame):
        self.df, self.n = panel, 0

    def _column(self, c: Column) -> Column:
        name = f"_f{self.n}"
        self.n += 1
        self.df = self.df.withColumn(name, c)
        return F.col(name)

    def build(self, node) -> Column:
        if isinstance(node, ast.Expression):
            return self.build(node.body)
        if isinstance(node, ast.Constant) and isinstance(node.value, int | float):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name) and node.id in _COLUMNS:
            return F.col("ret" if node.id == "returns" else node.id).cast("double")
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -self.build(node.operand)
        if isinstance(node, ast.BinOp):
            a, b = self.build(node.left), self.build(node.right)
            ops = {ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Div: lambda: td(a, b), ast.Pow: lambda: F.pow(a, b)}
            if type(node.op) in ops:
                return ops[type(node.op)]()
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
            name, args = node.func.id, node.args
            if name == "rank" and len(args) == 1:
                return self._column(w.pct_rank(self._column(self.build(args[0])), "ts"))
            if name == "zscore" and len(args) == 1:
                return self._column(w.zscore(self._column(self.build(args[0])), "ts"))
            if name in _SCALAR and len(args) == 1:
                return _SCALAR[name](self.build(args[0]))
            if name in ("min", "max") and len(args) == 2:
                return (F.least if name == "min" else F.greatest)(self.build(args[0]), self.build(args[1]))
            if name == "signedpower" and len(args) == 2:
                x = self.build(args[0])
                return F.signum(x) * F.pow(F.abs(x), self.build(args[1]))
            if name == "where" and len(args) == 3 and isinstance(args[0], ast.Compare) and len(args[0].ops) == 1:
                a, b = self.build(args[0].left), self.build(args[0].comparators[0])
                tests = {ast.Lt: a < b, ast.Gt: a > b, ast.LtE: a <= b, ast.GtE: a >= b}
                return F.when(tests[type(args[0].ops[0])], self.build(args[1])).otherwise(self.build(args[2]))
            if name in _SERIES and len(args) == 2 and isinstance(args[1], ast.Constant):
                return self._column(_SERIES[name](self._column(self.build(args[0])), int(args[1].value), _K))
            if name in _PAIR and len(args) == 3 and isinstance(args[2], ast.Constant):
                a, b = self._column(self.build(args[0])), self._column(self.build(args[1]))
                return self._column(_PAIR[name](a, b, int(args[2].value), _K))
        raise ValueError(f"not a factor formula: {ast.dump(node)[:120]}")


def factor(panel: DataFrame, formula: str, name: str = "value") -> DataFrame:
    """(symbol, ts, name) of a formula over the panel."""
    f = Formula(ready(panel))
    out = f.build(ast.parse(formula, mode="eval"))
    return f.df.select("symbol", "ts", out.alias(name))


#: Published formulas (arXiv 1601.00991), and simple custom ones; the first of these sums the returns of the year before the last month.
ALPHAS = {
    "alpha_001": "rank(ts_argmax(signedpower(where(returns < 0, ts_std(returns, 20), close), 2), 5)) - 0.5",
    "alpha_002": "-1 * ts_corr(rank(delta(log(volume), 2)), rank((close - open) / open), 6)",
    "alpha_003": "-1 * ts_corr(rank(open), rank(volume), 10)",
    "alpha_004": "-1 * ts_rank(rank(low), 9)",
    "alpha_005": "rank(open - ts_mean(vwap, 10)) * (-1 * abs(rank(close - vwap)))",
    "alpha_006": "-1 * ts_corr(open, volume, 10)",
    "alpha_042": "rank(vwap - close) / rank(vwap + close)",
    "alpha_053": "-1 * delta(((close - low) - (high - close)) / (close - low), 9)",
    "alpha_101": "(close - open) / ((high - low) + 0.001)",
}
CUSTOM = {
    "momentum_12m_1m": "ts_sum(delay(returns, 21), 231)",
    "reversal_5d": "-1 * ts_sum(returns, 5)",
    "volume_momentum": "ts_mean(volume, 5) / ts_mean(volume, 20) - 1",
    "price_range": "(ts_max(high, 20) - ts_min(low, 20)) / close",
    "overnight_return": "open / delay(close, 1) - 1",
}


def forward_return(panel: DataFrame, horizon: int = 1) -> DataFrame:
    ahead = F.lead("close", horizon).over(w.ordered(_K))
    return panel.select("symbol", "ts", (td(ahead, F.col("close")) - 1).alias("fwd"))


def ic(values: DataFrame, forward: DataFrame, *keys: str) -> DataFrame:
    """(ts, ic): Spearman correlation per date over the symbols that have both; null below two."""
    x = values.join(forward, ["symbol", "ts", *keys]).where(F.col("value").isNotNull() & F.col("fwd").isNotNull())
    x = x.withColumn("a", w.pct_rank(F.col("value"), "ts", *keys)).withColumn("b", w.pct_rank(F.col("fwd"), "ts", *keys))
    return x.groupBy("ts", *keys).agg(F.corr("a", "b").alias("ic"))


def ic_summary(ics: DataFrame, *keys: str) -> DataFrame:
    g = ics.where(F.col("ic").isNotNull() & ~F.isnan("ic")).groupBy(*keys).agg(F.count("*").alias("n"), F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("std_ic"), F.avg((F.col("ic") > 0).cast("double")).alias("pct_positive"))
    ir = td(F.col("mean_ic"), F.col("std_ic"))
    t = ir * F.sqrt(F.col("n").cast("double"))
    return g.select(*keys, "n", "mean_ic", "std_ic", ir.alias("ir"), "pct_positive", t.alias("t_stat"), (F.abs(t) > 2).alias("significant"))


def decay(panel: DataFrame, values: DataFrame, horizons: tuple[int, ...] = (1, 2, 3, 5, 10, 20, 40, 60)) -> DataFrame:
    """IC mean and ratio at each horizon; the horizons are columns of one pass over the panel."""
    leads = F.array(*[F.struct(F.lit(h).alias("horizon"), (td(F.lead("close", h).over(w.ordered(_K)), F.col("close")) - 1).alias("fwd")) for h in horizons])
    x = panel.select("symbol", "ts", leads.alias("ahead")).select("symbol", "ts", F.explode("ahead").alias("x")).select("symbol", "ts", "x.horizon", "x.fwd")
    y = x.join(values, ["symbol", "ts"]).where(F.col("value").isNotNull() & F.col("fwd").isNotNull())
    y = y.withColumn("a", w.pct_rank(F.col("value"), "ts", "horizon")).withColumn("b", w.pct_rank(F.col("fwd"), "ts", "horizon"))
    return ic_summary(y.groupBy("ts", "horizon").agg(F.corr("a", "b").alias("ic")), "horizon").select("horizon", "mean_ic", "ir")


def student_p(t: float, freedom: int = 250) -> float:
    """Two-sided p-value of Student's law, by the continued fraction of the incomplete beta function."""
    if t is None or math.isnan(t):
        return float("nan")
    x, a, b = freedom / (freedom + t * t), freedom / 2, 0.5
    if x in (0.0, 1.0):
        return x
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = (b, a, 1 - x) if swap else (a, b, x)
    front = math.exp(math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) + p * math.log(y) + q * math.log(1 - y)) / p
    c, d = 1.0, 1 / max(1 - (p + q) * y / (p + 1), 1e-300)
    total = d
    for m in range(1, 300):
        for term in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 / (1 + term * d), 1 + term / c
            total *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    value = front * total
    return 1 - value if swap else value


def student_p_column(t: Column, freedom: int = 250) -> Column:
    """student_p() of a column, for an even number of degrees of freedom: a finite sum of powers of a cosine."""
    if freedom % 2 or freedom < 2:
        raise ValueError("the degrees of freedom must be even")
    angle = F.atan(F.abs(t) / F.lit(math.sqrt(freedom)))
    square = F.cos(angle) * F.cos(angle)
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(max(freedom // 2 - 1, 1))), F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
        lambda acc, i: F.struct((acc["term"] * square * (2 * i - 1) / (2 * i)).alias("term"), (acc["total"] + acc["term"] * square * (2 * i - 1) / (2 * i)).alias("total")), lambda acc: acc["total"],
    )
    return F.greatest(1 - F.sin(angle) * (terms if freedom > 2 else F.lit(1.0)), F.lit(0.0))


def significance(summaries: DataFrame, name: str = "factor", t: str = "t_stat", freedom: int = 250, alpha: float = 0.05) -> DataFrame:
    """multiple_testing() of t statistics (name, t)."""
    return multiple_testing(summaries.select(F.col(name).alias("name"), student_p_column(F.col(t), freedom).alias("p")), alpha)


def multiple_testing(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """tests (name, p) with the decisions of Bonferroni, Holm (step down) and Benjamini-Hochberg (step up)."""
    order, every = Window.orderBy("p", "name"), Window.partitionBy()
    x = tests.withColumn("rank", F.row_number().over(order)).withColumn("m", F.count("*").over(every))
    x = x.withColumn("bonferroni", F.col("p") <= alpha / F.col("m")).withColumn("_holm", F.col("p") <= alpha / (F.col("m") - F.col("rank") + 1))
    x = x.withColumn("holm", F.min("_holm").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    reach = F.max(F.when(F.col("p") <= alpha * F.col("rank") / F.col("m"), F.col("rank"))).over(every)
    return x.withColumn("bh", F.coalesce(F.col("rank") <= reach, F.lit(False))).select("name", "p", "rank", "bonferroni", "holm", "bh")


def equal_weight(panel: DataFrame, *columns: str) -> DataFrame:
    """Mean of the cross-sectional z-scores there are."""
    x = panel
    for c in columns:
        x = x.withColumn(f"_z_{c}", w.zscore(F.col(c), "ts"))
    parts = [F.col(f"_z_{c}") for c in columns]
    total, n = F.lit(0.0), F.lit(0)
    for p in parts:
        total, n = total + F.coalesce(p, F.lit(0.0)), n + p.isNotNull().cast("int")
    return x.select("symbol", "ts", F.when(n > 0, total / n).alias("combined"))


def _scores(panel: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(symbol, ts, factor, value, z) of several factors."""
    long = panel.select("symbol", "ts", F.explode(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select("symbol", "ts", "x.factor", "x.value")
    return long.withColumn("z", w.zscore(F.col("value"), "ts", "factor"))


def ic_weighted(panel: DataFrame, forward: DataFrame, columns: tuple[str, ...], lookback: int = 60, horizon: int = 1) -> DataFrame:
    """Z-scores weighted by each factor's mean IC over the `lookback` dates before (negative ones 0, all 0: equal), and equally until there are as many.

    For a horizon above one the dates end so much earlier that their forward returns are known.
    """
    long = _scores(panel, columns)
    y = long.join(forward, ["symbol", "ts"]).where(F.col("value").isNotNull() & F.col("fwd").isNotNull())
    y = y.withColumn("a", w.pct_rank(F.col("value"), "ts", "factor")).withColumn("b", w.pct_rank(F.col("fwd"), "ts", "factor"))
    ics = long.select("ts", "factor").distinct().join(y.groupBy("ts", "factor").agg(F.corr("a", "b").alias("ic")), ["ts", "factor"], "left")
    dates = Window.partitionBy("factor").orderBy("ts")
    past = dates.rowsBetween(-lookback - horizon + 1, -horizon)
    known = F.when(~F.isnan("ic"), F.col("ic"))
    weight = ics.withColumn("raw", F.greatest(F.coalesce(F.avg(known).over(past), F.lit(0.0)), F.lit(0.0))).withColumn("full", F.row_number().over(dates) > lookback)
    total = F.sum("raw").over(Window.partitionBy("ts"))
    weight = weight.select("ts", "factor", F.when(F.col("full") & (total > 0), td(F.col("raw"), total)).otherwise(1.0 / len(columns)).alias("weight"))
    return long.join(weight, ["ts", "factor"]).groupBy("symbol", "ts").agg(F.coalesce(F.sum(F.col("z") * F.col("weight")), F.lit(0.0)).alias("combined"))


def ridge_weights(panel: DataFrame, forward: DataFrame, columns: tuple[str, ...], alpha: float = 0.01, train_end: str | None = None) -> list[float]:
    """Weights of the factors' z-scores that explain forward returns, with an intercept and a penalty on squared weights.

    The sums of products of a few columns are added up where the rows are; only they come to the driver.
    """
    x = panel.select("symbol", "ts", *[w.zscore(F.col(c).cast("double"), "ts").alias(c) for c in columns]).join(forward, ["symbol", "ts"])
    if train_end is not None:
        x = x.where(F.col("ts") <= F.lit(train_end).cast("date"))
    x = x.dropna(subset=[*columns, "fwd"])
    every = [F.col(c) for c in (*columns, "fwd")]
    k = len(columns)
    sums = x.agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(every)], *[F.sum(every[i] * every[j]).alias(f"p{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]).first()
    n = sums["n"]
    if not n:
        return [0.0] * k
    mean = [sums[f"s{i}"] / n for i in range(k + 1)]
    cross = np.array([[sums[f"p{min(i, j)}_{max(i, j)}"] - n * mean[i] * mean[j] for j in range(k + 1)] for i in range(k + 1)])
    return np.linalg.solve(cross[:k, :k] + alpha * np.eye(k), cross[:k, k]).tolist()


def ridge(panel: DataFrame, forward: DataFrame, columns: tuple[str, ...], alpha: float = 0.01, train_end: str | None = None) -> DataFrame:
    """(symbol, ts, combined): the z-scores of all rows by ridge_weights(); missing ones count 0."""
    weights = ridge_weights(panel, forward, columns, alpha, train_end)
    x = panel.select("symbol", "ts", *[w.zscore(F.col(c).cast("double"), "ts").alias(c) for c in columns])
    return x.select("symbol", "ts", sum((F.coalesce(F.col(c), F.lit(0.0)) * F.lit(v) for c, v in zip(columns, weights, strict=True)), F.lit(0.0)).alias("combined"))


def ensemble(predictions: DataFrame, columns: tuple[str, ...], method: str = "average", weights: dict[str, float] | None = None) -> DataFrame:
    """(symbol, ts, combined) of several models' predictions: their mean, a weighted sum, or the mean of their ranks among all rows (vote)."""
    if method == "average":
        out = sum((F.col(c) for c in columns[1:]), F.col(columns[0])) / len(columns)
    elif method == "weighted":
        out = sum((F.col(c) * F.lit(float(weights[c])) for c in columns), F.lit(0.0))
    elif method == "vote":
        long = predictions.select("symbol", "ts", F.explode(F.array(*[F.struct(F.lit(c).alias("model"), F.col(c).alias("v")) for c in columns])).alias("x")).select("symbol", "ts", "x.model", "x.v")
        return mean_ranks(long)
    else:
        raise ValueError(f"unknown method {method!r}")
    return predictions.select("symbol", "ts", out.alias("combined"))


def mean_ranks(long: DataFrame) -> DataFrame:
    """(symbol, ts, combined): the mean over models of the rank (ties: their mean) of v among the model's values.

    Values are counted per model first and ranks are sums of counts, so that rows aren't sorted in one task.
    """
    counts = long.where("v is not null").groupBy("model", "v").agg(F.count("*").alias("n"))
    below = F.sum("n").over(Window.partitionBy("model").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranks = counts.withColumn("rank", below - (F.col("n") - 1) / 2).select("model", "v", "rank")
    return long.join(ranks, ["model", "v"]).groupBy("symbol", "ts").agg(F.avg("rank").alias("combined"))


def ensemble_weights(long: DataFrame, forward: DataFrame) -> DataFrame:
    """(model, weight): each model's mean IC, at least 0, as a share; long: (symbol, ts, model, v)."""
    y = long.withColumnRenamed("v", "value").join(forward, ["symbol", "ts"]).where(F.col("value").isNotNull() & F.col("fwd").isNotNull())
    y = y.withColumn("a", w.pct_rank(F.col("value"), "ts", "model")).withColumn("b", w.pct_rank(F.col("fwd"), "ts", "model")).groupBy("ts", "model").agg(F.corr("a", "b").alias("ic"))
    g = y.where(F.col("ic").isNotNull() & ~F.isnan("ic")).groupBy("model").agg(F.greatest(F.avg("ic"), F.lit(0.0)).alias("raw"))
    return g.select("model", td(F.col("raw"), F.sum("raw").over(Window.partitionBy())).alias("weight"))


def dated_folds(ics: DataFrame, n_splits: int = 5, embargo: int = 5) -> DataFrame:
    """(fold, train_days, test_days, test_ic, test_ir) of ICs by date (ts, ic), null where there's none: folds of consecutive dates, training on all other dates but `embargo` on either side."""
    x, n = _placed(ics)
    size = F.floor(n / n_splits)
    x = x.withColumn("fold", F.least(F.floor(td(F.col("at"), size)), F.lit(n_splits - 1)).cast("int")).withColumn("n", n)
    g = x.groupBy("fold").agg(F.first("n").alias("n"), F.count("*").alias("test_days"), F.min("at").alias("low"), F.max("at").alias("high"), F.avg("ic").alias("test_ic"), F.stddev_samp("ic").alias("sd"))
    off = F.least(F.col("low"), F.lit(embargo)) + F.least(F.col("n") - 1 - F.col("high"), F.lit(embargo))
    return g.select("fold", (F.col("n") - F.col("test_days") - off).alias("train_days"), "test_days", "test_ic", F.when(F.col("sd") > 0, td(F.col("test_ic"), F.col("sd"))).otherwise(0.0).alias("test_ir"))


def _placed(ics: DataFrame) -> tuple[DataFrame, Column]:
    """ICs with their place among the dates, and the number of dates; there's one row per date."""
    x = ics.select("ts", F.when(~F.isnan("ic"), F.col("ic")).alias("ic")).withColumn("at", F.row_number().over(Window.orderBy("ts")) - 1)
    return x, F.count("*").over(Window.partitionBy())


def combinatorial_dated(ics: DataFrame, n_splits: int = 5, n_test: int = 2, embargo_days: int = 5) -> DataFrame:
    """(test_folds, train_days, test_ic, test_ir) of every set of n_test folds of dates; training dates lie embargo_days or more from all test folds."""
    x, n = _placed(ics)
    x = x.withColumn("fold", F.least(F.floor(td(F.col("at"), F.floor(n / n_splits))), F.lit(n_splits - 1)).cast("int"))
    spans = x.groupBy("fold").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    sets = [(",".join(map(str, c)), list(c)) for c in itertools.combinations(range(n_splits), n_test)]
    combos = ics.sparkSession.createDataFrame(sets, "test_folds string, folds array<int>")
    each = combos.select("test_folds", F.explode("folds").alias("fold"))
    tested = x.join(F.broadcast(each), "fold").groupBy("test_folds").agg(F.avg("ic").alias("test_ic"), F.stddev_samp("ic").alias("sd"))
    held = each.join(spans, "fold").groupBy("test_folds").agg(F.collect_list(F.struct("a", "b")).alias("spans"))  # a few rows
    near = F.exists("spans", lambda s: (F.col("ts") >= F.date_sub(s["a"], embargo_days)) & (F.col("ts") <= F.date_add(s["b"], embargo_days)))
    trained = x.crossJoin(F.broadcast(held)).groupBy("test_folds").agg(F.count_if(~near).alias("train_days"))  # dates times sets of folds
    return tested.join(trained, "test_folds").select("test_folds", "train_days", "test_ic", F.when(F.col("sd") > 0, td(F.col("test_ic"), F.col("sd"))).otherwise(0.0).alias("test_ir"))


def combinatorial_summary(paths: DataFrame) -> DataFrame:
    ic_ = F.col("test_ic")
    return paths.agg(F.avg(ic_).alias("mean_ic"), F.stddev_pop(ic_).alias("std_ic"), F.min(ic_).alias("min_ic"), F.max(ic_).alias("max_ic"), F.count("*").alias("num_paths"), F.avg((ic_ > 0).cast("double")).alias("pct_positive"))


def walk_forward_train(panel: DataFrame, forward: DataFrame, column: str, train: int = 252, test: int = 21, step: int = 21, gap: int = 5) -> DataFrame:
    """(window_id, slope, n_train, n_test, train_start, train_end, test_start, test_end, ic): a least-squares line from one z-scored factor to forward returns, trained and tested by dates with a gap between.

    Windows are whole; each one's sums are added up where the rows are. ic: the mean over test dates of the correlation by
    rank of prediction and return.
    """
    dates = panel.select("ts").distinct()
    n = dates.count()
    last = max(-1, n - gap - test - train)  # the last row at which a window may start
    starts = [s for s in range(0, max(last + 1, 0), step) if s + train - 1 + gap + test < n and (s == 0 or s + train - 1 < n - gap - test)]
    at = dates.withColumn("at", F.row_number().over(Window.orderBy("ts")) - 1)
    x = panel.select("symbol", "ts", w.zscore(F.col(column).cast("double"), "ts").alias("x")).join(forward, ["symbol", "ts"]).join(F.broadcast(at), "ts").dropna(subset=["x", "fwd"])
    lo = F.greatest(F.lit(0), F.ceil((F.col("at") - train - gap - test + 1) / step).cast("int"))
    hi = F.least(F.lit(len(starts) - 1), F.floor(F.col("at") / step).cast("int"))
    x = x.withColumn("lo", lo).withColumn("hi", hi).where("lo <= hi").withColumn("window_id", F.explode(F.sequence("lo", "hi"))).withColumn("off", F.col("at") - F.col("window_id") * step)
    fit = x.where(F.col("off") < train).groupBy("window_id").agg(td(F.covar_pop("x", "fwd"), F.var_pop("x")).alias("slope"), F.count("*").alias("n_train"), F.min("ts").alias("train_start"), F.max("ts").alias("train_end"))
    y = x.where(F.col("off") >= train + gap).join(F.broadcast(fit.select("window_id", "slope")), "window_id")
    y = y.withColumn("a", w.pct_rank(F.col("x") * F.col("slope"), "ts", "window_id")).withColumn("b", w.pct_rank(F.col("fwd"), "ts", "window_id"))
    daily = y.groupBy("window_id", "ts").agg(F.corr("a", "b").alias("ic"), F.count("*").alias("n"))
    tested = daily.groupBy("window_id").agg(F.avg(F.when(~F.isnan("ic"), F.col("ic"))).alias("ic"), F.sum("n").alias("n_test"), F.min("ts").alias("test_start"), F.max("ts").alias("test_end"))
    return fit.join(tested, "window_id").select("window_id", "slope", "n_train", "n_test", "train_start", "train_end", "test_start", "test_end", "ic")


def rsi(panel: DataFrame, n: int = 14) -> DataFrame:
    d = w.delta(F.col("close"), 1, _K)
    x = panel.withColumn("d", d).withColumn("up", F.when(F.col("d").isNotNull(), F.greatest("d", F.lit(0.0)))).withColumn("down", F.when(F.col("d").isNotNull(), F.greatest(-F.col("d"), F.lit(0.0))))
    g, l = w.ts_mean(F.col("up"), n, _K), w.ts_mean(F.col("down"), n, _K)
    return x.select("symbol", "ts", (100 - 100 / (1 + g / (l + F.lit(1e-8)))).alias("rsi"))


def bollinger(panel: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    """Place of the close within its bands, 0 to 1."""
    m, s = w.ts_mean(F.col("close"), n, _K), w.ts_std(F.col("close"), n, _K)
    return panel.select("symbol", "ts", td(F.col("close") - (m - width * s), 2 * width * s).alias("position"))


def atr(panel: DataFrame, n: int = 14) -> DataFrame:
    before = F.lag("close").over(w.ordered(_K))
    x = panel.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    return x.select("symbol", "ts", w.ts_mean(F.col("tr"), n, _K).alias("atr"))


def macd(panel: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Difference of exponential means from a symbol's first bar on, and its signal line: a fold carries the three means."""
    a, b, c = (2.0 / (n + 1) for n in (fast, slow, signal))

    def step(state, row):
        x = row["close"]
        if x is None:
            return state, [(row["symbol"], row["ts"], None, None)]
        if state is None:
            state = (x, x, 0.0)
        else:
            f, s = state[0] * (1 - a) + x * a, state[1] * (1 - b) + x * b
            state = (f, s, state[2] * (1 - c) + (f - s) * c)
        return state, [(row["symbol"], row["ts"], state[0] - state[1], state[2])]

    return fold(panel.select("symbol", "ts", "close"), (_K,), ("ts",), lambda: None, step, f"symbol {kind(panel, 'symbol')}, ts {kind(panel, 'ts')}, macd double, signal double")


def volume_ratio(panel: DataFrame, n: int = 20) -> DataFrame:
    """Volume over its mean of the last n bars."""
    v = F.col("volume").cast("double")
    return panel.select("symbol", "ts", td(v, w.ts_mean(v, n, _K)).alias("volume_ratio"))


def features(panel: DataFrame, formulas: dict[str, str], indicators: tuple[str, ...] = (), periods: tuple[int, ...] = (), normalise: bool = True) -> DataFrame:
    """(symbol, ts, one column per formula, and per indicator and period as rsi_14): missing values take the symbol's last ones, then each date is z-scored.

    Indicators: rsi, macd, bb_position, atr, volume_ratio. Joins are on the panel's key; a deviation gets 1e-8 more.
    """
    known = {
        "rsi": lambda n: rsi(panel, n), "macd": lambda n: macd(panel, n, 2 * n).select("symbol", "ts", "macd"), "bb_position": lambda n: bollinger(panel, n), "atr": lambda n: atr(panel, n), "volume_ratio": lambda n: volume_ratio(panel, n),
    }
    out, names = panel.select("symbol", "ts"), []
    parts = [(name, factor(panel, f, name)) for name, f in formulas.items()]
    parts += [(f"{i}_{n}", (lambda d, c: d.select("symbol", "ts", F.col(d.columns[2]).alias(c)))(known[i](n), f"{i}_{n}")) for i in indicators for n in periods]
    for name, part in parts:
        out, names = out.join(part, ["symbol", "ts"]), [*names, name]
    out = out.select("symbol", "ts", *[w.forward_fill(F.col(c), _K).alias(c) for c in names])
    if not normalise:
        return out
    day = Window.partitionBy("ts")
    return out.select("symbol", "ts", *[((F.col(c) - F.avg(c).over(day)) / (F.stddev_samp(c).over(day) + F.lit(1e-8))).alias(c) for c in names])


def ranked_importance(found: DataFrame) -> DataFrame:
    """(feature, importance) with its place, the most important first; there's a row per feature."""
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))


def save(values: DataFrame, path: str) -> None:
    """Factor values as Parquet, a folder a year."""
    values.withColumn("year", F.year("ts")).repartition("year").sortWithinPartitions("ts").write.mode("overwrite").partitionBy("year").option("compression", "zstd").parquet(path)


def blend(panel: DataFrame, weights: dict[str, float]) -> DataFrame:
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) * F.lit(float(v)) for c, v in weights.items()), F.lit(0.0))
    return panel.select("symbol", "ts", total.alias("signal"))
