"""Queries of the smaller operators; see registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import costs
from tapeloom.functions import windows as w
from tapeloom.operators import backtest, factors, portfolio, universe
from tapeloom.operators.guards import Guard
from tapeloom.plans import montecarlo, optimize
from tapeloom.plans.registry import _PART, _RET, _SUMM, _WEEKLY_MOM, MEMBERS, PANEL, READY, WEEKLY, _members, _momentum_book, _panel, _parts, _returns, _summary, cut, q, qs, query
from tapeloom.plans.registry_research import _pret
from tapeloom.session import shared_place
from tapeloom.sources import bars

_LAST = "ROWS BETWEEN {} PRECEDING AND CURRENT ROW"


@query(
    "rolling_series",
    f"""WITH {WEEKLY}, x AS (SELECT symbol, ts, count(*) OVER o AS n, sum(close) OVER o AS s, max(close) OVER o AS hi, min(close) OVER o AS lo, covar_samp(close, volume) OVER o AS cv, list(close) OVER o AS l FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts {_LAST.format(4)}))
    SELECT symbol, ts, {q('CASE WHEN n = 5 THEN s END', 'total')}, {q('CASE WHEN n = 5 THEN hi END', 'high')}, {q('CASE WHEN n = 5 THEN lo END', 'low')}, {q('CASE WHEN n = 5 THEN cv END', 'cov')}, CAST(CASE WHEN n = 5 THEN list_position(l, hi) - 1 END AS DOUBLE) AS argmax, CAST(CASE WHEN n = 5 THEN list_position(l, lo) - 1 END AS DOUBLE) AS argmin FROM x""",
)
def _(spark, sf):
    c, v, k = F.col("close"), F.col("volume"), "symbol"
    x = bars.weekly(spark, sf).select(
        "symbol", "ts", w.ts_sum(c, 5, k).alias("total"), w.ts_max(c, 5, k).alias("high"), w.ts_min(c, 5, k).alias("low"), w.ts_cov(c, v, 5, k).alias("cov"), w.ts_argmax(c, 5, k).cast("double").alias("argmax"), w.ts_argmin(c, 5, k).cast("double").alias("argmin")
    )
    return cut(x)


@query(
    "rolling_volatility",
    f"WITH {_RET}, v AS (SELECT run_id, ts, CASE WHEN count(r) OVER o = 20 THEN stddev_pop(r) OVER o END AS v FROM x WINDOW o AS (PARTITION BY run_id ORDER BY ts {_LAST.format(19)})) SELECT run_id, ts, {q('v', 'volatility')} FROM v",
)
def _(spark, sf):
    return cut(_returns(spark, sf).select("run_id", "ts", w.rolling(F.stddev_pop("r"), F.col("r"), 20, "run_id").alias("volatility")))


@query("forward_fill", f"WITH {WEEKLY}, x AS (SELECT symbol, ts, CASE WHEN month(ts) % 2 = 0 THEN close END AS c FROM bars) SELECT symbol, ts, last_value(c IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM x")
def _(spark, sf):
    return bars.weekly(spark, sf).select("symbol", "ts", w.forward_fill(F.when(F.month("ts") % 2 == 0, F.col("close")), "symbol").alias("filled"))


@query("guarded_rows", f"WITH {WEEKLY}, x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM bars) SELECT symbol, ts, CAST(i AS INTEGER) AS row_idx, close FROM x WHERE i BETWEEN 91 AND 99")
def _(spark, sf):
    """The last nine of the first hundred rows."""
    return Guard(bars.weekly(spark, sf), 99).rows(-9).select("symbol", "ts", "row_idx", "close")


@query("guarded_stats", f"WITH {WEEKLY}, x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM bars) SELECT symbol, count(*) AS n, {q('avg(close)', 'mean')}, {q('stddev_samp(close)', 'std')}, {q('min(close)', 'low')}, {q('max(close)', 'high')} FROM x WHERE i <= 149 GROUP BY symbol")
def _(spark, sf):
    return cut(Guard(bars.weekly(spark, sf), 99).update_index(149).stats("close"))


@query(
    "cost_more_models",
    f"""WITH {_PART}, v AS (SELECT *, quantity * price AS val FROM p) SELECT p_partkey, CAST(0.0005 AS DOUBLE) AS slip_fixed, {q('CASE WHEN p_partkey % 2 = 0 THEN price + price * CAST(0.001 AS DOUBLE) ELSE price - price * CAST(0.001 AS DOUBLE) END', 'applied')},
    {q('CASE WHEN p_partkey % 2 = 0 THEN price * (1 + CAST(0.0005 AS DOUBLE)) ELSE price * (1 - CAST(0.0005 AS DOUBLE)) END', 'filled')}, CAST(0.0 AS DOUBLE) AS fee_zero, CAST(1.0 AS DOUBLE) AS fee_fixed, {q('val * CAST(0.005 AS DOUBLE)', 'fee_percentage')},
    {q('val * CAST(0.001 AS DOUBLE)', 'fee_maker')}, {q("val * CASE p_partkey % 4 WHEN 0 THEN CAST(0.0002 AS DOUBLE) WHEN 1 THEN CAST(0.002 AS DOUBLE) ELSE CAST(0.001 AS DOUBLE) END", 'fee_tier')} FROM v""",
)
def _(spark, sf):
    x = _parts(spark, sf).withColumn("val", F.col("quantity") * F.col("price"))
    k, n, v, price = F.col("p_partkey"), F.col("quantity"), F.col("val"), F.col("price")
    side = F.when(k % 2 == 0, "buy").otherwise("sell")
    per_share = costs.slippage("percentage", price, n, F.col("volume"), F.col("sigma"))
    tier = F.when(k % 4 == 0, "vip").when(k % 4 == 1, "retail").when(k % 4 == 2, "standard").otherwise("unknown")
    flat = costs.broker_slippage(n, F.col("volume"), "fixed")
    return cut(x.select(
        "p_partkey", flat.alias("slip_fixed"), costs.apply_slippage(side, price, per_share).alias("applied"), costs.fill_price(side, price, flat).alias("filled"), costs.broker_commission(n, v, "zero").alias("fee_zero"),
        costs.broker_commission(n, v, "fixed").alias("fee_fixed"), costs.broker_commission(n, v, "percentage").alias("fee_percentage"), costs.commission("crypto", n, v, is_taker=False).alias("fee_maker"), costs.crypto_fee(tier, v).alias("fee_tier"),
    ))


@query("universe_file", f"WITH {MEMBERS} SELECT CAST(symbol AS VARCHAR) AS symbol, start_date, end_date, CASE WHEN symbol % 2 = 0 THEN 'IPO' ELSE '' END AS reason FROM m UNION ALL SELECT 'ADDED', DATE '1996-01-01', NULL, 'new'")
def _(spark, sf):
    """Exported to a file of comma-separated values, loaded, and one member added."""
    path = shared_place(spark, "universe")
    m = _members(spark, sf).select(F.col("symbol").cast("string").alias("symbol"), "start_date", "end_date", F.when(F.col("symbol") % 2 == 0, "IPO").alias("reason"))
    universe.export(m).write.option("header", True).csv(path)
    return universe.add_member(universe.load_csv(spark, path), "ADDED", "1996-01-01", None, "new")


@query("universe_on_day", f"WITH {MEMBERS} SELECT symbol FROM m WHERE start_date <= DATE '1995-01-08' AND (end_date IS NULL OR end_date >= DATE '1995-01-08')")
def _(spark, sf):
    return universe.on(_members(spark, sf), F.lit("1995-01-08").cast("date"))


@query("universe_compose", "WITH s AS (SELECT c_nationkey, list(DISTINCT c_custkey % 7) AS a, list(DISTINCT c_custkey % 11) AS b, list(DISTINCT c_custkey % 3) AS c FROM customer GROUP BY 1), u AS (SELECT c_nationkey, unnest(list_distinct(list_concat(a, b))) AS x, c FROM s) SELECT c_nationkey, count(*) AS n, CAST(sum(x) AS BIGINT) AS total FROM u WHERE NOT list_contains(c, x) GROUP BY 1")
def _(spark, sf):
    g = spark.read.parquet(f"{sf}/customer.parquet").groupBy("c_nationkey").agg(*[F.collect_set(F.col("c_custkey") % m).alias(n) for m, n in ((7, "a"), (11, "b"), (3, "c"))])
    x = g.select("c_nationkey", F.explode(universe.compose(F.col("a"), F.col("b"), F.col("c"))).alias("x"))
    return x.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("x").alias("total"))


@query("backtest_report", f"{_WEEKLY_MOM}, {_summary()}, t AS (SELECT symbol, printf('%.2f%%', max_drawdown * 100) AS max_drawdown, printf('%.2f%%', win_rate * 100) AS win_rate, printf('%.2f', sharpe_ratio) AS sharpe_ratio, CAST(total_trades AS VARCHAR) AS total_trades FROM summ) UNPIVOT t ON max_drawdown, win_rate, sharpe_ratio, total_trades INTO NAME metric VALUE text")
def _(spark, sf):
    """Figures as they are printed."""
    x = backtest.report(backtest.summary(_momentum_book(spark, sf)))
    return x.where(F.col("metric").isin("max_drawdown", "win_rate", "sharpe_ratio", "total_trades"))


@query("sliding_samples", f"WITH {PANEL}, x AS (SELECT symbol, ts, list(close) OVER (PARTITION BY symbol ORDER BY ts {_LAST.format(9)}) AS l, lead(close) OVER (PARTITION BY symbol ORDER BY ts) AS target FROM bars) SELECT symbol, ts, len(l) AS size, l[1] AS first, l[10] AS last, target FROM x WHERE len(l) = 10 AND target IS NOT NULL")
def _(spark, sf):
    x = optimize.sliding_samples(_panel(spark, sf), 10, "close", "symbol")
    return x.select("symbol", "ts", F.size("window").cast("long").alias("size"), F.element_at("window", 1).alias("first"), F.element_at("window", 10).alias("last"), "target")


@query("feature_importance", f"WITH {PANEL}, {READY}, x AS (SELECT symbol, ts, ret AS r FROM r WHERE ret IS NOT NULL), g AS (SELECT symbol AS feature, sum(abs(r)) AS importance FROM x GROUP BY 1) SELECT feature, {qs('importance')}, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS place FROM g")
def _(spark, sf):
    g = _pret(spark, sf).groupBy(F.col("symbol").alias("feature")).agg(F.sum(F.abs("r")).alias("importance"))
    return cut(factors.ranked_importance(g))


@query("efficient_frontier")
def _(spark, sf):
    """(volatility, return) pairs; the tests hold them against single portfolios."""
    names, cov = portfolio.matrix(portfolio.pairs(_pret(spark, sf)))
    mean = {r["symbol"]: r["m"] for r in _pret(spark, sf).groupBy("symbol").agg(F.avg("r").alias("m")).collect()}  # one number per asset
    x = portfolio.frontier(portfolio.np.array([mean[n] for n in names]), cov, n=10)
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "point int, volatility double, mean_return double")


@query("monte_carlo")
def _(spark, sf):
    """10,000 paths of a year for each symbol; the tests hold them against a plain loop over the same draws."""
    return montecarlo.summary(montecarlo.bootstrap(_returns(spark, sf)))
