"""Every operator as a named query over the test tables, with the SQL that DuckDB answers alike.

Results that accumulate rounding are cut to six decimals at the very end, by the same expression in both engines.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.functions import costs
from tapeloom.functions import windows as w
from tapeloom.operators import backtest, drawdown, execution, factors, metrics, orders, portfolio, risk, signals, text, trades, universe
from tapeloom.plans import engine, optimize
from tapeloom.session import shared_place
from tapeloom.sources import bars

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def cut(df: DataFrame) -> DataFrame:
    """Doubles to six decimals (kept if infinite or beyond what that can express)."""
    def one(c: str):
        x = F.col(c)
        return F.when(F.abs(x) < 1e9, F.floor(x * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)).otherwise(x).alias(c)

    return df.select(*[one(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def q(x: str, name: str | None = None) -> str:
    return f"CASE WHEN abs({x}) < 1e9 THEN floor(({x}) * 1e6 + 0.5) / 1e6 ELSE {x} END AS {name or x}"


def qs(*names: str) -> str:
    return ", ".join(q(n) for n in names)


# Inputs.

_BARS = """b0 AS (SELECT {sym} AS symbol, CAST(date_trunc('{unit}', l_shipdate) AS DATE) AS ts,
  CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS DOUBLE) / (100 * sum(l_quantity)) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2),
b1 AS (SELECT symbol, ts, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY ts), close) AS open, close, volume FROM b0),
bars AS (SELECT symbol, ts, open, greatest(open, close) * CAST(1.01 AS DOUBLE) AS high, least(open, close) * CAST(0.99 AS DOUBLE) AS low, close, volume FROM b1)"""
WEEKLY = _BARS.format(sym="l_returnflag", unit="week")
PANEL = _BARS.format(sym="concat('S', CAST(l_suppkey % 20 AS VARCHAR))", unit="month")
READY = """r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS row_idx, (close - lag(close) OVER (PARTITION BY symbol ORDER BY ts)) / lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS ret FROM bars)"""
TRADES = """t AS (SELECT o_orderkey AS trade_id, CAST(o_orderdate AS DATE) AS timestamp, o_orderpriority AS symbol, CASE WHEN o_orderkey % 2 = 0 THEN 'buy' ELSE 'sell' END AS side,
  1 + o_custkey % 100 AS quantity, o_totalprice AS price, o_totalprice * ((o_custkey % 11) - 5) / CAST(1000 AS DOUBLE) AS pnl FROM orders)"""
MEMBERS = """m AS (SELECT l_suppkey AS symbol, CAST(min(l_shipdate) AS DATE) AS start_date, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE CAST(max(l_shipdate) AS DATE) END AS end_date FROM lineitem GROUP BY l_suppkey)"""
MOM = "CASE WHEN row_idx < {n} THEN 0.0 ELSE sign(avg(ret) OVER (PARTITION BY {k} ORDER BY ts ROWS BETWEEN {m} PRECEDING AND CURRENT ROW)) END"
MA = """CASE WHEN row_idx < 29 THEN 0.0 WHEN avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)
  > avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) THEN 1.0 ELSE -1.0 END"""


def _ledger(signal: str, k: str = "symbol", src: str = "r") -> str:
    o = f"(PARTITION BY {k} ORDER BY ts)"
    return f"""s AS (SELECT *, {signal} AS signal FROM {src}),
l0 AS (SELECT *, lag(signal) OVER {o} AS held, lag(signal) OVER {o} - coalesce(lag(signal, 2) OVER {o}, 0.0) AS change, lag(close) OVER {o} AS pc, lag(volume) OVER {o} AS pv FROM s),
l1 AS (SELECT *, held * ret AS gross, 0.1 * sqrt(abs(change) / greatest(CAST(pv AS DOUBLE), 1.0)) + abs(change) * CAST(0.005 AS DOUBLE) / pc AS cost FROM l0),
l2 AS (SELECT *, gross - cost AS net FROM l1),
book AS (SELECT *, 100000.0 * product(1.0 + coalesce(net, 0.0)) OVER (PARTITION BY {k} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM l2)"""


def _summary(k: str = "symbol", src: str = "book") -> str:
    return f"""d AS (SELECT *, equity / max(equity) OVER (PARTITION BY {k} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM {src}),
g AS (SELECT {k}, count(net) AS n, arg_min(equity, ts) AS initial_capital, arg_max(equity, ts) AS final_capital, avg(net) AS mean, stddev_pop(net) AS sd,
  coalesce(stddev_pop(CASE WHEN net < 0 THEN net END), 1e-10) AS down, min(dd) AS max_drawdown, count(*) FILTER (abs(change) > 0.01) AS total_trades,
  avg(CASE WHEN net > 0 THEN 1.0 WHEN net IS NOT NULL THEN 0.0 END) AS win_rate, coalesce(sum(CASE WHEN net > 0 THEN net END), 0.0) AS won, coalesce(sum(CASE WHEN net < 0 THEN net END), 0.0) AS lost,
  min(ts) AS start_date, max(ts) AS end_date FROM d GROUP BY {k}),
h AS (SELECT *, final_capital / initial_capital - 1 AS total_return FROM g),
h2 AS (SELECT *, CASE WHEN total_return > -1 THEN pow(1 + total_return, 1 / greatest(n / 252.0, 0.01)) END - 1 AS annual_return FROM h),
summ AS (SELECT {k}, total_return, annual_return, mean / greatest(sd, 1e-10) * sqrt(252.0) AS sharpe_ratio, mean / greatest(down, 1e-10) * sqrt(252.0) AS sortino_ratio, max_drawdown,
  annual_return / greatest(abs(max_drawdown), 1e-10) AS calmar_ratio, total_trades, win_rate, won / greatest(abs(lost), 1e-10) AS profit_factor, mean AS avg_trade_return, start_date, end_date, initial_capital, final_capital FROM h2)"""


_SUMM = qs("total_return", "annual_return", "sharpe_ratio", "sortino_ratio", "max_drawdown", "calmar_ratio", "win_rate", "profit_factor", "avg_trade_return", "initial_capital", "final_capital") + ", total_trades, start_date, end_date"
_WEEKLY_MOM = f"WITH {WEEKLY}, {READY}, {_ledger(MOM.format(n=20, m=19, k='symbol'))}"
_WEEKLY_MA = f"WITH {WEEKLY}, {READY}, {_ledger(MA)}"


def _momentum_book(spark: SparkSession, sf: str) -> DataFrame:
    return backtest.run(bars.weekly(spark, sf), signals.momentum(20))


def _returns(spark: SparkSession, sf: str) -> DataFrame:
    x = bars.weekly(spark, sf).withColumn("r", w.simple_return(F.col("close"), "symbol"))
    return x.select(F.col("symbol").alias("run_id"), "ts", "r").where("r is not null")


def _curve(spark: SparkSession, sf: str) -> DataFrame:
    """Closing prices serve as equity: one, well-behaved and equal in both engines."""
    return bars.weekly(spark, sf).select(F.col("symbol").alias("run_id"), "ts", F.col("close").alias("equity"))


def _panel(spark: SparkSession, sf: str) -> DataFrame:
    return bars.panel(spark, sf)


# Bars.


@query("bars_ohlcv", f"WITH {WEEKLY} SELECT * FROM bars")
def _(spark, sf):
    return bars.weekly(spark, sf)


@query(
    "bars_events_daily",
    """SELECT event_type AS symbol, CAST(date_trunc('day', ts) AS DATE) AS ts, min_by(value, event_id) AS open, max(value) AS high, min(value) AS low, max_by(value, event_id) AS close, count(*) AS volume,
    CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS DOUBLE) / (100 * count(*)) AS vwap FROM events GROUP BY 1, 2""",
)
def _(spark, sf):
    return bars.daily_events(spark, sf)


#: Bars with every kind of fault, by month: missing and negative values, highs too low, repeated keys.
_FAULTY = f"""{WEEKLY}, faulty AS (SELECT symbol, ts, CASE WHEN month(ts) = 2 THEN NULL ELSE open END AS open, CASE WHEN month(ts) IN (3, 4) THEN low * CAST(0.5 AS DOUBLE) ELSE high END AS high, low,
  CASE WHEN month(ts) = 5 THEN -close ELSE close END AS close, CASE WHEN month(ts) = 6 THEN -volume ELSE volume END AS volume FROM bars)"""


def _faulty(spark: SparkSession, sf: str) -> DataFrame:
    month = F.month("ts")
    return bars.weekly(spark, sf).select(
        "symbol", "ts", F.when(month != 2, F.col("open")).alias("open"), F.when(month.isin(3, 4), F.col("low") * 0.5).otherwise(F.col("high")).alias("high"), "low",
        F.when(month == 5, -F.col("close")).otherwise(F.col("close")).alias("close"), F.when(month == 6, -F.col("volume")).otherwise(F.col("volume")).alias("volume"),
    )


@query(
    "bars_validate",
    f"""WITH {_FAULTY}, twice AS (SELECT * FROM faulty UNION ALL SELECT * FROM faulty WHERE month(ts) = 7)
    SELECT symbol, CAST(sum(n) AS BIGINT) AS n_rows, count(*) FILTER (n > 1) AS duplicate_keys, CAST(sum(nu) AS BIGINT) AS nulls, CAST(sum(neg) AS BIGINT) AS negatives, CAST(sum(hl) AS BIGINT) AS high_below_low,
    CAST(sum(ho) AS BIGINT) AS high_below_open, CAST(sum(hc) AS BIGINT) AS high_below_close FROM (SELECT symbol, ts, count(*) AS n,
    count(*) FILTER (open IS NULL) + count(*) FILTER (high IS NULL) + count(*) FILTER (low IS NULL) + count(*) FILTER (close IS NULL) + count(*) FILTER (volume IS NULL) AS nu,
    count(*) FILTER (open < 0 OR high < 0 OR low < 0 OR close < 0 OR volume < 0) AS neg, count(*) FILTER (high < low) AS hl, count(*) FILTER (high < open) AS ho, count(*) FILTER (high < close) AS hc
    FROM twice GROUP BY 1, 2) GROUP BY symbol""",
)
def _(spark, sf):
    b = _faulty(spark, sf)
    return bars.validate(b.unionByName(b.where(F.month("ts") == 7)))


@query(
    "bars_repair",
    f"""WITH {_FAULTY} SELECT symbol, ts, open, greatest(high, open, close) AS high, least(low, open, close) AS low, close, greatest(volume, 0) AS volume,
    coalesce(abs((close - lag(close) OVER (PARTITION BY symbol ORDER BY ts)) / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) > 0.5, false) AS jump FROM faulty""",
)
def _(spark, sf):
    return bars.repair(_faulty(spark, sf))


_DAILY = _BARS.format(sym="concat('S', CAST(l_suppkey AS VARCHAR))", unit="day")


@query(
    "bars_gap_detect",
    f"""WITH {_DAILY}, st AS (SELECT symbol, ts, CAST(date_diff('day', lag(ts) OVER (PARTITION BY symbol ORDER BY ts), ts) AS INTEGER) AS gap FROM bars),
    us AS (SELECT symbol, gap AS usual FROM (SELECT symbol, gap, row_number() OVER (PARTITION BY symbol ORDER BY count(*) DESC, gap) AS k FROM st WHERE gap IS NOT NULL GROUP BY 1, 2) WHERE k = 1)
    SELECT symbol, ts, gap, usual FROM st JOIN us USING (symbol) WHERE gap > 5 * usual""",
)
def _(spark, sf):
    return bars.gaps(bars.by_supplier(spark, sf))


@query(
    "bars_split_detect",
    f"""WITH {PANEL}, x AS (SELECT symbol, ts, lag(close) OVER o / close AS ratio, (volume - lag(volume) OVER o) / lag(volume) OVER o AS surge FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts))
    SELECT symbol, ts, concat(CAST(CAST(round_even(ratio, 0) AS BIGINT) AS VARCHAR), ':1') AS label FROM x WHERE ratio > 1.05 AND surge > 0.2""",
)
def _(spark, sf):
    return bars.splits(_panel(spark, sf), 1.05, 0.2)


@query("bars_upsert", f"WITH {WEEKLY} SELECT symbol, ts, open, high, low, CASE WHEN symbol = 'A' THEN close * 2 ELSE close END AS close, volume FROM bars")
def _(spark, sf):
    b = bars.weekly(spark, sf)
    return bars.upsert(b, b.where("symbol = 'A'").withColumn("close", F.col("close") * 2))


@query("bars_time_filter", f"WITH {WEEKLY} SELECT * FROM bars WHERE ts BETWEEN DATE '1996-03-01' AND DATE '1998-12-31' AND symbol = 'N'")
def _(spark, sf):
    """From a store, of which only the symbol's years are read."""
    path = shared_place(spark, "bars")
    bars.save(bars.weekly(spark, sf), path, "1w")
    return bars.load(spark, path, "1w", "N", "1996-03-01", "1998-12-31")


@query("bars_read_through", f"WITH {WEEKLY} SELECT * FROM bars WHERE ts BETWEEN DATE '1995-06-01' AND DATE '2000-12-31' AND symbol = 'R'")
def _(spark, sf):
    """The store has the first years, the rest is fetched."""
    path, b = shared_place(spark, "bars"), bars.weekly(spark, sf)
    bars.save(b.where(F.col("ts") <= F.lit("1997-06-30").cast("date")), path, "1w")

    def fetch(start, end):
        return b.where((F.col("symbol") == "R") & F.col("ts").between(F.lit(start).cast("date"), F.lit(end).cast("date")))

    return bars.read_through(spark, path, "1w", "R", "1995-06-01", "2000-12-31", fetch)


@query("bars_store_stats", f"WITH {WEEKLY} SELECT count(DISTINCT (symbol, year(ts))) AS n_files FROM bars")
def _(spark, sf):
    path = shared_place(spark, "bars")
    bars.save(bars.weekly(spark, sf), path, "1w")
    return bars.store_stats(spark, path).select("n_files")


@query("bars_incremental", f"WITH {WEEKLY} SELECT * FROM bars WHERE ts > DATE '1996-06-30'")
def _(spark, sf):
    b = bars.weekly(spark, sf)
    return bars.missing_rows(b.where(F.col("ts") <= F.lit("1996-06-30").cast("date")), b)


_PAIRS = ("/USD", "USDT", "BTC", "-BTC-X", "")


@query(
    "connector_routing",
    "WITH s AS (SELECT concat(o_orderstatus, " + "CASE o_orderkey % 5 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_PAIRS)) + " END) AS symbol FROM orders) SELECT symbol, CASE WHEN symbol LIKE '%/%' OR symbol LIKE '%USDT' OR symbol LIKE '%BTC' THEN 'crypto' ELSE 'equity' END AS connector, count(*) AS n FROM s GROUP BY 1, 2",
)
def _(spark, sf):
    end = F.element_at(F.array(*map(F.lit, _PAIRS)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.concat("o_orderstatus", end).alias("symbol"))
    return o.withColumn("connector", bars.route(F.col("symbol"))).groupBy("symbol", "connector").agg(F.count("*").alias("n"))


@query("json_normalise", "SELECT event_type AS symbol, date_trunc('millisecond', ts) AS ts, value AS open, value + 1 AS high, value - 1 AS low, value AS close, CAST(event_id AS DOUBLE) AS volume, CASE WHEN event_id % 2 = 0 THEN value END AS vwap, user_id AS trade_count FROM events")
def _(spark, sf):
    """Vendor messages made of the event table."""
    e, v = spark.read.parquet(f"{sf}/events.parquet"), F.col("value")
    raw = F.to_json(F.struct(
        F.col("event_type").alias("S"), F.date_format(F.date_trunc("millisecond", "ts"), "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("t"), v.alias("o"), (v + 1).alias("h"), (v - 1).alias("l"), v.alias("c"),
        F.col("event_id").cast("double").alias("v"), F.when(F.col("event_id") % 2 == 0, v).alias("vw"), F.col("user_id").alias("n"),
    ))
    return bars.normalise_json(e.select(raw.alias("raw"))).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# Signals.


@query("returns_simple", f"WITH {WEEKLY}, {READY} SELECT symbol, ts, ret FROM r")
def _(spark, sf):
    return signals.prepared(bars.weekly(spark, sf), "symbol").select("symbol", "ts", "ret")


@query("signal_momentum", f"WITH {WEEKLY}, {READY} SELECT symbol, ts, CAST({MOM.format(n=20, m=19, k='symbol')} AS DOUBLE) AS signal FROM r")
def _(spark, sf):
    return signals.with_signal(bars.weekly(spark, sf), signals.momentum(20)).select("symbol", "ts", "signal")


@query("signal_ma_cross", f"WITH {WEEKLY}, {READY} SELECT symbol, ts, CAST({MA} AS DOUBLE) AS signal FROM r")
def _(spark, sf):
    return signals.with_signal(bars.weekly(spark, sf), signals.ma_cross()).select("symbol", "ts", "signal")


@query(
    "rolling_mean_std",
    f"""WITH {WEEKLY}, x AS (SELECT symbol, ts, CASE WHEN count(close) OVER o = 10 THEN avg(close) OVER o END AS mean10, CASE WHEN count(close) OVER o = 10 THEN stddev_samp(close) OVER o END AS std10 FROM bars
    WINDOW o AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) SELECT symbol, ts, {qs('mean10', 'std10')} FROM x""",
)
def _(spark, sf):
    c = F.col("close")
    return cut(bars.weekly(spark, sf).select("symbol", "ts", w.ts_mean(c, 10, "symbol").alias("mean10"), w.ts_std(c, 10, "symbol").alias("std10")))


@query(
    "guarded_prefix_stats",
    f"""WITH {WEEKLY}, x AS (SELECT symbol, ts, count(*) OVER o AS n, avg(close) OVER o AS mean, stddev_samp(close) OVER o AS std, min(close) OVER o AS low, max(close) OVER o AS high FROM bars
    WINDOW o AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT symbol, ts, n, {qs('mean', 'std', 'low', 'high')} FROM x""",
)
def _(spark, sf):
    o, c = w.so_far("symbol"), F.col("close")
    return cut(bars.weekly(spark, sf).select("symbol", "ts", F.count("*").over(o).alias("n"), F.avg(c).over(o).alias("mean"), F.stddev_samp(c).over(o).alias("std"), F.min(c).over(o).alias("low"), F.max(c).over(o).alias("high")))


# Backtests.


@query("vec_backtest_momentum", f"{_WEEKLY_MOM}, {_summary()} SELECT symbol, {_SUMM} FROM summ")
def _(spark, sf):
    return cut(backtest.summary(_momentum_book(spark, sf)))


@query("vec_backtest_ma", f"{_WEEKLY_MA}, {_summary()} SELECT symbol, {_SUMM} FROM summ")
def _(spark, sf):
    return cut(backtest.summary(backtest.run(bars.weekly(spark, sf), signals.ma_cross())))


@query("vec_equity_curve", f"{_WEEKLY_MOM} SELECT symbol, ts, {qs('net', 'equity')} FROM book")
def _(spark, sf):
    return cut(_momentum_book(spark, sf).select("symbol", "ts", "net", "equity"))


@query("vec_trades", f"{_WEEKLY_MOM} SELECT symbol, ts, CAST(change AS DOUBLE) AS change, {q('cost')} FROM book WHERE abs(change) > 0.01")
def _(spark, sf):
    return cut(backtest.trades(_momentum_book(spark, sf)).select("symbol", "ts", "change", "cost"))


@query("cost_vectorized", f"{_WEEKLY_MOM} SELECT symbol, ts, {q('abs(change) * CAST(5.0 AS DOUBLE) / 10000.0', 'fixed')}, {q('0.1 * sqrt(abs(change) / greatest(CAST(pv AS DOUBLE), 1.0))', 'volume')}, {q('abs(change) * CAST(0.005 AS DOUBLE) / pc', 'commission')} FROM book")
def _(spark, sf):
    o = w.ordered("symbol")
    x = _momentum_book(spark, sf).withColumn("pc", F.lag("close").over(o)).withColumn("pv", F.lag("volume").over(o))
    c, v = F.col("change"), F.col("pv")
    return cut(x.select("symbol", "ts", costs.bar_slippage(c, v, "fixed").alias("fixed"), costs.bar_slippage(c, v).alias("volume"), costs.bar_commission(c, F.col("pc")).alias("commission")))


_PART = "p AS (SELECT p_partkey, p_retailprice AS price, CAST(1 + p_partkey % 500 AS DOUBLE) AS quantity, CAST((p_partkey % 7) * 1000 AS DOUBLE) AS volume, CAST(p_partkey % 5 AS DOUBLE) / 100 AS sigma FROM part)"


def _parts(spark, sf):
    k = F.col("p_partkey")
    return spark.read.parquet(f"{sf}/part.parquet").select(
        "p_partkey", F.col("p_retailprice").alias("price"), (1 + k % 500).cast("double").alias("quantity"), ((k % 7) * 1000).cast("double").alias("volume"), ((k % 5).cast("double") / 100).alias("sigma")
    )


@query(
    "cost_slippage_models",
    f"""WITH {_PART} SELECT p_partkey, {q('price * 5.0 / 10000.0', 'fixed')}, {q('price * CAST(0.001 AS DOUBLE)', 'percentage')},
    {q('price * 5.0 / 10000.0 + CASE WHEN volume > 0 THEN price * CAST(0.1 AS DOUBLE) * sqrt(quantity / nullif(volume, 0)) ELSE 0.0 END', 'volume_dependent')},
    {q('CASE WHEN volume <= 0 OR sigma <= 0 THEN price * CAST(0.0005 AS DOUBLE) ELSE price * (CAST(0.01 AS DOUBLE) * sigma * (quantity / nullif(volume, 0)) + CAST(0.1 AS DOUBLE) * sigma * sqrt(quantity / nullif(volume, 0))) END', 'almgren_chriss')},
    {q('price * 2.5 / 10000.0', 'spread')} FROM p""",
)
def _(spark, sf):
    x = _parts(spark, sf)
    names = ("fixed", "percentage", "volume_dependent", "almgren_chriss", "spread")
    return cut(x.select("p_partkey", *[costs.slippage(n, F.col("price"), F.col("quantity"), F.col("volume"), F.col("sigma")).alias(n) for n in names]))


@query(
    "cost_commission_models",
    f"""WITH {_PART}, v AS (SELECT *, quantity * price AS val FROM p) SELECT p_partkey, CAST(0.0 AS DOUBLE) AS zero, CAST(5.0 AS DOUBLE) AS fixed, {q('least(greatest(quantity * CAST(0.005 AS DOUBLE), 1.0), val * CAST(0.01 AS DOUBLE))', 'per_share')},
    {q('greatest(val * CAST(0.001 AS DOUBLE), 0.0)', 'percentage')},
    {q('CASE WHEN quantity <= 0 THEN 0.0 ELSE least(greatest(greatest(CAST(0.0035 AS DOUBLE), least(CAST(0.005 AS DOUBLE), 1.0 / quantity)) * quantity, CAST(0.35 AS DOUBLE)), val * CAST(0.01 AS DOUBLE)) END', 'tiered')},
    {q('val * CAST(0.002 AS DOUBLE)', 'crypto')} FROM v""",
)
def _(spark, sf):
    x = _parts(spark, sf).withColumn("val", costs.trade_value(F.col("quantity"), F.col("price")))
    return cut(x.select("p_partkey", *[costs.commission(n, F.col("quantity"), F.col("val")).alias(n) for n in ("zero", "fixed", "per_share", "percentage", "tiered", "crypto")]))


@query(
    "cost_broker_models",
    f"""WITH {_PART}, v AS (SELECT *, quantity * price AS val, quantity / greatest(volume, 1.0) AS share FROM p) SELECT p_partkey, {q('CAST(0.1 AS DOUBLE) * sqrt(share) + 5.0 / 10000.0', 'slip_volume')},
    {q('CAST(0.01 AS DOUBLE) * CAST(0.02 AS DOUBLE) * share + CAST(0.1 AS DOUBLE) * CAST(0.02 AS DOUBLE) * sqrt(share)', 'slip_ac')}, {q('greatest(1.0, least(quantity * CAST(0.005 AS DOUBLE), val * CAST(0.01 AS DOUBLE)))', 'fee_per_share')},
    {q('greatest(CAST(0.35 AS DOUBLE), least(greatest(CAST(0.0035 AS DOUBLE), least(CAST(0.005 AS DOUBLE), 1.0 / quantity)) * quantity, val * CAST(0.01 AS DOUBLE)))', 'fee_tiered')} FROM v""",
)
def _(spark, sf):
    x = _parts(spark, sf).withColumn("val", F.col("quantity") * F.col("price"))
    n, v = F.col("quantity"), F.col("volume")
    return cut(x.select(
        "p_partkey", costs.broker_slippage(n, v).alias("slip_volume"), costs.broker_slippage(n, v, "almgren_chriss").alias("slip_ac"),
        costs.broker_commission(n, F.col("val"), "per_share").alias("fee_per_share"), costs.broker_commission(n, F.col("val")).alias("fee_tiered"),
    ))


# Metrics.

_RET = f"{WEEKLY}, {READY}, x AS (SELECT symbol AS run_id, ts, ret AS r FROM r WHERE ret IS NOT NULL)"
_METRICS = f"""WITH {_RET}, y AS (SELECT *, product(1 + r) OVER (PARTITION BY run_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grown FROM x),
z AS (SELECT *, grown / max(grown) OVER (PARTITION BY run_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM y),
lv AS (SELECT run_id, quantile_cont(r, 0.05) AS vr, quantile_cont(r, 0.95) AS p95 FROM x GROUP BY 1),
g AS (SELECT run_id, count(r) AS n, product(1 + r) - 1 AS total_return, avg(r) AS mean, stddev_samp(r) AS sd, stddev_samp(r) FILTER (r < 0) AS down, count(*) FILTER (r < 0) AS n_down, min(dd) AS max_drawdown, first(vr) AS vr, first(p95) AS p95,
  avg(r) FILTER (r <= vr) AS cvar, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, coalesce(sum(r) FILTER (r > 0), 0.0) AS won, coalesce(-sum(r) FILTER (r < 0), 0.0) AS lost, skewness(r) AS skewness, kurtosis(r) AS kurtosis,
  min(r) AS worst, max(r) AS best FROM z JOIN lv USING (run_id) GROUP BY run_id),
h AS (SELECT *, CASE WHEN total_return > -1 THEN pow(1 + total_return, 252.0 / n) - 1 END AS annual_return FROM g),
rep AS (SELECT run_id, n, total_return, annual_return, sd * sqrt(252.0) AS volatility, CASE WHEN n_down = 0 THEN 0.0 ELSE down * sqrt(252.0) END AS downside_volatility, CASE WHEN sd = 0 THEN 0.0 ELSE mean / sd END * sqrt(252.0) AS sharpe_ratio,
  CASE WHEN n_down = 0 OR down = 0 THEN 0.0 ELSE mean / down * sqrt(252.0) END AS sortino_ratio, CASE WHEN max_drawdown = 0 THEN 0.0 ELSE annual_return / abs(max_drawdown) END AS calmar_ratio, max_drawdown, vr AS var, cvar, abs(p95 / vr) AS tail_ratio,
  win_rate, won / lost AS profit_factor, won / lost AS omega_ratio, skewness, kurtosis, mean AS daily_mean, best AS best_day, worst AS worst_day FROM h)"""


def _metric_query(name: str, *columns: str) -> None:
    @query(name, f"{_METRICS} SELECT run_id, n, {qs(*columns)} FROM rep")
    def _(spark, sf):
        return cut(metrics.report(_returns(spark, sf)).select("run_id", "n", *columns))


_metric_query("perf_return_metrics", "total_return", "annual_return", "daily_mean", "best_day", "worst_day", "win_rate")
_metric_query("perf_risk_metrics", "volatility", "downside_volatility", "max_drawdown")
_metric_query("perf_ratios", "sharpe_ratio", "sortino_ratio", "calmar_ratio", "profit_factor")
_metric_query("perf_var_cvar", "var", "cvar")
_metric_query("perf_tail_omega", "tail_ratio", "omega_ratio")
_metric_query("perf_moments", "skewness", "kurtosis")


_ENTRIES = ", ".join(metrics.ENTRIES)


@query("perf_report", f"{_METRICS}, rr AS (SELECT run_id, {qs(*[e for e in metrics.ENTRIES if e != 'n'])}, CAST(n AS DOUBLE) AS n FROM rep) UNPIVOT rr ON {_ENTRIES} INTO NAME metric VALUE value")
def _(spark, sf):
    """All sixteen entries."""
    return cut(metrics.long_form(metrics.report(_returns(spark, sf)).select("run_id", *metrics.ENTRIES)))


@query(
    "perf_thresholds",
    f"""WITH {_RET}, e AS (SELECT *, r - CAST(0.02 AS DOUBLE) / 252 AS ex FROM x), g AS (SELECT run_id, avg(ex) AS m, stddev_samp(ex) AS s, stddev_samp(ex) FILTER (ex < 0.01) AS d, stddev_samp(r) FILTER (r < 0.01) AS dn,
    sum(greatest(r - CAST(0.01 AS DOUBLE), 0.0)) AS above, sum(greatest(CAST(0.01 AS DOUBLE) - r, 0.0)) AS below, quantile_cont(r, 0.1) AS vr FROM e GROUP BY 1)
    SELECT run_id, {q('m / s * sqrt(252.0)', 'sharpe_ratio')}, {q('m / d * sqrt(252.0)', 'sortino_ratio')}, {q('dn * sqrt(252.0)', 'downside_volatility')}, {q('above / below', 'omega_ratio')}, {q('vr', 'var')} FROM g""",
)
def _(spark, sf):
    """A risk-free rate, a threshold and a confidence other than the usual."""
    x = metrics.report(_returns(spark, sf), rf=0.02, threshold=0.01, confidence=0.9)
    return cut(x.select("run_id", "sharpe_ratio", "sortino_ratio", "downside_volatility", "omega_ratio", "var"))


@query("perf_monthly", f"WITH {_RET}, g AS (SELECT run_id, CAST(date_trunc('month', ts) AS DATE) AS month, product(1 + r) - 1 AS monthly_return FROM x GROUP BY 1, 2) SELECT run_id, month, {qs('monthly_return')} FROM g")
def _(spark, sf):
    return cut(metrics.monthly_returns(_returns(spark, sf)))


@query(
    "perf_information_ratio",
    f"""WITH {_RET}, a AS (SELECT x.run_id, x.r - b.r AS a FROM x JOIN x b ON x.ts = b.ts AND b.run_id = 'N' WHERE x.run_id <> 'N'), g AS (SELECT run_id, avg(a) AS m, stddev_samp(a) AS s FROM a GROUP BY 1)
    SELECT run_id, {q('CASE WHEN s = 0 THEN 0.0 ELSE m / s END * sqrt(252.0)', 'information_ratio')} FROM g""",
)
def _(spark, sf):
    r = _returns(spark, sf)
    return cut(metrics.information_ratio(r.where("run_id <> 'N'"), r.where("run_id = 'N'")))


# Drawdowns.

_CURVE = f"{WEEKLY}, e AS (SELECT symbol AS run_id, ts, close AS equity FROM bars), d AS (SELECT *, max(equity) OVER o AS running_max, equity / max(equity) OVER o - 1 AS dd FROM e WINDOW o AS (PARTITION BY run_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
_PERIODS = f"""WITH {_CURVE}, sg AS (SELECT *, sum(CASE WHEN dd >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg FROM d),
rec AS (SELECT run_id, seg - 1 AS seg, ts AS recovery_date FROM sg WHERE dd >= 0),
gg AS (SELECT run_id, seg, min(CASE WHEN dd < -0.01 THEN ts END) AS start_date, max(running_max) AS peak, min(equity) AS trough, max(ts) AS last_ts, min(dd) AS deepest FROM sg WHERE dd < 0 GROUP BY 1, 2),
tr AS (SELECT gg.*, (SELECT min(s.ts) FROM sg s WHERE s.run_id = gg.run_id AND s.seg = gg.seg AND s.dd < 0 AND s.equity = gg.trough) AS trough_date FROM gg WHERE deepest < -0.01),
per AS (SELECT tr.run_id, start_date, CASE WHEN recovery_date IS NOT NULL THEN trough_date END AS end_date, trough_date, recovery_date, peak, trough, trough / peak - 1 AS drawdown,
  CAST(date_diff('day', start_date, CASE WHEN recovery_date IS NOT NULL THEN trough_date ELSE last_ts END) AS INTEGER) AS duration_days FROM tr LEFT JOIN rec ON tr.run_id = rec.run_id AND tr.seg = rec.seg)"""
_PER = f"run_id, start_date, end_date, trough_date, recovery_date, duration_days, {qs('peak', 'trough', 'drawdown')}"


@query("drawdown_series", f"WITH {_CURVE} SELECT run_id, ts, equity, running_max, {q('dd')} FROM d")
def _(spark, sf):
    x = drawdown.series(_curve(spark, sf))
    return x.select("run_id", "ts", "equity", "running_max", (F.floor(F.col("dd") * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)).alias("dd"))


@query(
    "drawdown_stats",
    f"""WITH {_CURVE}, g AS (SELECT run_id, min(dd) AS max_drawdown, coalesce(avg(dd) FILTER (dd < 0), 0.0) AS average_drawdown, avg(CASE WHEN dd < 0 THEN 1.0 ELSE 0.0 END) AS time_underwater, arg_max(equity, ts) / arg_min(equity, ts) - 1 AS gain,
    sqrt(avg(dd * dd)) AS ulcer_index, abs(avg(dd)) AS pain_index FROM d GROUP BY 1)
    SELECT run_id, {qs('max_drawdown', 'average_drawdown', 'time_underwater')}, {q('CASE WHEN max_drawdown = 0 THEN 0.0 ELSE gain / abs(max_drawdown) END', 'recovery_factor')}, {qs('ulcer_index', 'pain_index')} FROM g""",
)
def _(spark, sf):
    return cut(drawdown.stats(_curve(spark, sf)))


@query("drawdown_periods", f"{_PERIODS} SELECT {_PER} FROM per")
def _(spark, sf):
    return cut(drawdown.periods(_curve(spark, sf)))


@query("drawdown_deepest_n", f"{_PERIODS}, k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY drawdown, start_date) AS place FROM per) SELECT {_PER}, CAST(place AS INTEGER) AS place FROM k WHERE place <= 5")
def _(spark, sf):
    return cut(drawdown.deepest(drawdown.periods(_curve(spark, sf))))


@query("drawdown_longest", f"{_PERIODS}, k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY duration_days DESC, start_date) AS place FROM per) SELECT {_PER} FROM k WHERE place = 1")
def _(spark, sf):
    return cut(drawdown.longest(drawdown.periods(_curve(spark, sf))))


@query("drawdown_monitor", f"WITH {_CURVE} SELECT run_id, ts, {q('dd')}, CASE WHEN -dd >= 0.15 THEN 'CRITICAL' WHEN -dd >= 0.10 THEN 'WARNING' ELSE 'OK' END AS level FROM d")
def _(spark, sf):
    return cut(drawdown.monitor(_curve(spark, sf)))


@query(
    "drawdown_report",
    f"""{_PERIODS}, g AS (SELECT run_id, min(dd) AS max_drawdown, coalesce(avg(dd) FILTER (dd < 0), 0.0) AS average_drawdown, avg(CASE WHEN dd < 0 THEN 1.0 ELSE 0.0 END) AS time_underwater, arg_max(equity, ts) / arg_min(equity, ts) - 1 AS gain,
    sqrt(avg(dd * dd)) AS ulcer_index, abs(avg(dd)) AS pain_index FROM d GROUP BY 1), n AS (SELECT run_id, count(*) AS n_drawdowns, max(duration_days) AS longest_days FROM per GROUP BY 1)
    SELECT run_id, {qs('max_drawdown', 'average_drawdown', 'time_underwater')}, coalesce(n_drawdowns, 0) AS n_drawdowns, coalesce(longest_days, 0) AS longest_days, {q('CASE WHEN max_drawdown = 0 THEN 0.0 ELSE gain / abs(max_drawdown) END', 'recovery_factor')}, {qs('ulcer_index', 'pain_index')}
    FROM g LEFT JOIN n USING (run_id)""",
)
def _(spark, sf):
    return cut(drawdown.report(_curve(spark, sf)))


def _account(spark: SparkSession, sf: str) -> DataFrame:
    """An account's worth at every event."""
    return spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("run_id"), "ts", (2000 + F.col("value")).alias("equity"))


_ACCOUNT = """a0 AS (SELECT event_type AS run_id, ts, 2000 + value AS equity FROM events),
ck AS (SELECT run_id, ts, 1 - equity / max(equity) OVER (PARTITION BY run_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS drawdown,
  greatest(1 - equity / first(equity) OVER (PARTITION BY run_id, CAST(ts AS DATE) ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS daily_loss FROM a0)"""


@query(
    "circuit_breaker",
    f"""WITH RECURSIVE {_ACCOUNT}, hot AS (SELECT run_id, ts, CASE WHEN daily_loss >= 0.03 * 1.5 THEN 'daily loss' ELSE 'drawdown' END AS reason FROM ck WHERE drawdown >= 0.15 OR daily_loss >= 0.03 * 1.5),
    f AS (SELECT run_id, min(ts) AS ts FROM hot GROUP BY 1 UNION ALL SELECT run_id, nxt FROM (SELECT f.run_id, (SELECT min(h.ts) FROM hot h WHERE h.run_id = f.run_id AND h.ts > f.ts + INTERVAL 60 MINUTE) AS nxt FROM f) WHERE nxt IS NOT NULL),
    t AS (SELECT hot.* FROM hot JOIN f USING (run_id, ts)), s AS (SELECT ck.run_id, ck.ts, t.reason, max(t.ts) OVER (PARTITION BY ck.run_id ORDER BY ck.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS since FROM ck LEFT JOIN t ON t.run_id = ck.run_id AND t.ts = ck.ts)
    SELECT run_id, ts, reason, coalesce(ts - since <= INTERVAL 60 MINUTE, false) AS active FROM s""",
)
def _(spark, sf):
    return drawdown.breaker(drawdown.checks(_account(spark, sf))).select("run_id", "ts", "reason", "active")


# Trades.

_TSTATS = """g AS (SELECT {k}count(*) AS total_trades, count(pnl) AS n, count(*) FILTER (pnl > 0) AS winning_trades, count(*) FILTER (pnl < 0) AS losing_trades, coalesce(avg(pnl) FILTER (pnl > 0), 0.0) AS average_win, coalesce(avg(pnl) FILTER (pnl < 0), 0.0) AS average_loss,
  coalesce(avg(pnl), 0.0) AS average_trade, max(pnl) AS largest_win, min(pnl) AS largest_loss, coalesce(sum(pnl) FILTER (pnl > 0), 0.0) AS won, coalesce(-sum(pnl) FILTER (pnl < 0), 0.0) AS lost, stddev_pop(pnl) AS sd FROM t {g}),
st AS (SELECT *, winning_trades / n AS win_rate, won / lost AS profit_factor, average_win / abs(average_loss) AS payoff_ratio, CASE WHEN n < 30 OR sd = 0 THEN 0.0 ELSE sqrt(CAST(n AS DOUBLE)) * average_trade / sd END AS sqn, 0.0::DOUBLE AS avg_holding_period FROM g)"""


def _cents_down(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[(F.floor(F.col(c) * F.lit(1e3) + F.lit(0.5)) / F.lit(1e3)).alias(c) if c in columns else F.col(c) for c in df.columns])


_T_COLS = ("win_rate", "average_win", "average_loss", "average_trade", "largest_win", "largest_loss", "profit_factor", "expectancy", "payoff_ratio", "sqn")
_T_SQL = ", ".join(f"floor(({c if c != 'expectancy' else 'win_rate * average_win - (1 - win_rate) * abs(average_loss)'}) * 1e3 + 0.5) / 1e3 AS {c}" for c in _T_COLS)


@query("trade_stats", f"WITH {TRADES}, {_TSTATS.format(k='', g='')} SELECT total_trades, winning_trades, losing_trades, {_T_SQL}, avg_holding_period FROM st")
def _(spark, sf):
    return _cents_down(trades.stats(bars.order_trades(spark, sf)), *_T_COLS)


@query("trade_sqn", f"WITH {TRADES}, {_TSTATS.format(k='symbol, ', g='GROUP BY symbol')} SELECT symbol, total_trades, floor(sqn * 1e3 + 0.5) / 1e3 AS sqn FROM st")
def _(spark, sf):
    return _cents_down(trades.stats(bars.order_trades(spark, sf), "symbol").select("symbol", "total_trades", "sqn"), "sqn")


@query(
    "trade_streaks",
    f"""WITH {TRADES}, x AS (SELECT sign(pnl) AS s, row_number() OVER (ORDER BY timestamp, trade_id) - row_number() OVER (PARTITION BY sign(pnl) ORDER BY timestamp, trade_id) AS i FROM t), c AS (SELECT s, i, count(*) AS n FROM x GROUP BY 1, 2)
    SELECT coalesce(max(n) FILTER (s > 0), 0) AS max_consecutive_wins, coalesce(max(n) FILTER (s < 0), 0) AS max_consecutive_losses FROM c""",
)
def _(spark, sf):
    return trades.streaks(bars.order_trades(spark, sf))


@query(
    "trade_summary",
    f"""WITH {TRADES}, {_TSTATS.format(k='', g='')}, x AS (SELECT sign(pnl) AS s, row_number() OVER (ORDER BY timestamp, trade_id) - row_number() OVER (PARTITION BY sign(pnl) ORDER BY timestamp, trade_id) AS i FROM t), c AS (SELECT s, i, count(*) AS n FROM x GROUP BY 1, 2)
    SELECT total_trades, winning_trades, losing_trades, {_T_SQL}, (SELECT coalesce(max(n) FILTER (s > 0), 0) FROM c) AS max_consecutive_wins, (SELECT coalesce(max(n) FILTER (s < 0), 0) FROM c) AS max_consecutive_losses FROM st""",
)
def _(spark, sf):
    """All fifteen entries."""
    return _cents_down(trades.summary(bars.order_trades(spark, sf)), *_T_COLS)


@query("trade_streaks_by_symbol", f"""WITH {TRADES}, x AS (SELECT symbol, sign(pnl) AS s, row_number() OVER (PARTITION BY symbol ORDER BY timestamp, trade_id) - row_number() OVER (PARTITION BY symbol, sign(pnl) ORDER BY timestamp, trade_id) AS i FROM t),
    c AS (SELECT symbol, s, i, count(*) AS n FROM x GROUP BY 1, 2, 3) SELECT symbol, coalesce(max(n) FILTER (s > 0), 0) AS max_consecutive_wins, coalesce(max(n) FILTER (s < 0), 0) AS max_consecutive_losses FROM c GROUP BY 1""")
def _(spark, sf):
    return trades.streaks(bars.order_trades(spark, sf), "symbol")


@query("trade_monthly", f"WITH {TRADES} SELECT CAST(date_trunc('month', timestamp) AS DATE) AS month, count(price) AS n_trades, floor(sum(pnl) * 1e2 + 0.5) / 1e2 AS total_pnl, floor(avg(pnl) * 1e2 + 0.5) / 1e2 AS mean_pnl FROM t GROUP BY 1")
def _(spark, sf):
    x = trades.monthly(bars.order_trades(spark, sf))
    return x.select("month", "n_trades", *[(F.floor(F.col(c) * F.lit(1e2) + F.lit(0.5)) / F.lit(1e2)).alias(c) for c in ("total_pnl", "mean_pnl")])


@query("trade_by_symbol", f"WITH {TRADES} SELECT symbol, count(price) AS n_trades, floor(sum(pnl) * 1e2 + 0.5) / 1e2 AS total_pnl, floor(avg(pnl) * 1e2 + 0.5) / 1e2 AS mean_pnl FROM t GROUP BY 1")
def _(spark, sf):
    x = trades.by_symbol(bars.order_trades(spark, sf))
    return x.select("symbol", "n_trades", *[(F.floor(F.col(c) * F.lit(1e2) + F.lit(0.5)) / F.lit(1e2)).alias(c) for c in ("total_pnl", "mean_pnl")])


@query("trade_rollup", f"WITH {TRADES} SELECT symbol, CAST(date_trunc('month', timestamp) AS DATE) AS month, count(price) AS n_trades, floor(sum(pnl) * 1e2 + 0.5) / 1e2 AS total_pnl FROM t GROUP BY ROLLUP (symbol, month)")
def _(spark, sf):
    x = trades.rollup(bars.order_trades(spark, sf))
    return x.select("symbol", "month", "n_trades", (F.floor(F.col("total_pnl") * F.lit(1e2) + F.lit(0.5)) / F.lit(1e2)).alias("total_pnl"))


# Sweeps and validation.

_GRID = [5, 10, 20, 30, 40]


_MA_GRID = {"fast": [5, 10], "slow": [20, 30, 40]}


def _sweep_sql(tail: str, ma: bool = False) -> str:
    if ma:
        combos = list(itertools.product(*_MA_GRID.values()))
        mean = "avg(close) OVER (PARTITION BY symbol, combo_idx ORDER BY ts ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
        sig = "CASE " + " ".join(f"WHEN combo_idx = {i} THEN CASE WHEN row_idx < {b - 1} THEN 0.0 WHEN {mean.format(a - 1)} > {mean.format(b - 1)} THEN 1.0 ELSE -1.0 END" for i, (a, b) in enumerate(combos)) + " END"
        values, names = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(combos)), "fast, slow"
    else:
        sig = "CASE " + " ".join(f"WHEN lookback = {n} THEN {MOM.format(n=n, m=n - 1, k='symbol, combo_idx')}" for n in _GRID) + " END"
        values, names = ", ".join(f"({i}, {n})" for i, n in enumerate(_GRID)), "lookback"
    return f"WITH {WEEKLY}, {READY}, par(combo_idx, {names}) AS (VALUES {values}), rp AS (SELECT * FROM r CROSS JOIN par), {_ledger(sig, 'symbol, combo_idx', 'rp')}, {_summary('symbol, combo_idx')}, res AS (SELECT * FROM summ JOIN par USING (combo_idx)) {tail}"


@query("grid_search_ma", _sweep_sql(f"SELECT symbol, combo_idx, fast, slow, {_SUMM}, CAST(row_number() OVER (PARTITION BY symbol ORDER BY sharpe_ratio DESC NULLS LAST, combo_idx) AS INTEGER) AS place FROM res", ma=True))
def _(spark, sf):
    """Two parameters, in one plan of windows."""
    return cut(optimize.ranked(optimize.sweep(bars.weekly(spark, sf), signals.ma_cross, _MA_GRID), "sharpe_ratio", "symbol"))


@query("sweep_series_ma", _sweep_sql(f"SELECT symbol, combo_idx, fast, slow, {_SUMM} FROM res", ma=True))
def _(spark, sf):
    """The same as matrices over whole series."""
    return cut(optimize.sweep_series(bars.weekly(spark, sf), "ma_cross", _MA_GRID))


@query("sweep_series_momentum", _sweep_sql(f"SELECT symbol, combo_idx, lookback, {_SUMM} FROM res"))
def _(spark, sf):
    return cut(optimize.sweep_series(bars.weekly(spark, sf), "momentum", {"lookback": _GRID}))


@query("grid_search", _sweep_sql(f"SELECT symbol, combo_idx, lookback, {qs('sharpe_ratio', 'total_return', 'max_drawdown')}, total_trades, CAST(row_number() OVER (PARTITION BY symbol ORDER BY sharpe_ratio DESC NULLS LAST, combo_idx) AS INTEGER) AS place FROM res"))
def _(spark, sf):
    x = optimize.ranked(optimize.sweep_momentum(bars.weekly(spark, sf), _GRID), "sharpe_ratio", "symbol")
    return cut(x.select("symbol", "combo_idx", "lookback", "sharpe_ratio", "total_return", "max_drawdown", "total_trades", "place"))


@query("grid_search_filtered", _sweep_sql(f", k AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY total_return DESC NULLS LAST, combo_idx) AS INTEGER) AS place FROM res) SELECT symbol, combo_idx, lookback, {q('total_return')}, total_trades, place FROM k WHERE total_trades > 40").replace(") ,", "),").replace(" , k AS", ", k AS"))
def _(spark, sf):
    x = optimize.ranked(optimize.sweep_momentum(bars.weekly(spark, sf), _GRID), "total_return", "symbol", keep=F.col("total_trades") > 40)
    return cut(x.select("symbol", "combo_idx", "lookback", "total_return", "total_trades", "place"))


_N = "WITH {w}, one AS (SELECT row_number() OVER (ORDER BY ts) - 1 AS i FROM bars WHERE symbol = 'N')".format(w=WEEKLY)


def _one_series(spark: SparkSession, sf: str) -> DataFrame:
    return bars.weekly(spark, sf).where("symbol = 'N'").select(w.row_index("symbol").cast("long").alias("row_idx"))


_WINDOWS = "k AS (SELECT unnest(range(0, greatest((SELECT count(*) FROM one) - 130 + 30, 0) // 30)) AS k)"


@query("wf_windows_rolling", f"{_N}, {_WINDOWS} SELECT CAST(k AS INTEGER) AS window_id, CAST(k * 30 AS INTEGER) AS train_start, CAST(k * 30 + 99 AS INTEGER) AS train_end, CAST(k * 30 + 100 AS INTEGER) AS test_start, CAST(k * 30 + 129 AS INTEGER) AS test_end FROM k")
def _(spark, sf):
    return optimize.window_table(spark, _one_series(spark, sf).count(), 100, 30)


@query("wf_windows_anchored", f"{_N}, {_WINDOWS} SELECT CAST(k AS INTEGER) AS window_id, 0 AS train_start, CAST(k * 30 + 99 AS INTEGER) AS train_end, CAST(k * 30 + 100 AS INTEGER) AS test_start, CAST(k * 30 + 129 AS INTEGER) AS test_end FROM k")
def _(spark, sf):
    return optimize.window_table(spark, _one_series(spark, sf).count(), 100, 30, anchored=True)


_WF_GRID = [5, 10, 20]


def _wf_sql(tail: str, anchored: bool = False) -> str:
    k = "symbol, window_id, role, combo_idx"
    low = "0" if anchored else "k * 30"
    sig = "CASE " + " ".join(f"WHEN lookback = {n} THEN {MOM.format(n=n, m=n - 1, k=k)}" for n in _WF_GRID) + " END"
    values = ", ".join(f"({i}, {n})" for i, n in enumerate(_WF_GRID))
    return f"""WITH {WEEKLY}, i0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ri, count(*) OVER (PARTITION BY symbol) AS nn FROM bars),
    wn AS (SELECT i0.*, k AS window_id, CASE WHEN ri - k * 30 < 100 THEN 'train' ELSE 'test' END AS role FROM i0, range(0, 200) t(k) WHERE k * 30 + 130 <= nn AND ri BETWEEN {low} AND k * 30 + 129),
    par(combo_idx, lookback) AS (VALUES {values}),
    wr AS (SELECT symbol, ts, close, volume, window_id, role, combo_idx, lookback, row_number() OVER o - 1 AS row_idx, (close - lag(close) OVER o) / lag(close) OVER o AS ret FROM wn CROSS JOIN par WINDOW o AS (PARTITION BY {k} ORDER BY ts)),
    {_ledger(sig, k, 'wr')}, {_summary(k)},
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, window_id ORDER BY sharpe_ratio DESC NULLS LAST, combo_idx) AS place FROM summ WHERE role = 'train') WHERE place = 1 AND total_trades >= 5),
    wf AS (SELECT b.symbol, CAST(b.window_id AS INTEGER) AS window_id, b.start_date AS train_start, b.end_date AS train_end, t.start_date AS test_start, t.end_date AS test_end, lookback, b.sharpe_ratio AS train_sharpe, b.total_return AS train_return,
      t.sharpe_ratio AS test_sharpe, t.total_return AS test_return, b.sharpe_ratio - t.sharpe_ratio AS degradation FROM best b JOIN summ t ON t.role = 'test' AND b.symbol = t.symbol AND b.window_id = t.window_id AND b.combo_idx = t.combo_idx JOIN par ON par.combo_idx = b.combo_idx) {tail}"""


def _walk(spark, sf):
    return optimize.walk_forward_momentum(bars.weekly(spark, sf), _WF_GRID, 100, 30, min_trades=5)


@query("walk_forward", _wf_sql(f"SELECT symbol, window_id, train_start, train_end, test_start, test_end, lookback, {qs('train_sharpe', 'train_return', 'test_sharpe', 'test_return', 'degradation')} FROM wf"))
def _(spark, sf):
    return cut(_walk(spark, sf))


@query("walk_forward_anchored", _wf_sql(f"SELECT symbol, window_id, train_start, train_end, test_start, test_end, lookback, {qs('train_sharpe', 'train_return', 'test_sharpe', 'test_return', 'degradation')} FROM wf", anchored=True))
def _(spark, sf):
    return cut(optimize.walk_forward(bars.weekly(spark, sf), signals.momentum, {"lookback": _WF_GRID}, 100, 30, min_trades=5, anchored=True))


@query(
    "wf_summary",
    _wf_sql(
        f""", ws AS (SELECT symbol, count(*) AS n_windows, avg(test_sharpe) AS mean_test_sharpe, stddev_pop(test_sharpe) AS std_test_sharpe, avg(CASE WHEN test_sharpe > 0 THEN 1.0 ELSE 0.0 END) AS consistency, avg(train_sharpe) AS mt FROM wf GROUP BY 1)
    SELECT symbol, n_windows, {qs('mean_test_sharpe', 'std_test_sharpe', 'consistency')}, {q('CASE WHEN mt = 0 THEN 0.0 ELSE mean_test_sharpe / mt END', 'efficiency')} FROM ws"""
    ),
)
def _(spark, sf):
    return cut(optimize.walk_forward_summary(_walk(spark, sf), "symbol"))


_GROUPS = "g AS (SELECT k, k * (n // 5) AS a, CASE WHEN k = 4 THEN n - 1 ELSE (k + 1) * (n // 5) - 1 END AS b FROM (SELECT count(*) AS n FROM one), range(0, 5) t(k))"


@query(
    "purged_kfold",
    f"""{_N}, {_GROUPS}, tr AS (SELECT k, i FROM one, g WHERE i < a - 5)
    SELECT CAST(k AS INTEGER) AS fold, i AS row_idx, 'train' AS role FROM tr UNION ALL SELECT CAST(k AS INTEGER), i, 'test' FROM one, g WHERE i BETWEEN a AND b AND k IN (SELECT k FROM tr)""",
)
def _(spark, sf):
    rows = _one_series(spark, sf)
    return optimize.purged_kfold(rows, rows.count())


@query(
    "cpcv",
    f"""{_N}, {_GROUPS}, p AS (SELECT x.k AS f1, y.k AS f2, x.a AS lo, y.b AS hi FROM g x JOIN g y ON x.k < y.k),
    tr AS (SELECT f1, f2, string_agg(CAST(g.k AS VARCHAR), ',' ORDER BY g.k) AS train_groups FROM p JOIN g ON g.k <> f1 AND g.k <> f2 AND (g.b < lo - 5 OR g.a > hi + 5) GROUP BY 1, 2)
    SELECT CAST(row_number() OVER (ORDER BY f1, f2) - 1 AS INTEGER) AS split, concat(CAST(f1 AS VARCHAR), ',', CAST(f2 AS VARCHAR)) AS test_groups, train_groups FROM tr""",
)
def _(spark, sf):
    return optimize.combinatorial(spark, _one_series(spark, sf).count())


# Universe.


def _members(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    g = li.groupBy(F.col("l_suppkey").alias("symbol")).agg(F.min("l_shipdate").cast("date").alias("start_date"), F.max("l_shipdate").cast("date").alias("end_date"))
    return g.withColumn("end_date", F.when(F.col("symbol") % 3 != 0, F.col("end_date")))


@query("universe_asof", f"WITH {MEMBERS}, dd AS (SELECT CAST(unnest(generate_series(DATE '1992-01-01', DATE '1999-06-01', INTERVAL 91 DAY)) AS DATE) AS d) SELECT d, symbol FROM dd JOIN m ON start_date <= d AND (end_date IS NULL OR end_date >= d)")
def _(spark, sf):
    days = spark.sql("SELECT explode(sequence(DATE '1992-01-01', DATE '1999-06-01', INTERVAL 91 DAY)) AS d")
    return universe.active(_members(spark, sf), days)


@query("universe_additions", f"WITH {MEMBERS} SELECT * FROM m WHERE start_date BETWEEN DATE '1995-01-01' AND DATE '1995-01-05'")
def _(spark, sf):
    return universe.additions(_members(spark, sf), "1995-01-01", "1995-01-05")


@query("universe_removals", f"WITH {MEMBERS} SELECT * FROM m WHERE end_date BETWEEN DATE '2001-10-25' AND DATE '2001-11-04'")
def _(spark, sf):
    return universe.removals(_members(spark, sf), "2001-10-25", "2001-11-04")


@query("universe_changes", f"WITH {MEMBERS} SELECT symbol, start_date AS d, 'added' AS change FROM m WHERE start_date BETWEEN DATE '1995-01-03' AND DATE '2001-10-31' UNION ALL SELECT symbol, end_date, 'removed' FROM m WHERE end_date BETWEEN DATE '1995-01-03' AND DATE '2001-10-31'")
def _(spark, sf):
    return universe.changes(_members(spark, sf), "1995-01-03", "2001-10-31")


@query("universe_snapshot_asof", f"WITH {WEEKLY} SELECT a.symbol, a.ts, b.close AS snapshot FROM bars a ASOF LEFT JOIN (SELECT symbol, ts, close FROM bars WHERE day(ts) <= 7) b ON a.symbol = b.symbol AND a.ts >= b.ts")
def _(spark, sf):
    b = bars.weekly(spark, sf)
    snaps = b.where(F.dayofmonth("ts") <= 7).select("symbol", "ts", F.col("close").alias("snapshot"))
    return universe.as_of(b.select("symbol", "ts"), snaps, "symbol", "snapshot")


@query("adjustment_factor", f"WITH {WEEKLY}, x AS (SELECT symbol, ts, close, product(CASE WHEN month(ts) = 6 AND day(ts) <= 7 THEN 2.0 ELSE 1.0 END) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS adjustment FROM bars) SELECT symbol, ts, close, adjustment, {q('close * adjustment', 'adjusted_close')} FROM x")
def _(spark, sf):
    b = bars.weekly(spark, sf).select("symbol", "ts", "close")
    f = b.where((F.month("ts") == 6) & (F.dayofmonth("ts") <= 7)).select("symbol", "ts", F.lit(2.0).alias("factor"))
    x = universe.adjusted(b, f)
    return x.select("symbol", "ts", "close", "adjustment", (F.floor(F.col("adjusted_close") * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)).alias("adjusted_close"))


# Event-driven execution.

_EVENT = f"""WITH RECURSIVE {WEEKLY}, e0 AS (SELECT *, row_number() OVER o - 1 AS ri, sign(avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) - avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) AS sg,
  lead(ts) OVER o AS fts, lead(open) OVER o AS fo, lead(volume) OVER o AS fv FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
e1 AS (SELECT *, CASE WHEN ri >= 29 THEN sg END AS c FROM e0),
dec AS (SELECT symbol, fts, fo, fv, close, c, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM e1 WHERE c IN (1, -1) AND fts IS NOT NULL),
fo AS (SELECT symbol, CAST(0 AS BIGINT) AS n, CAST(NULL AS DATE) AS ts, CAST(NULL AS VARCHAR) AS side, CAST(0 AS DOUBLE) AS quantity, CAST(0 AS DOUBLE) AS price, CAST(0 AS DOUBLE) AS commission, CAST(100000 AS DOUBLE) AS cash, CAST(0 AS DOUBLE) AS position FROM (SELECT DISTINCT symbol FROM dec)
UNION ALL SELECT symbol, n, ts, side, quantity, price, fee, CASE WHEN side = 'buy' THEN cash - (quantity * price + fee) WHEN side = 'sell' THEN cash + (quantity * price - fee) ELSE cash END, CASE WHEN side = 'buy' THEN position + quantity WHEN side = 'sell' THEN position - quantity ELSE position END FROM (
  SELECT *, CASE WHEN side IS NULL THEN 0.0 ELSE greatest(CAST(0.35 AS DOUBLE), least(greatest(CAST(0.0035 AS DOUBLE), least(CAST(0.005 AS DOUBLE), 1.0 / quantity)) * quantity, quantity * price * CAST(0.01 AS DOUBLE))) END AS fee FROM (
  SELECT *, CASE WHEN side = 'buy' THEN fo * (1 + slip) ELSE fo * (1 - slip) END AS price FROM (SELECT *, CAST(0.1 AS DOUBLE) * sqrt(quantity / greatest(CAST(fv AS DOUBLE), 1.0)) + 5.0 / 10000.0 AS slip FROM (
  SELECT *, CASE side WHEN 'buy' THEN floor(cash * CAST(0.95 AS DOUBLE) / close) WHEN 'sell' THEN position ELSE 0.0 END AS quantity FROM (
  SELECT d.symbol, d.n, d.fts AS ts, d.fo, d.fv, d.close, f.cash, f.position, CASE WHEN d.c = 1 AND f.position <= 0 AND floor(f.cash * CAST(0.95 AS DOUBLE) / d.close) > 0 THEN 'buy' WHEN d.c = -1 AND f.position > 0 THEN 'sell' END AS side FROM fo f JOIN dec d ON d.symbol = f.symbol AND d.n = f.n + 1)))))),
fills AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY n) AS n, ts, side, quantity, price, commission, cash, position FROM fo WHERE side IS NOT NULL),
curve AS (SELECT b.symbol, b.ts, coalesce(last_value(f.cash IGNORE NULLS) OVER o, 100000.0) + coalesce(last_value(f.position IGNORE NULLS) OVER o, 0.0) * b.close AS equity FROM bars b LEFT JOIN fills f ON f.symbol = b.symbol AND f.ts = b.ts
  WINDOW o AS (PARTITION BY b.symbol ORDER BY b.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def _event(spark, sf):
    b = bars.weekly(spark, sf)
    fills = orders.fold_fills(orders.ma_decisions(b))
    return b, fills, orders.equity(b, fills)


@query("event_fills_ma", f"{_EVENT} SELECT symbol, printf('ORD-%06d', n) AS order_id, ts, side, quantity, {qs('price', 'commission', 'cash')}, position FROM fills")
def _(spark, sf):
    return cut(_event(spark, sf)[1].drop("slippage"))


@query("event_equity_ma", f"{_EVENT} SELECT symbol, ts, {q('equity')} FROM curve")
def _(spark, sf):
    return cut(_event(spark, sf)[2])


_EV_BOOK = """ev AS (SELECT *, equity / coalesce(lag(equity) OVER (PARTITION BY symbol ORDER BY ts), 100000.0) - 1 AS net, equity / greatest(max(equity) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 100000.0) - 1 AS dd FROM curve),
    en AS (SELECT symbol, count(*) AS total_trades FROM fills GROUP BY 1),
    g AS (SELECT symbol, count(net) AS n, 100000.0::DOUBLE AS initial_capital, arg_max(equity, ts) AS final_capital, avg(net) AS mean, stddev_pop(net) AS sd, coalesce(stddev_pop(CASE WHEN net < 0 THEN net END), 1e-10) AS down, min(dd) AS max_drawdown,
      avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) AS win, coalesce(sum(CASE WHEN net > 0 THEN net END), 0.0) AS won, coalesce(sum(CASE WHEN net < 0 THEN net END), 0.0) AS lost, min(ts) AS start_date, max(ts) AS end_date FROM ev GROUP BY 1),
    h AS (SELECT *, final_capital / initial_capital - 1 AS total_return, coalesce(total_trades, 0) AS tt FROM g LEFT JOIN en USING (symbol)),
    h2 AS (SELECT *, CASE WHEN total_return > -1 THEN pow(1 + total_return, 1 / greatest(n / 252.0, 0.01)) END - 1 AS annual_return FROM h),
    summ AS (SELECT symbol, total_return, annual_return, mean / greatest(sd, 1e-10) * sqrt(252.0) AS sharpe_ratio, mean / greatest(down, 1e-10) * sqrt(252.0) AS sortino_ratio, max_drawdown, annual_return / greatest(abs(max_drawdown), 1e-10) AS calmar_ratio,
      tt AS total_trades, CASE WHEN tt > 0 THEN win ELSE 0.0 END AS win_rate, CASE WHEN tt > 0 THEN won / greatest(abs(lost), 1e-10) ELSE 0.0 END AS profit_factor, CASE WHEN tt > 0 THEN mean ELSE 0.0 END AS avg_trade_return, start_date, end_date, initial_capital, final_capital FROM h2)"""


@query("event_metrics_ma", f"{_EVENT}, {_EV_BOOK} SELECT symbol, {_SUMM} FROM summ")
def _(spark, sf):
    _, fills, curve = _event(spark, sf)
    return cut(orders.summary(curve, fills))


@query("engine_run_event", f"{_EVENT}, {_EV_BOOK} SELECT symbol, {_SUMM} FROM summ")
def _(spark, sf):
    return cut(engine.run(bars.weekly(spark, sf), signals.ma_cross(), "event_driven").summary)


@query("engine_run_auto", f"{_WEEKLY_MOM}, {_summary()} SELECT symbol, {_SUMM} FROM summ")
def _(spark, sf):
    """Without a mode the strategy decides."""
    return cut(engine.run(bars.weekly(spark, sf), signals.momentum(20)).summary)


def _event_sql(fast: int, slow: int) -> str:
    return _EVENT.replace("BETWEEN 9 PRECEDING", f"BETWEEN {fast - 1} PRECEDING").replace("BETWEEN 29 PRECEDING", f"BETWEEN {slow - 1} PRECEDING").replace("ri >= 29", f"ri >= {slow - 1}")


@query("event_batch", " UNION ALL ".join(f"SELECT * FROM ({_event_sql(f, 30)}, {_EV_BOOK} SELECT symbol, {i} AS combo_idx, {f} AS fast, 30 AS slow, {_SUMM} FROM summ) x{i}" for i, f in enumerate((5, 10))))
def _(spark, sf):
    return cut(engine.run_batch(bars.weekly(spark, sf), signals.ma_cross, {"fast": [5, 10], "slow": [30]}, "event_driven"))


def _hold_one(bar: dict, position: float, cash: float):
    return ("buy", 10.0) if position == 0 else None


@query(
    "event_on_bar",
    f"""WITH {WEEKLY}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM bars), f AS (SELECT symbol, open * (1 + (CAST(0.1 AS DOUBLE) * sqrt(10 / greatest(CAST(volume AS DOUBLE), 1.0)) + 5.0 / 10000.0)) AS price FROM k WHERE n = 2),
    c AS (SELECT symbol, 100000 - (10 * price + greatest(CAST(0.35 AS DOUBLE), least(10 * CAST(0.005 AS DOUBLE), 10 * price * CAST(0.01 AS DOUBLE)))) AS cash FROM f)
    SELECT symbol, ts, {q('CASE WHEN n = 1 THEN 100000 ELSE cash END', 'cash')}, CAST(CASE WHEN n = 1 THEN 0.0 ELSE 10.0 END AS DOUBLE) AS position, {q('CASE WHEN n = 1 THEN 100000 ELSE cash + 10 * close END', 'equity')} FROM k JOIN c USING (symbol)""",
)
def _(spark, sf):
    """The general fold: a strategy that buys once and holds."""
    return cut(orders.run_on_bar(bars.weekly(spark, sf), _hold_one))


@query(
    "compare_modes",
    f"""{_EVENT}, {READY.replace('r AS', 'rv AS')}, {_ledger(MA, 'symbol', 'rv')}, {_summary()}, ev AS (SELECT *, equity / coalesce(lag(equity) OVER (PARTITION BY symbol ORDER BY ts), 100000.0) - 1 AS r FROM curve),
    eg AS (SELECT symbol, arg_max(equity, ts) / 100000.0 - 1 AS er, avg(r) / greatest(stddev_pop(r), 1e-10) * sqrt(252.0) AS es FROM ev GROUP BY 1)
    SELECT symbol, {q('sharpe_ratio - es', 'sharpe_gap')}, {q('total_return - er', 'return_gap')} FROM summ JOIN eg USING (symbol)""",
)
def _(spark, sf):
    return cut(engine.compare_modes(bars.weekly(spark, sf), signals.ma_cross()))


def _limits_sql(buy: str, sell: str) -> str:
    return f"""lo AS (SELECT concat(symbol, CAST(ts AS VARCHAR)) AS order_id, symbol, ts, CASE WHEN ri % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, close * CASE WHEN ri % 2 = 0 THEN CAST({buy} AS DOUBLE) ELSE CAST({sell} AS DOUBLE) END AS lim FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ri FROM bars))"""


def _limits(b):
    x = b.withColumn("ri", w.row_index("symbol"))
    return x.select(F.concat("symbol", F.col("ts").cast("string")).alias("order_id"), "symbol", "ts", F.when(F.col("ri") % 2 == 0, "buy").otherwise("sell").alias("side"), (F.col("close") * F.when(F.col("ri") % 2 == 0, 0.97).otherwise(1.03)).alias("limit"))


@query(
    "limit_order_fills",
    f"""WITH {WEEKLY}, {_limits_sql('0.97', '1.03')}, c AS (SELECT order_id, lo.symbol, side, lim, b.ts AS fill_ts, CASE WHEN side = 'buy' THEN least(lim, open) ELSE greatest(lim, open) END AS fill_price, row_number() OVER (PARTITION BY order_id ORDER BY b.ts) AS k
    FROM lo JOIN bars b ON b.symbol = lo.symbol AND b.ts > lo.ts AND CASE WHEN side = 'buy' THEN low <= lim ELSE high >= lim END) SELECT order_id, symbol, side, {q('lim', '"limit"')}, fill_ts, {q('fill_price')} FROM c WHERE k = 1""",
)
def _(spark, sf):
    b = bars.weekly(spark, sf)
    return cut(orders.limit_fills(_limits(b), b))


@query(
    "stop_order_fills",
    f"""WITH {WEEKLY}, {_limits_sql('1.03', '0.97')}, c AS (SELECT order_id, lo.symbol, side, lim, b.ts AS fill_ts, CASE WHEN side = 'buy' THEN greatest(lim, open) ELSE least(lim, open) END AS fill_price, row_number() OVER (PARTITION BY order_id ORDER BY b.ts) AS k
    FROM lo JOIN bars b ON b.symbol = lo.symbol AND b.ts > lo.ts AND CASE WHEN side = 'buy' THEN high >= lim ELSE low <= lim END) SELECT order_id, symbol, side, {q('lim', 'stop')}, fill_ts, {q('fill_price')} FROM c WHERE k = 1""",
)
def _(spark, sf):
    b = bars.weekly(spark, sf)
    side = F.when(F.col("side") == "buy", 1.03).otherwise(0.97)
    x = _limits(b).drop("limit").join(b.select("symbol", "ts", "close"), ["symbol", "ts"])
    return cut(orders.stop_fills(x.withColumn("stop", F.col("close") * side), b))


@query(
    "round_trips",
    f"""WITH RECURSIVE {TRADES}, s AS (SELECT symbol, timestamp AS ts, price, CASE WHEN side = 'buy' THEN CAST(quantity AS DOUBLE) ELSE -CAST(quantity AS DOUBLE) END AS q, row_number() OVER (PARTITION BY symbol ORDER BY timestamp, trade_id) AS n FROM t),
    f AS (SELECT symbol, CAST(0 AS BIGINT) AS n, CAST(NULL AS DATE) AS ts, 0.0::DOUBLE AS qty, 0.0::DOUBLE AS av, CAST(NULL AS DOUBLE) AS shut, 0.0::DOUBLE AS entry, 0.0::DOUBLE AS exit_, 0.0::DOUBLE AS pnl FROM (SELECT DISTINCT symbol FROM s)
    UNION ALL SELECT s.symbol, s.n, s.ts, CASE WHEN abs(f.qty + s.q) <= 1e-4 THEN 0.0 ELSE f.qty + s.q END,
      CASE WHEN f.qty = 0 OR sign(f.qty) = sign(s.q) THEN (f.av * abs(f.qty) + s.price * abs(s.q)) / abs(f.qty + s.q) WHEN abs(f.qty + s.q) <= 1e-4 THEN 0.0 WHEN sign(f.qty + s.q) <> sign(f.qty) THEN s.price ELSE f.av END,
      CASE WHEN f.qty = 0 OR sign(f.qty) = sign(s.q) THEN NULL ELSE least(abs(s.q), abs(f.qty)) END, f.av, s.price, (s.price - f.av) * least(abs(s.q), abs(f.qty)) * sign(f.qty) FROM f JOIN s ON s.symbol = f.symbol AND s.n = f.n + 1)
    SELECT symbol, CAST(row_number() OVER (PARTITION BY symbol ORDER BY n) - 1 AS INTEGER) AS n, ts, shut AS quantity, floor(entry * 1e3 + 0.5) / 1e3 AS entry, exit_ AS exit, floor(pnl * 1e2 + 0.5) / 1e2 AS pnl FROM f WHERE shut IS NOT NULL""",
)
def _(spark, sf):
    """Fills of the order table in order of time."""
    t = bars.order_trades(spark, sf).select("symbol", F.col("timestamp").alias("ts"), F.col("trade_id").alias("seq"), "side", "quantity", "price")
    x = orders.round_trips(t).drop("pnl_pct")
    return x.withColumn("entry", F.floor(F.col("entry") * F.lit(1e3) + F.lit(0.5)) / F.lit(1e3)).withColumn("pnl", F.floor(F.col("pnl") * F.lit(1e2) + F.lit(0.5)) / F.lit(1e2))


@query(
    "position_ledger",
    f"""WITH RECURSIVE {TRADES}, s AS (SELECT symbol, timestamp AS ts, trade_id AS seq, side, price, CAST(quantity AS DOUBLE) AS q, row_number() OVER (PARTITION BY symbol ORDER BY timestamp, trade_id) AS n FROM t),
    f AS (SELECT symbol, CAST(0 AS BIGINT) AS n, CAST(NULL AS DATE) AS ts, CAST(NULL AS BIGINT) AS seq, 0.0::DOUBLE AS qty, 0.0::DOUBLE AS av, 0.0::DOUBLE AS gain FROM (SELECT DISTINCT symbol FROM s)
    UNION ALL SELECT s.symbol, s.n, s.ts, s.seq, CASE WHEN side = 'buy' THEN f.qty + s.q ELSE f.qty - s.q END, CASE WHEN side = 'buy' THEN CASE WHEN f.qty > 0 THEN (f.av * f.qty + s.price * s.q) / (f.qty + s.q) ELSE s.price END ELSE f.av END,
      CASE WHEN side <> 'buy' AND f.qty > 0 THEN f.gain + (s.price - f.av) * least(s.q, f.qty) ELSE f.gain END FROM f JOIN s ON s.symbol = f.symbol AND s.n = f.n + 1)
    SELECT symbol, ts, seq, qty AS quantity, floor(av * 1e3 + 0.5) / 1e3 AS avg_price, floor(gain * 10 + 0.5) / 10 AS realised FROM f WHERE n > 0""",
)
def _(spark, sf):
    """The live ledger after each fill."""
    t = bars.order_trades(spark, sf).select("symbol", F.col("timestamp").alias("ts"), F.col("trade_id").alias("seq"), "side", "quantity", "price")
    x = orders.positions(t)
    return x.withColumn("avg_price", F.floor(F.col("avg_price") * F.lit(1e3) + F.lit(0.5)) / F.lit(1e3)).withColumn("realised", F.floor(F.col("realised") * F.lit(10.0) + F.lit(0.5)) / F.lit(10.0))


@query(
    "order_lifecycle",
    """WITH u AS (SELECT l_orderkey AS order_id, CAST(l_shipdate AS DATE) AS seq, sum(l_quantity) AS q, sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS c FROM lineitem GROUP BY 1, 2),
    c AS (SELECT order_id, seq, sum(q) OVER (PARTITION BY order_id ORDER BY seq) AS filled_quantity, CAST(c AS DOUBLE) / (100 * q) AS filled_price FROM u),
    j AS (SELECT o_orderkey AS order_id, 60.0 AS quantity, seq, filled_quantity, filled_price FROM orders LEFT JOIN c ON order_id = o_orderkey),
    k AS (SELECT *, max(CASE WHEN filled_quantity >= quantity THEN 1 ELSE 0 END) OVER (PARTITION BY order_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM j)
    SELECT order_id, seq, filled_quantity, filled_price, CAST(CASE WHEN seq IS NOT NULL THEN 1.0 END AS DOUBLE) AS commission, CAST(quantity - coalesce(filled_quantity, 0) AS DOUBLE) AS remaining, CASE WHEN seq IS NULL THEN 'submitted' WHEN filled_quantity >= quantity THEN 'filled' ELSE 'partial' END AS status FROM k WHERE coalesce(done, 0) = 0""",
)
def _(spark, sf):
    """Orders of 60 units, filled by the lines that are shipped."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("order_id"), F.lit(60.0).alias("quantity"))
    li = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("order_id"), F.col("l_shipdate").cast("date").alias("seq"))
    u = li.agg(F.sum("l_quantity").alias("q"), F.sum(F.floor(F.col("l_extendedprice") * 100 + F.lit(0.5)).cast("long")).alias("c"))
    u = u.select("order_id", "seq", F.sum("q").over(w.so_far("order_id", by="seq")).alias("filled_quantity"), (F.col("c").cast("double") / (100 * F.col("q"))).alias("filled_price"), F.lit(1.0).alias("commission"))
    return orders.lifecycle(o, u)


_STRATEGY = "WITH f AS (SELECT o_orderpriority AS symbol, concat('s', CAST(o_custkey % 3 AS VARCHAR)) AS strategy, CASE WHEN o_orderkey % 2 = 0 THEN 1 + o_custkey % 100 ELSE -(1 + o_custkey % 100) END AS q FROM orders), p AS (SELECT strategy, symbol, sum(q) AS q FROM f GROUP BY 1, 2), m AS (SELECT o_orderpriority AS symbol, max(o_totalprice) AS price FROM orders GROUP BY 1)"


@query("strategy_exposure", f"{_STRATEGY} SELECT strategy, floor(sum(abs(q * price)) * 1e2 + 0.5) / 1e2 AS exposure FROM p JOIN m USING (symbol) GROUP BY 1")
def _(spark, sf):
    t = bars.order_trades(spark, sf).join(spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("trade_id"), F.concat(F.lit("s"), (F.col("o_custkey") % 3).cast("string")).alias("strategy")), "trade_id")
    x = orders.strategy_exposure(t, t.groupBy("symbol").agg(F.max("price").alias("price")))
    return x.select("strategy", (F.floor(F.col("exposure") * F.lit(1e2) + F.lit(0.5)) / F.lit(1e2)).alias("exposure"))


@query("positions_marked", "WITH m AS (SELECT p_partkey AS symbol, CAST(p_partkey % 9 - 4 AS DOUBLE) AS quantity, p_retailprice AS avg_price FROM part) SELECT symbol, quantity, avg_price, avg_price * CAST(1.1 AS DOUBLE) AS price, abs(quantity) * (avg_price * CAST(1.1 AS DOUBLE)) AS market_value, abs(quantity) * avg_price AS cost_basis, (avg_price * CAST(1.1 AS DOUBLE) - avg_price) * quantity AS unrealised FROM m")
def _(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("symbol"), (F.col("p_partkey") % 9 - 4).cast("double").alias("quantity"), F.col("p_retailprice").alias("avg_price"))
    return orders.marked(p, p.select("symbol", (F.col("avg_price") * F.lit(1.1)).alias("price")))


@query("exposure", f"WITH {TRADES} SELECT {q('sum(abs(quantity * price)) / 1e6', 'gross')}, {q('sum(quantity * price) / 1e6', 'net')}, count(*) FILTER (quantity <> 0) AS open_positions FROM t")
def _(spark, sf):
    x = orders.exposure(bars.order_trades(spark, sf))
    return cut(x.select((F.col("gross") / 1e6).alias("gross"), (F.col("net") / 1e6).alias("net"), "open_positions"))


def _more() -> None:
    """Adds the queries of the other modules, which build on this one."""
    import tapeloom.plans.registry_research
    import tapeloom.plans.registry_rest  # noqa: F401


_more()
