"""Rules of the engine on small frames, against plain loops."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.config import EngineConfig, SlippageConfig, config_warnings
from tapeloom.functions import windows as w
from tapeloom.operators import backtest, drawdown, factors, metrics, orders, portfolio, signals, trades, universe
from tapeloom.plans import optimize
from tapeloom.sources import bars
from tapeloom.streaming import monitors

DAY = dt.date(2023, 1, 2)


def walk(seed, n=120, symbol="T"):
    r, price, out = random.Random(seed), 100.0, []
    for i in range(n):
        new = price * (1 + r.gauss(0.0005, 0.02))
        out.append((symbol, DAY + dt.timedelta(days=i), price, max(price, new) * 1.01, min(price, new) * 0.99, new, float(r.randint(10**6, 5 * 10**6))))
        price = new
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "symbol string, ts date, open double, high double, low double, close double, volume double")


@pytest.fixture(scope="module")
def walks(spark):
    rows = [x for s in range(4) for x in walk(s, symbol=f"S{s}")]
    return rows, frame(spark, rows).cache()


def test_momentum_warm_up_and_lag(walks):
    rows, b = walks
    book = {(r["symbol"], r["ts"]): r for r in backtest.run(b, signals.momentum(20)).collect()}
    for s in ("S0", "S3"):
        mine = [x for x in rows if x[0] == s]
        close = [x[5] for x in mine]
        ret = [None] + [(q - p) / p for p, q in itertools.pairwise(close)]
        sig = [0.0 if i < 20 else float(np.sign(np.mean(ret[i - 19 : i + 1]))) for i in range(len(close))]
        equity = 100_000.0
        for i in range(len(close)):
            r = book[s, mine[i][1]]
            assert r["signal"] == sig[i]
            if i:
                change = sig[i - 1] - (sig[i - 2] if i > 1 else 0.0)
                cost = 0.1 * math.sqrt(abs(change) / mine[i - 1][6]) + abs(change) * 0.005 / close[i - 1]
                equity *= 1 + sig[i - 1] * ret[i] - cost
            assert r["equity"] == pytest.approx(equity, rel=1e-9)


def test_equity_begins_with_capital_and_ends_as_summary_says(walks):
    _, b = walks
    s = backtest.summary(backtest.run(b, signals.ma_cross(), capital=5000)).collect()
    assert all(r["initial_capital"] == 5000 and r["max_drawdown"] <= 0 and 0 <= r["win_rate"] <= 1 for r in s)


def test_event_fold_equals_a_loop_over_bars(walks):
    rows, b = walks
    fills = orders.fold_fills(orders.ma_decisions(b, 5, 12))
    curve = {(r["symbol"], r["ts"]): r["equity"] for r in orders.equity(b, fills).collect()}
    for s in {x[0] for x in rows}:
        cash, held, waiting, seen = 100_000.0, 0.0, None, []
        for x in [x for x in rows if x[0] == s]:
            if waiting:
                side, q = waiting
                slip = 0.1 * math.sqrt(q / x[6]) + 5 / 1e4
                price = x[2] * (1 + slip) if side == "buy" else x[2] * (1 - slip)
                fee = max(0.35, min(max(0.0035, min(0.005, 1 / q)) * q, q * price * 0.01))
                cash, held = (cash - (q * price + fee), held + q) if side == "buy" else (cash + q * price - fee, held - q)
                waiting = None
            seen.append(x[5])
            if len(seen) >= 12:
                fast, slow = np.mean(seen[-5:]), np.mean(seen[-12:])
                if fast > slow and held <= 0 and int(cash * 0.95 / x[5]):
                    waiting = ("buy", float(int(cash * 0.95 / x[5])))
                elif fast < slow and held > 0:
                    waiting = ("sell", held)
            assert curve[s, x[1]] == pytest.approx(cash + held * x[5], rel=1e-9)


def test_general_fold(walks):
    _, b = walks
    out = orders.run_on_bar(b, lambda bar, held, cash: ("buy", 1.0) if held == 0 else None).groupBy("symbol").agg(F.max("position").alias("p")).collect()
    assert all(r["p"] == 1.0 for r in out)


def test_limit_and_stop_orders(spark):
    b = frame(spark, [("A", DAY + dt.timedelta(days=i), o, o + 2, o - 2, o, 1.0) for i, o in enumerate((100.0, 101.0, 95.0, 110.0))])
    x = spark.createDataFrame([("1", "A", DAY, "buy", 97.0), ("2", "A", DAY, "sell", 105.0), ("3", "A", DAY, "buy", 10.0)], "order_id string, symbol string, ts date, side string, limit double")
    got = {r["order_id"]: (r["fill_ts"], r["fill_price"]) for r in orders.limit_fills(x, b).collect()}
    assert got == {"1": (DAY + dt.timedelta(days=2), 95.0), "2": (DAY + dt.timedelta(days=3), 110.0)}
    stops = orders.stop_fills(x.withColumnRenamed("limit", "stop").where("order_id = '2'"), b).collect()
    assert stops[0]["fill_price"] == 101.0


def test_round_trips(spark):
    rows = [(DAY, 1, "buy", 10, 100.0), (DAY, 2, "buy", 10, 110.0), (DAY, 3, "sell", 5, 120.0), (DAY, 4, "sell", 25, 90.0), (DAY, 5, "buy", 10, 80.0)]
    f = spark.createDataFrame([("A", *r) for r in rows], "symbol string, ts date, seq int, side string, quantity int, price double")
    got = [(r["quantity"], r["entry"], r["pnl"]) for r in orders.round_trips(f).orderBy("n").collect()]
    assert got == [(5.0, 105.0, 75.0), (15.0, 105.0, -225.0), (10.0, 90.0, 100.0)]


def test_metrics_against_numpy(spark, walks):
    rows, _ = walks
    r = np.diff([x[5] for x in rows if x[0] == "S1"]) / np.array([x[5] for x in rows if x[0] == "S1"])[:-1]
    df = spark.createDataFrame([("a", DAY + dt.timedelta(days=i), float(v)) for i, v in enumerate(r)] + [("a", DAY, None), ("b", DAY, float("nan")), ("b", DAY + dt.timedelta(days=1), 0.01)], "run_id string, ts date, r double")
    got = {x["run_id"]: x for x in metrics.report(df).collect()}
    a = got["a"]
    assert a["sharpe_ratio"] == pytest.approx(r.mean() / r.std(ddof=1) * math.sqrt(252))
    assert a["var"] == pytest.approx(np.percentile(r, 5)) and a["cvar"] <= a["var"]
    assert a["sortino_ratio"] == pytest.approx(r.mean() / r[r < 0].std(ddof=1) * math.sqrt(252))
    n, d = len(r), r - r.mean()
    g1 = (d**3).mean() / (d**2).mean() ** 1.5
    assert a["skewness"] == pytest.approx(g1 * math.sqrt(n * (n - 1)) / (n - 2))
    assert got["b"]["n"] == 1 and got["b"]["volatility"] is None and got["b"]["profit_factor"] == math.inf
    assert metrics.report(df.limit(0)).count() == 0


def test_drawdown_periods_equal_the_loop(spark):
    r = random.Random(5)
    for _ in range(3):
        e, rows = 100.0, []
        for i in range(80):
            e *= 1 + r.gauss(0, 0.01)
            rows.append(("x", DAY + dt.timedelta(days=i), e))
        want, top, open_at = [], -1.0, None
        for _, t, v in rows:
            top = max(top, v)
            dd = v / top - 1
            if open_at is None and dd < -0.01:
                open_at = [t, v]
            elif open_at is not None and dd >= 0:
                want.append((open_at[0], t))
                open_at = None
        if open_at:
            want.append((open_at[0], None))
        df = spark.createDataFrame(rows, "run_id string, ts date, equity double")
        assert sorted((p["start_date"], p["recovery_date"]) for p in drawdown.periods(df).collect()) == sorted(want)


def test_trades_without_pnl_and_empty(spark):
    t = spark.createDataFrame([(1, DAY, "A", "buy", 1, 5.0)], "trade_id int, timestamp date, symbol string, side string, quantity int, price double")
    s = trades.stats(t).collect()[0]
    assert s["total_trades"] == 1 and s["win_rate"] == 0 and s["profit_factor"] == 0
    assert trades.stats(t.limit(0)).collect()[0]["total_trades"] == 0
    assert trades.monthly(t).collect()[0]["total_pnl"] == 1


def test_splits_and_folds(spark):
    assert optimize.window_table(spark, 50, 100, 30).count() == 0
    found = optimize.purged_kfold(spark.range(252).select(F.col("id").alias("row_idx")), 252).collect()
    folds = {}
    for r in found:
        folds.setdefault(r["fold"], {"train": set(), "test": set()})[r["role"]].add(r["row_idx"])
    assert sorted(folds) == [1, 2, 3, 4] and all(max(f["train"]) < min(f["test"]) - 5 for f in folds.values())
    assert [r["test_groups"] for r in optimize.combinatorial(spark, 252).orderBy("split").collect()] == ["0,1", "0,2", "1,2", "2,3", "2,4", "3,4"]
    with pytest.raises(ValueError):
        optimize.purged_kfold(spark.range(3), 3, k=1)


def test_sweep_is_ranked_and_ties_keep_the_grid(walks):
    _, b = walks
    out = optimize.ranked(optimize.sweep_momentum(b, [10, 20, 30]), "no_such_metric", "symbol").collect()
    assert all(r["place"] == r["combo_idx"] + 1 for r in out)


def test_universe_and_as_of(spark):
    m = spark.createDataFrame([("A", DAY, None, ""), ("B", DAY, DAY + dt.timedelta(days=40), "x")], "symbol string, start_date date, end_date date, reason string")
    days = spark.createDataFrame([(DAY + dt.timedelta(days=d),) for d in (-1, 0, 40, 41)], "d date")
    got = sorted((r["d"], r["symbol"]) for r in universe.active(m, days).collect())
    assert got == sorted([(DAY, "A"), (DAY, "B"), (DAY + dt.timedelta(days=40), "A"), (DAY + dt.timedelta(days=40), "B"), (DAY + dt.timedelta(days=41), "A")])


def test_validation_and_store(spark, tmp_path, walks):
    _, b = walks
    with pytest.raises(bars.ValidationError):
        bars.require_valid(b.union(b))
    with pytest.raises(bars.ValidationError):
        bars.validate(b.drop("close"))
    bars.save(b, str(tmp_path / "s"), "1d")
    assert bars.load(spark, str(tmp_path / "s"), "1d", "S1", "2023-02-01", "2023-02-10").count() == 10
    assert bars.store_stats(spark, str(tmp_path / "s")).collect()[0]["n_files"] >= 4


def test_look_ahead_is_refused():
    with pytest.raises(w.LookaheadError):
        w.forbid_lookahead(F.lead("close").over(w.ordered("symbol")))


def test_formulas_refuse_what_they_do_not_know(walks):
    _, b = walks
    for bad in ("__import__('os')", "close.real", "open if close else 1"):
        with pytest.raises(ValueError):
            factors.factor(b, bad)


def test_macd_and_student(walks):
    rows, b = walks
    got = {(r["symbol"], r["ts"]): r["macd"] for r in factors.macd(b).collect()}
    fast = slow = None
    for x in [x for x in rows if x[0] == "S2"]:
        fast = x[5] if fast is None else fast * (1 - 2 / 13) + x[5] * 2 / 13
        slow = x[5] if slow is None else slow * (1 - 2 / 27) + x[5] * 2 / 27
        assert got["S2", x[1]] == pytest.approx(fast - slow, abs=1e-9)
    assert factors.student_p(1.9695, 250) == pytest.approx(0.05, abs=2e-5)


def test_allocators():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.01, (500, 6)) * np.arange(1, 7)
    cov, corr = np.cov(x.T), np.corrcoef(x.T)
    rp = portfolio.risk_parity(cov)
    share = rp * (cov @ rp)
    assert np.allclose(share, share.mean(), rtol=1e-6) and rp.sum() == pytest.approx(1)
    assert portfolio.hierarchical_risk_parity(cov, corr).sum() == pytest.approx(1)
    mv = portfolio.mean_variance(x.mean(axis=0), cov)
    assert mv.sum() == pytest.approx(1) and mv.max() <= 0.2 + 1e-9


def test_config(tmp_path):
    with pytest.raises(ValueError):
        SlippageConfig(model="none")
    c = EngineConfig.from_dict({"engine": {"slippage": {"base_bps": 2.0}}})
    assert c.slippage.base_bps == 2.0 and not config_warnings(c)
    assert EngineConfig.from_dict(c.to_dict()) == c


def test_stream_monitors(spark, tmp_path):
    base = dt.datetime(2023, 1, 2)
    rows = [("A", base + dt.timedelta(hours=i), e) for i, e in enumerate((100.0, 110.0, 98.0, 90.0))]
    spark.createDataFrame(rows, "symbol string, ts timestamp, equity double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("symbol string, ts timestamp, equity double").parquet(str(tmp_path / "in"))
    got = monitors.run_once(monitors.drawdown_monitor(stream), "dd_test", str(tmp_path / "c")).orderBy("ts").collect()
    assert [r["level"] for r in got] == ["OK", "OK", "WARNING", "CRITICAL"]
