"""Rules added to the engine, against plain loops and numpy."""

import collections
import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom import session
from tapeloom.config import EngineConfig
from tapeloom.operators import drawdown, execution, factors, metrics, orders, portfolio, risk, signals, text, trades, universe
from tapeloom.plans import engine, optimize
from tapeloom.sources import bars
from tapeloom.streaming import monitors
from tests.test_engine import DAY, frame, walk


@pytest.fixture(scope="module")
def walks(spark):
    rows = [x for s in range(3) for x in walk(s, 150, f"S{s}")]
    return rows, frame(spark, rows).cache()


def test_modes(spark, walks):
    _, b = walks
    assert engine.run(b, signals.momentum(5)).mode == "vectorized"  # hybrid: the strategy decides
    assert engine.run(b, signals.ma_cross(5, 12), config=EngineConfig(mode="event_driven")).mode == "event_driven"
    assert engine.validate(b, signals.ma_cross(5, 12)).summary.count() == 3
    with pytest.raises(ValueError):
        engine.run(b, signals.momentum(5), "event_driven")

    class Once(orders.BarStrategy):
        def __init__(self):
            self.fills = 0

        def on_bar(self, bar, position, cash):
            return ("buy", 2.0) if self.fills < 2 else None

        def on_fill(self, fill):
            self.fills += 1

    own = signals.Strategy("once", on_bar=Once)
    assert engine.select_mode(own) == "event_driven"
    s = engine.run(b, own).summary.collect()
    assert all(r["total_trades"] == 2 for r in s)
    batch = engine.run_batch(b, signals.ma_cross, {"fast": [3, 5], "slow": [12]}, "event_driven").collect()
    assert len(batch) == 6 and {r["fast"] for r in batch} == {3, 5}


def test_buys_ask_again_until_the_cash_suffices(spark):
    rows = [("A", DAY + dt.timedelta(days=i), p, p, p, p, 1e6) for i, p in enumerate([10, 10, 10, 200, 300, 400, 15, 16, 17, 18, 19, 5, 4])]
    fills = orders.fold_fills(orders.ma_decisions(frame(spark, [(*r[:2], *map(float, r[2:])) for r in rows]), 2, 3), capital=100).collect()
    cash, held, want, close = 100.0, 0.0, [], [r[2] for r in rows]
    for i in range(2, len(rows) - 1):
        fast, slow = np.mean(close[i - 1 : i + 1]), np.mean(close[i - 2 : i + 1])
        q = math.floor(cash * 0.95 / close[i])
        if fast > slow and held <= 0 and q > 0:
            want.append(("buy", float(q)))
        elif fast < slow and held > 0:
            want.append(("sell", held))
        else:
            continue
        side, q = want[-1]
        slip = 0.1 * math.sqrt(q / 1e6) + 5 / 1e4
        price = close[i + 1] * (1 + slip if side == "buy" else 1 - slip)
        fee = max(0.35, min(max(0.0035, min(0.005, 1 / q)) * q, q * price * 0.01))
        cash, held = (cash - q * price - fee, held + q) if side == "buy" else (cash + q * price - fee, held - q)
    assert [(f["side"], f["quantity"]) for f in fills] == want and want


def test_series_and_windows_sweep_alike(walks):
    _, b = walks
    for kind, make, values in (("momentum", signals.momentum, {"lookback": [2, 10, 149, 200]}), ("ma_cross", signals.ma_cross, {"fast": [3, 5], "slow": [10, 151]})):
        one = {(r["symbol"], r["combo_idx"]): r for r in optimize.sweep(b, make, values).collect()}
        two = {(r["symbol"], r["combo_idx"]): r for r in optimize.sweep_series(b, kind, values, chunk=3).collect()}
        assert one.keys() == two.keys()
        for k, r in one.items():
            for c, v in r.asDict().items():
                assert two[k][c] == (pytest.approx(v, rel=1e-9, abs=1e-9) if isinstance(v, float) else v), (k, c)
    with pytest.raises(ValueError):
        optimize.sweep_series(b, "ma_cross", {"fast": [5], "slow": [5]})


def test_anchored_windows_train_from_the_first_bar(walks):
    _, b = walks
    found = optimize.walk_forward(b, signals.momentum, {"lookback": [3, 5]}, 60, 30, min_trades=1, anchored=True).collect()
    assert {r["train_start"] for r in found} == {DAY}
    assert all((r["train_end"] - DAY).days == 59 + 30 * r["window_id"] for r in found) and {r["window_id"] for r in found} == {0, 1, 2}


def test_resting_orders_over_many_bars(spark):
    r = random.Random(3)
    n, price, rows = 9000, 100.0, []
    for i in range(n):
        price *= 1 + r.gauss(0, 0.004)
        rows.append(("A", DAY + dt.timedelta(days=i), price, price * 1.002, price * 0.998, price, 1.0))
    b = frame(spark, rows)
    asked = [(str(k), "A", rows[at][1], r.choice(("buy", "sell")), rows[at][2] * r.choice((0.5, 0.8, 0.97, 1.03, 1.2, 2.0))) for k, at in enumerate(r.sample(range(n), 120))]
    x = spark.createDataFrame(asked, "order_id string, symbol string, ts date, side string, limit double")
    for f, hit, price_of in (
        (orders.limit_fills, lambda s, row, v: row[4] <= v if s == "buy" else row[3] >= v, lambda s, row, v: min(v, row[2]) if s == "buy" else max(v, row[2])),
        (lambda o, bb: orders.stop_fills(o.withColumnRenamed("limit", "stop"), bb), lambda s, row, v: row[3] >= v if s == "buy" else row[4] <= v, lambda s, row, v: max(v, row[2]) if s == "buy" else min(v, row[2])),
    ):
        want = {}
        for k, _, t, side, v in asked:
            row = next((row for row in rows[(t - DAY).days + 1 :] if hit(side, row, v)), None)
            if row:
                want[k] = (row[1], price_of(side, row, v))
        assert {g["order_id"]: (g["fill_ts"], g["fill_price"]) for g in f(x, b).collect()} == want
        assert 0 < len(want) < len(asked)


def test_ledgers_equal_loops(spark):
    r = random.Random(9)
    fills = [("A" if i % 3 else "B", DAY + dt.timedelta(days=i // 4), i, r.choice(("buy", "sell")), r.randint(1, 30), 50 + r.random() * 10) for i in range(200)]
    df = spark.createDataFrame(fills, "symbol string, ts date, seq int, side string, quantity int, price double").repartition(5)
    state, want = collections.defaultdict(lambda: [0.0, 0.0, 0.0]), {}
    for s, _, i, side, q, p in fills:
        x = state[s]
        if side == "buy":
            x[1] = (x[1] * x[0] + p * q) / (x[0] + q) if x[0] > 0 else p
            x[0] += q
        else:
            x[2] += (p - x[1]) * min(q, x[0]) if x[0] > 0 else 0.0
            x[0] -= q
        want[i] = tuple(x)
    found = {g["seq"]: (g["quantity"], g["avg_price"], g["realised"]) for g in orders.positions(df).collect()}
    assert np.allclose([found[i] for i in range(200)], [want[i] for i in range(200)])
    closed = orders.round_trips(df).collect()
    held = collections.defaultdict(float)
    shut = collections.Counter()
    for s, _, _, side, q, _ in fills:
        signed = q if side == "buy" else -q
        if held[s] * signed < 0:
            shut[s] += min(abs(held[s]), q)
        held[s] += signed
    got = collections.Counter()
    for c in closed:
        got[c["symbol"]] += c["quantity"]
        assert c["pnl_pct"] == pytest.approx(c["pnl"] / (c["entry"] * c["quantity"]))
    assert got == shut
    assert orders.positions(df.limit(0)).count() == 0


def test_order_states(spark):
    o = spark.createDataFrame([(1, 10.0), (2, 5.0), (3, 1.0)], "order_id int, quantity double")
    u = spark.createDataFrame([(1, 1, 4.0, 9.0, 0.1), (1, 2, 10.0, 9.5, 0.2), (1, 3, 11.0, 1.0, 0.3), (2, 1, 1.0, 2.0, 0.1)], "order_id int, seq int, filled_quantity double, filled_price double, commission double")
    got = sorted((r["order_id"], r["seq"] or 0, r["status"], r["remaining"]) for r in orders.lifecycle(o, u).collect())
    assert got == [(1, 1, "partial", 6.0), (1, 2, "filled", 0.0), (2, 1, "partial", 4.0), (3, 0, "submitted", 1.0)]
    x = spark.createDataFrame([("filled", "day"), ("partial", "ioc"), ("partial", "gtc"), ("submitted", "day")], "status string, tif string")
    assert [r["s"] for r in x.select(orders.resolve(x, F.col("tif")).alias("s")).collect()] == ["filled", "cancelled", "partial", "expired"]


def test_breaker_equals_the_loop(spark):
    r, base = random.Random(4), dt.datetime(2023, 1, 2)
    rows = [("x", base + dt.timedelta(minutes=17 * i), r.random() * 0.2, r.random() * 0.05) for i in range(300)]
    rows.append(("x", base + dt.timedelta(minutes=17 * 300), None, 0.9))
    want, since = [], None
    for _, t, d, loss in rows:
        reason = None
        if since is not None and t - since > dt.timedelta(minutes=60):
            since = None
        if since is None and (d is not None and d >= 0.15 or loss >= 0.045):
            since, reason = t, "daily loss" if loss >= 0.045 else "drawdown"
        want.append((t, reason, since is not None))
    df = spark.createDataFrame(rows, "run_id string, ts timestamp_ntz, drawdown double, daily_loss double").repartition(3)
    got = sorted((g["ts"], g["reason"], g["active"]) for g in drawdown.breaker(df).collect())
    assert got == sorted(want) and {"drawdown", "daily loss"} <= {w[1] for w in want}


@pytest.mark.parametrize("by", [(), ("symbol",)])
def test_streaks_equal_the_loop(spark, by):
    r = random.Random(7)
    rows = [(i, DAY + dt.timedelta(days=i * 3), r.choice("AB"), r.choice((1.0, 1.0, 1.0, -1.0, 0.0)) if i < 150 else -1.0) for i in range(300)]
    got = trades.streaks(spark.createDataFrame(rows, "trade_id int, timestamp date, symbol string, pnl double").repartition(4), *by)
    for g in got.collect():
        mine = [x[3] for x in rows if not by or x[2] == g["symbol"]]
        for sign, column in ((1, "max_consecutive_wins"), (-1, "max_consecutive_losses")):
            best = run = 0
            for p in mine:
                run = run + 1 if p * sign > 0 else 0
                best = max(best, run)
            assert g[column] == best
    s = trades.summary(spark.createDataFrame([x for x in rows], "trade_id int, timestamp date, symbol string, pnl double")).collect()
    assert len(s) == 1 and len(s[0]) == 15


def test_covariances_with_missing_values(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0.01, 0.02, (90, 7))
    x[:, 3] = 0.5 * x[:, 0] + 0.1 * x[:, 3]
    x[rng.random(x.shape) < 0.15] = np.nan
    rows = [(DAY + dt.timedelta(days=i), f"s{j}", float(v)) for i, r in enumerate(x) for j, v in enumerate(r) if v == v]
    df = spark.createDataFrame(rows, "ts date, symbol string, r double").repartition(7)
    got = {(r["a"], r["b"]): (r["cov"], r["corr"]) for r in portfolio.pairs(df).collect()}
    for i in range(7):
        for j in range(7):
            ok = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            want = np.cov(x[ok, i], x[ok, j])[0, 1], np.corrcoef(x[ok, i], x[ok, j])[0, 1]
            assert got[f"s{i}", f"s{j}"] == pytest.approx(want)
    assert portfolio.pairs(df.limit(0)).count() == 0
    recent = {(r["a"], r["b"]): r["corr"] for r in portfolio.recent_correlation(df, "symbol", 60).collect()}
    last = {j: x[~np.isnan(x[:, j]), j][-60:] for j in range(7)}
    assert recent["s0", "s3"] == pytest.approx(np.corrcoef(last[0], last[3])[0, 1])


def test_cost_aware_trades_are_the_best(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(40, 5)) * 0.1
    cov, current, target = np.cov(a.T), np.array([0.5, 0.1, 0.1, 0.2, 0.1]), np.array([0.1, 0.3, 0.2, 0.2, 0.2])

    def value(x):
        return 0.001 * np.abs(x - current).sum() + 10 * (x - target) @ cov @ (x - target)

    best = current + portfolio.cost_aware(current, target, cov, 1.0, least=0.0)
    assert best.sum() == pytest.approx(1) and best.min() >= 0
    for _ in range(4000):
        i, j = rng.choice(5, 2, replace=False)
        x = best.copy()
        step = min(rng.random() * 0.05, x[j], 1 - x[i])
        x[i], x[j] = x[i] + step, x[j] - step
        assert value(x) >= value(best) - 1e-9
    assert not portfolio.cost_aware(current, target, cov, 1e9).any()


def test_weights_without_enough_returns(spark):
    rows = [(s, DAY + dt.timedelta(days=i), 0.01 * (1 + i % 3)) for s, n in (("a", 70), ("b", 62)) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, ts date, r double")
    assert {r["symbol"]: r["weight"] for r in portfolio.momentum_weights(df).collect()} == {"a": 1.0, "b": 0.0}
    short = portfolio.inverse_volatility(df.where("symbol = 'a' or ts < '2023-01-20'")).collect()
    sd = np.std([0.01 * (1 + i % 3) for i in range(10, 70)]) * math.sqrt(252)
    assert {r["symbol"]: r["weight"] for r in short}["b"] == pytest.approx((1 / 0.2) / (1 / 0.2 + 1 / sd))


def test_student_column_equals_the_fraction(spark):
    x = spark.createDataFrame([(t / 7,) for t in range(-60, 61)], "t double")
    for r in x.select("t", factors.student_p_column(F.col("t")).alias("p"), factors.student_p_column(F.col("t"), 2).alias("q")).collect():
        assert r["p"] == pytest.approx(factors.student_p(r["t"], 250), abs=1e-10)
        assert r["q"] == pytest.approx(factors.student_p(r["t"], 2), abs=1e-10)


def test_orders_in_time(spark):
    o = spark.createDataFrame([(1, 8.0), (2, 100.0)], "order_id int, quantity double")
    got = [(r["slice"], r["offset_seconds"]) for r in execution.vwap(o).where("order_id = 1").orderBy("slice").collect()]
    assert got == [(0, 0.0), (13, 3600 / 14)]  # only these are a unit or more
    assert execution.vwap(o).where("order_id = 2").count() == 14


def test_pre_trade_boundaries(spark):
    rows = [(0.0, 100.0, 0.0, 0, -3.0), (0.0, 100.0, 0.0, 0, -3.01), (10.0, 100.0, 90.0, 0, 0.0), (10.01, 100.0, 0.0, 0, 0.0), (0.0, 100.0, 0.0, 100, 0.0)]
    df = spark.createDataFrame(rows, "order_value double, portfolio_value double, exposure double, orders_today int, daily_pnl double")
    assert [r["reason"] for r in risk.pre_trade(df).collect()] == [None, "daily loss limit", None, "position limit", "order limit"]


def test_texts(spark):
    long = " ".join(["word"] * 1001)
    rows = [("a " * 99, "news"), (long, "news"), ("b " * 150, "earnings"), ("c " * 150 + "Outlook", "news"), (long, "social"), ("d " * 150, "news"), (None, "news")]
    df = spark.createDataFrame(rows, "t string, k string")
    assert [r[0] for r in df.select(text.complexity(F.col("t"), F.col("k"))).collect()] == ["simple", "complex", "complex", "moderate", "simple", "simple", "simple"]
    m = spark.createDataFrame([("balanced", "complex")], "p string, c string")
    assert m.select(text.model_for(F.col("p"), F.col("c"), middle=False, large=False)).first()[0] == "small"
    raw = spark.createDataFrame([("X", '{"results": [{"id": "1", "title": "t", "published_utc": "2024-01-02T03:04:05Z", "publisher": {"name": "p"}}, {"id": "2"}]}')], "symbol string, raw string")
    got = text.normalise_news(raw, "polygon").collect()
    assert [(r["id"], r["source"], r["summary"]) for r in got] == [("1", "p", ""), ("2", "unknown", "")]
    with pytest.raises(ValueError):
        text.normalise_news(raw, "other")
    t = spark.createDataFrame([(1, "Hello\nOperator: wait\nQ&A\nWhy?\nnone")], "id int, text string")
    got = {r["section"]: r["lines"] for r in text.transcripts(text.split_lines(t, "id"), "id").collect()}
    assert got == {"prepared_remarks": ["Hello"], "operator_notes": ["Operator: wait"], "q_and_a": ["Why?", "none"]}


def test_universe_and_store(spark, tmp_path, walks):
    _, b = walks
    m = spark.createDataFrame([("A", DAY, None, None)], "symbol string, start_date date, end_date date, reason string")
    m = universe.add_member(m, "B", "2023-02-01", None, "IPO")
    assert [(r["symbol"], r["reason"]) for r in universe.export(m).collect()] == [("A", ""), ("B", "IPO")]
    asked = []

    def fetch(start, end):
        asked.append((start, end))
        return b.where((F.col("symbol") == "S1") & F.col("ts").between(F.lit(start).cast("date"), F.lit(end).cast("date")))

    path = str(tmp_path / "through")
    for end, n in (("2023-01-31", 30), ("2023-01-31", 30), ("2023-02-28", 58)):
        assert bars.read_through(spark, path, "1d", "S1", "2023-01-02", end, fetch).count() == n
    assert asked == [("2023-01-02", "2023-01-31"), ("2023-02-01", "2023-02-28")]


def test_report_has_all_entries(spark, walks):
    _, b = walks
    r = b.select(F.col("symbol").alias("run_id"), "ts", (F.col("close") / F.col("open") - 1).alias("r"))
    got = metrics.written(metrics.report(r)).where("run_id = 'S1'").collect()
    assert [x["metric"] for x in got] == list(metrics.ENTRIES) and got[0]["text"].endswith("%")


def test_value_at_risk_stream_equals_the_batch(spark, tmp_path):
    r, base = random.Random(2), dt.datetime(2023, 1, 2)
    rows = [("A", base + dt.timedelta(hours=i), r.gauss(0, 0.05)) for i in range(300)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, r double")
    for part in (0, 1):
        df.where(F.col("ts") < F.lit(base + dt.timedelta(hours=150)) if not part else F.col("ts") >= F.lit(base + dt.timedelta(hours=150))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = [tuple(x) for x in monitors.run_once(monitors.var_monitor(stream), "v", str(tmp_path / "c")).orderBy("ts").collect()]
    want = [tuple(x) for x in risk.var_alerts(df.withColumnRenamed("symbol", "run_id")).where("var is not null").orderBy("ts").select("run_id", "ts", "var", "cvar", "alert").collect()]
    assert len(got) == 281 and got == [(s, t, pytest.approx(v), pytest.approx(c), a) for s, t, v, c, a in want]


def test_sliding_and_session_windows(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [("A", base + dt.timedelta(minutes=m), float(m), m) for m in (0, 10, 20, 300, 310, 2000)]
    spark.createDataFrame(rows, "event_type string, ts timestamp, value double, event_id int").coalesce(1).write.parquet(str(tmp_path / "t"))
    ticks = monitors.read_ticks(spark, str(tmp_path / "t"))
    got = monitors.run_once(monitors.session_bars(ticks), "s", str(tmp_path / "c1")).orderBy("ts").collect()
    assert [(r["low"], r["high"], r["volume"]) for r in got] == [(0.0, 20.0, 3), (300.0, 310.0, 2)]
    slid = monitors.run_once(monitors.sliding_bars(ticks, "1 day", "12 hours"), "w", str(tmp_path / "c2"), "update", ("symbol", "ts")).collect()
    assert sum(r["volume"] for r in slid) == 2 * len(rows)


def test_shared_place_is_below_the_checkpoint_folder(spark):
    assert session.shared_place(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_guard(spark, walks):
    from tapeloom.functions.windows import LookaheadError
    from tapeloom.operators.guards import Guard

    rows, b = walks
    g = Guard(b, 20)
    close = [x[5] for x in rows if x[0] == "S1"]

    def seen(df):
        return [r["close"] for r in df.where("symbol = 'S1'").orderBy("ts").collect()]

    assert seen(g.rows()) == close[:21] and seen(g.rows(3, 7)) == close[3:7] and seen(g.rows(-4)) == close[17:21] and seen(g.rows(0, -19)) == close[:2]
    assert seen(g.row(5)) == [close[5]] and seen(g.row(-1)) == [close[20]] and seen(g.row(-3)) == [close[18]]
    assert seen(g.update_index(2).visible()) == close[:3]
    for bad in (lambda: g.row(21), lambda: g.rows(0, 22)):
        with pytest.raises(LookaheadError):
            bad()
    with pytest.raises(ValueError):
        Guard(b, -1)
    s = {r["symbol"]: r for r in g.stats("close").collect()}["S1"]
    assert s["n"] == 21 and s["std"] == pytest.approx(np.std(close[:21], ddof=1))


def test_simulated_paths(spark):
    from tapeloom.plans import montecarlo

    r = [0.01, -0.02, 0.03, 0.0, -0.01]
    df = spark.createDataFrame([("a", DAY + dt.timedelta(days=i), x) for i, x in enumerate(r)] + [("b", DAY, 0.1)], "run_id string, ts date, r double").repartition(3)
    draws = spark.range(200).selectExpr("id as path", "explode(sequence(1, 30)) as i").selectExpr("path", "i", "pmod(xxhash64(7, path, i), 5L) as k").collect()
    worth, top, worst = (dict.fromkeys(range(200), v) for v in (1.0, 1.0, 0.0))
    for d in sorted(draws, key=lambda d: (d["path"], d["i"])):
        p = d["path"]
        worth[p] *= 1 + r[d["k"]]
        top[p] = max(top[p], worth[p])
        worst[p] = min(worst[p], worth[p] / top[p] - 1)
    paths = montecarlo.bootstrap(df, 200, 30, seed=7)
    got = {x["path"]: x for x in paths.where("run_id = 'a'").collect()}
    for p in range(200):
        assert got[p]["total_return"] == pytest.approx(worth[p] - 1) and got[p]["max_drawdown"] == pytest.approx(worst[p])
    s = {x["run_id"]: x for x in montecarlo.summary(paths).collect()}
    assert s["a"]["n_paths"] == 200 and s["a"]["p05"] == pytest.approx(np.percentile([worth[p] - 1 for p in range(200)], 5))
    assert s["b"]["mean_return"] == pytest.approx(1.1**30 - 1)


def test_frontier_is_made_of_best_portfolios():
    rng = np.random.default_rng(1)
    x = rng.normal(0.001, 0.01, (300, 4)) * np.arange(1, 5)
    mu, cov = x.mean(axis=0), np.cov(x.T)
    points = portfolio.frontier(mu, cov, n=6)
    for risk_, gain in points:
        for _ in range(300):
            w = rng.dirichlet(np.ones(4))
            assert not (np.sqrt(w @ cov @ w) < risk_ - 1e-7 and w @ mu > gain + 1e-9)
    best = portfolio.mean_variance(mu, cov, 0.1, 0.5)
    for _ in range(2000):
        w = rng.dirichlet(np.ones(4))
        if w.max() <= 0.5:
            assert w @ mu - 0.1 * np.sqrt(w @ cov @ w) <= best @ mu - 0.1 * np.sqrt(best @ cov @ best) + 1e-12
