"""Times the headline queries and prints one JSON line.

The published figures are those of one series of about ten years of daily bars that lie ready. So that series is stored first,
and a backtest of it in either mode and a sweep of 1,000 parameters over it are timed by themselves (stored_*, sweep_1000);
the other queries build their bars from the line items each time.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time

from tapeloom import session
from tapeloom.operators import signals
from tapeloom.plans import engine, optimize, registry
from tapeloom.sources import bars

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: One backtest, sweeps, walk-forward, the full metric report, event-driven execution, factors, drawdowns, trades.
HEADLINE = (
    "vec_backtest_momentum", "vec_backtest_ma", "grid_search", "grid_search_ma", "walk_forward", "perf_ratios", "event_metrics_ma", "round_trips", "limit_order_fills", "factor_ic", "alpha_001", "drawdown_periods", "trade_stats", "trade_streaks", "universe_asof", "corr_matrix", "rolling_var",
)
#: 20 x 50 combinations.
GRID = {"fast": list(range(2, 22)), "slow": list(range(30, 80))}


def main() -> None:
    spark = session.build(f"local[{CPUS}]", int(CPUS), **{"spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    store = tempfile.mkdtemp(prefix="tapeloom-bench-")
    bars.save(bars.daily_total(spark, SF_DIR), store, "1d")

    def series():
        return bars.load(spark, store, "1d", "ALL")

    queries = {n: (lambda q: lambda: q(spark, SF_DIR))(registry.QUERIES[n]) for n in HEADLINE}
    queries["stored_backtest_momentum"] = lambda: engine.run(series(), signals.momentum(20)).summary
    queries["stored_backtest_ma"] = lambda: engine.run(series(), signals.ma_cross()).summary
    queries["stored_event_ma"] = lambda: engine.run(series(), signals.ma_cross(), "event_driven").summary
    queries["sweep_1000"] = lambda: optimize.ranked(optimize.sweep_series(series(), "ma_cross", GRID), "sharpe_ratio", "symbol")
    times = {}
    for name, run in queries.items():
        laps = []
        for _ in range(3):
            start = time.perf_counter()
            run().write.format("noop").mode("overwrite").save()
            laps.append(time.perf_counter() - start)
        times[name] = round(statistics.median(laps), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()
    shutil.rmtree(store, ignore_errors=True)
    sys.stdout.flush()


if __name__ == "__main__":
    main()
