"""Event-driven execution: decisions, next-bar fills, cash and positions as folds over sorted rows, resting orders as joins."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.config import EngineConfig
from tapeloom.functions.costs import broker_fill
from tapeloom.functions.folds import fold, kind
from tapeloom.functions.windows import last_rows, ordered, row_index, so_far
from tapeloom.operators import backtest


def ma_decisions(bars: DataFrame, fast: int = 10, slow: int = 30) -> DataFrame:
    """The bars at which the long-only crossover strategy may want to trade, with the fill at the next bar's open: all where the fast mean is above, and the first below.

    A buy asks again at each bar as long as nothing is held, for the cash may not have sufficed; a decision on the last bar
    never fills.
    """
    w = ordered("symbol")
    side = F.signum(F.avg("close").over(last_rows(fast, "symbol")) - F.avg("close").over(last_rows(slow, "symbol")))
    x = bars.withColumn("row_idx", row_index("symbol")).withColumn("c", F.when(F.col("row_idx") >= slow - 1, side))
    x = x.withColumn("state", F.last(F.when(F.col("c") != 0, F.col("c")), ignorenulls=True).over(so_far("symbol")))
    x = x.withColumn("before", F.coalesce(F.lag("state").over(w), F.lit(0.0)))
    x = x.withColumn("side", F.when(F.col("c") == 1, "buy").when((F.col("c") == -1) & (F.col("before") == 1), "sell"))
    x = x.withColumn("fill_ts", F.lead("ts").over(w)).withColumn("fill_open", F.lead("open").over(w)).withColumn("fill_volume", F.lead("volume").over(w))
    return x.where(F.col("side").isNotNull() & F.col("fill_ts").isNotNull()).select("symbol", "ts", "side", "close", "fill_ts", "fill_open", "fill_volume")


def fold_fills(decisions: DataFrame, config: EngineConfig | None = None, capital: float | None = None, share: float = 0.95) -> DataFrame:
    """Fills with quantity, price, commission, slippage, cash and position after each.

    Only cash and quantity are sequential: a fold over a symbol's decisions in order of time carries them. Buys spend `share`
    of the cash in whole units, unless something is held or it isn't enough for one; sells close the position.
    """
    config = config or EngineConfig()
    money = float(capital or config.default_capital)
    slippage, commission = config.slippage, config.commission

    def step(state, d):
        cash, held, n = state
        buy = d["side"] == "buy"
        if buy and held > 0:
            return state, []
        q = float(math.floor(cash * share / d["close"])) if buy else held
        if q <= 0:
            return state, []
        price, fee, slip = broker_fill(d["side"], q, d["fill_open"], d["fill_volume"], slippage, commission)
        cash, held = (cash - (q * price + fee), held + q) if buy else (cash + (q * price - fee), held - q)
        return (cash, held, n + 1), [(d["symbol"], f"ORD-{n + 1:06d}", d["fill_ts"], d["side"], q, price, fee, slip, cash, held)]

    schema = f"symbol {kind(decisions, 'symbol')}, order_id string, ts {kind(decisions, 'fill_ts')}, side string, quantity double, price double, commission double, slippage double, cash double, position double"
    return fold(decisions, ("symbol",), ("ts",), lambda: (money, 0.0, 0), step, schema)


def equity(bars: DataFrame, fills: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """(symbol, ts, equity) after each bar: cash and position of the last fill, marked at the close."""
    x = bars.join(fills.select("symbol", "ts", "cash", "position"), ["symbol", "ts"], "left")
    w = so_far("symbol")
    cash = F.coalesce(F.last("cash", ignorenulls=True).over(w), F.lit(float(capital)))
    held = F.coalesce(F.last("position", ignorenulls=True).over(w), F.lit(0.0))
    return x.select("symbol", "ts", (cash + held * F.col("close")).alias("equity"))


def summary(curve: DataFrame, fills: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """The engine's ten figures of an event-driven run, dates and capital; bars count as won or lost only where something was traded."""
    before = F.coalesce(F.lag("equity").over(ordered("symbol")), F.lit(float(capital)))
    x = curve.withColumn("net", F.col("equity") / before - 1)
    top = F.greatest(F.max("equity").over(so_far("symbol")), F.lit(float(capital)))
    n = fills.groupBy("symbol").agg(F.count("*").alias("total_trades"))
    figures = backtest.figures(x.withColumn("dd", F.col("equity") / top - 1), "symbol", capital=F.lit(float(capital)), trades=F.lit(0)).drop("total_trades").join(n, "symbol", "left")
    traded = F.col("total_trades") > 0
    idle = [F.when(traded, F.col(c)).otherwise(0.0).alias(c) for c in ("win_rate", "profit_factor", "avg_trade_return")]
    whole = figures.withColumn("total_trades", F.coalesce("total_trades", F.lit(0)))
    return whole.select(*[c for c in figures.columns if c not in ("win_rate", "profit_factor", "avg_trade_return")], *idle)


#: Children of a node of the tree over a symbol's bars.
FAN = 64


def _first_hits(orders: DataFrame, bars: DataFrame, limit: str, hit, price) -> DataFrame:
    """orders (order_id, symbol, ts, side, limit) with the time and price of the first later bar that hit(side, low, high, limit) holds for.

    Bars are numbered per symbol and gathered, 64 at a time, into two levels of lowest and highest prices. An order looks
    through the rest of its own 64 bars, then of its 4,096, then the blocks of 4,096 after them, and down again: equality
    joins that meet 64 rows at most each, but for the last of the three, which only orders open so long come to.
    """
    w = Window.partitionBy("symbol").orderBy("ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    b = bars.select("symbol", "ts", "open", "high", "low", F.lit(0).alias("_side"))
    placed = orders.select("order_id", "symbol", "ts", "side", limit, F.lit(1).alias("_side"))
    both = b.unionByName(placed, allowMissingColumns=True).withColumn("_n", F.count(F.when(F.col("_side") == 0, 1)).over(w))
    level = [both.where("_side = 0").select("symbol", (F.col("_n") - 1).alias("node"), "low", "high", "open", F.col("ts").alias("bar_ts"))]
    for _ in range(2):
        up = level[-1].groupBy("symbol", F.floor(F.col("node") / FAN).alias("node")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
        level.append(up)
    x = both.where("_side = 1").select("order_id", "symbol", "side", limit, F.col("_n").alias("pos"))
    found = hit(F.col("side"), F.col("low"), F.col("high"), F.col(limit))
    keys = ["order_id", "symbol", "side", limit]
    left = x
    at = []  # per level the orders found there
    for k, nodes in enumerate(level):
        n = nodes.select(F.col("symbol").alias("_s"), "node", "low", "high", F.floor(F.col("node") / FAN).alias("_up"))
        meet = (F.col("symbol") == F.col("_s")) & (F.col("node") >= F.col("pos")) & found
        if k < 2:
            meet = meet & (F.floor(F.col("pos") / FAN) == F.col("_up"))
        got = left.join(n, meet, "left").groupBy(*keys, "pos").agg(F.min("node").alias("node"))
        at.append(got.where("node is not null").select(*keys, "node"))
        left = got.where("node is null").select(*keys, (F.floor(F.col("pos") / FAN) + 1).alias("pos"))
    for k in (2, 1):
        n = level[k - 1].select(F.col("symbol").alias("_s"), F.col("node").alias("_child"), "low", "high", F.floor(F.col("node") / FAN).alias("_up"))
        down = at[k].join(n, (F.col("symbol") == F.col("_s")) & (F.col("node") == F.col("_up")) & found).groupBy(*keys).agg(F.min("_child").alias("node"))
        at[k - 1] = at[k - 1].unionByName(down)
    return at[0].join(level[0].select("symbol", "node", "open", "bar_ts"), ["symbol", "node"]).select(*keys, F.col("bar_ts").alias("fill_ts"), price.alias("fill_price"))


def limit_fills(orders: DataFrame, bars: DataFrame) -> DataFrame:
    """orders (order_id, symbol, ts, side, limit) filled at their first later bar that reaches the limit; no slippage.

    A buy fills at the smaller of limit and open, a sell at the larger. Orders wait until they fill; ids must be unique.
    """
    price = F.when(F.col("side") == "buy", F.least("limit", "open")).otherwise(F.greatest("limit", "open"))
    return _first_hits(orders, bars, "limit", lambda side, low, high, limit: F.when(side == "buy", low <= limit).otherwise(high >= limit), price)


def stop_fills(orders: DataFrame, bars: DataFrame) -> DataFrame:
    """Stop orders (order_id, symbol, ts, side, stop) at their first later bar beyond the stop (an extension)."""
    price = F.when(F.col("side") == "buy", F.greatest("stop", "open")).otherwise(F.least("stop", "open"))
    return _first_hits(orders, bars, "stop", lambda side, low, high, stop: F.when(side == "buy", high >= stop).otherwise(low <= stop), price)


#: States of an order, and how long it stands.
STATES = ("pending", "submitted", "partial", "filled", "cancelled", "rejected", "expired")
TIME_IN_FORCE = ("day", "gtc", "ioc", "fok", "opg", "cls")


def lifecycle(orders: DataFrame, updates: DataFrame) -> DataFrame:
    """orders (order_id, quantity) with each update (order_id, seq, filled_quantity, filled_price, commission) and the state after it.

    filled_quantity counts from the order's start, so an update replaces the one before; at the full quantity the order is
    filled and later updates are ignored. An order without updates is submitted, with nulls.
    """
    w = Window.partitionBy("order_id").orderBy("seq")
    x = orders.select("order_id", "quantity").join(updates, "order_id", "left")
    whole = F.coalesce(F.col("filled_quantity") >= F.col("quantity"), F.lit(False))
    x = x.withColumn("_done", F.coalesce(F.max(whole.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("_done = 0").drop("_done")
    state = F.when(F.col("seq").isNull(), "submitted").when(whole, "filled").otherwise("partial")
    return x.select("order_id", "seq", "filled_quantity", "filled_price", "commission", (F.col("quantity") - F.coalesce("filled_quantity", F.lit(0))).alias("remaining"), state.alias("status"))


def resolve(final: DataFrame, tif: Column) -> Column:
    """The state of an order whose time is over: immediate ones and fill-or-kill ones are cancelled, others expire; gtc ones stand."""
    return F.when(F.col("status") == "filled", "filled").when(tif == "gtc", F.col("status")).when(tif.isin("ioc", "fok"), "cancelled").otherwise("expired")


def round_trips(fills: DataFrame) -> DataFrame:
    """Closed parts of positions from fills (symbol, ts, seq, side, quantity, price): entry and exit price, pnl, pnl share.

    Signed positions, average entry price, closes in part or whole, reversals. A fold per symbol, in order of ts and seq.
    """

    def step(state, f):
        held, avg, n = state
        q = float(f["quantity"]) if f["side"] == "buy" else -float(f["quantity"])
        left, price = held + q, f["price"]
        if held == 0 or (held > 0) == (q > 0):
            return (left, (avg * abs(held) + price * abs(q)) / abs(left) if left else 0.0, n), []
        shut, entry = min(abs(q), abs(held)), avg
        pnl = (price - avg) * shut * (1 if held > 0 else -1)
        if abs(left) <= 1e-4:
            left, avg = 0.0, 0.0
        elif (left > 0) != (held > 0):
            avg = price
        return (left, avg, n + 1), [(f["symbol"], n, f["ts"], shut, entry, price, pnl, pnl / (entry * shut) if entry * shut else None)]

    schema = f"symbol {kind(fills, 'symbol')}, n int, ts {kind(fills, 'ts')}, quantity double, entry double, exit double, pnl double, pnl_pct double"
    return fold(fills, ("symbol",), ("ts", "seq"), lambda: (0.0, 0.0, 0), step, schema)


def positions(fills: DataFrame) -> DataFrame:
    """Per fill (symbol, ts, seq, side, quantity, price) the position after it: quantity, average entry price, realised profit so far.

    The live ledger's rule: a buy averages into a long position and else sets the price; a sell realises what it closes of a
    long position, and leaves the price.
    """

    def step(state, f):
        held, avg, gain = state
        q, price = float(f["quantity"]), f["price"]
        if f["side"] == "buy":
            avg = (avg * held + price * q) / (held + q) if held > 0 else price
            held += q
        else:
            gain += (price - avg) * min(q, held) if held > 0 else 0.0
            held -= q
        return (held, avg, gain), [(f["symbol"], f["ts"], f["seq"], held, avg, gain)]

    schema = f"symbol {kind(fills, 'symbol')}, ts {kind(fills, 'ts')}, seq {kind(fills, 'seq')}, quantity double, avg_price double, realised double"
    return fold(fills, ("symbol",), ("ts", "seq"), lambda: (0.0, 0.0, 0.0), step, schema)


def marked(held: DataFrame, prices: DataFrame) -> DataFrame:
    """Positions (symbol, quantity, avg_price) at prices (symbol, price): market value, cost basis, unrealised profit."""
    x = held.join(prices.select("symbol", "price"), "symbol", "left")
    q = F.col("quantity")
    return x.select(*held.columns, "price", (F.abs(q) * F.col("price")).alias("market_value"), (F.abs(q) * F.col("avg_price")).alias("cost_basis"), ((F.col("price") - F.col("avg_price")) * q).alias("unrealised"))


def strategy_exposure(fills: DataFrame, prices: DataFrame) -> DataFrame:
    """(strategy, exposure): the strategies' net quantities per symbol, absolute, at prices."""
    signed = F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))
    held = fills.groupBy("strategy", "symbol").agg(F.sum(signed).alias("quantity"))
    return held.join(prices.select("symbol", "price"), "symbol").groupBy("strategy").agg(F.sum(F.abs(F.col("quantity") * F.col("price"))).alias("exposure"))


class BarStrategy:
    """What a bar-by-bar strategy may define; run_on_bar makes a new one for each symbol, so nothing is left of the last run."""

    def on_bar(self, bar: dict, position: float, cash: float) -> tuple[str, float] | None:
        raise NotImplementedError

    def on_fill(self, fill: dict) -> None:
        pass


class _Plain(BarStrategy):
    def __init__(self, f):
        self.on_bar = f


def run_on_bar(bars: DataFrame, strategy: Callable, capital: float = 100_000.0, config: EngineConfig | None = None) -> DataFrame:
    """(symbol, ts, cash, position, equity) after each bar of the general fold.

    strategy: a BarStrategy class (or what makes one), or a function on_bar(bar, position, cash) -> (side, quantity) or None.
    Market orders fill at the next bar's open with the configuration's slippage and commission.
    """
    config = config or EngineConfig()
    slippage, commission = config.slippage, config.commission
    make = strategy if isinstance(strategy, type) else lambda: _Plain(strategy)

    def step(state, bar):
        cash, held, waiting, own = state
        if waiting:
            side, q = waiting
            price, fee, slip = broker_fill(side, q, bar["open"], bar["volume"], slippage, commission)
            cash, held = (cash - (q * price + fee), held + q) if side == "buy" else (cash + (q * price - fee), held - q)
            own.on_fill({"symbol": bar["symbol"], "ts": bar["ts"], "side": side, "quantity": q, "price": price, "commission": fee, "slippage": slip})
        waiting = own.on_bar(bar, held, cash)
        return (cash, held, waiting, own), [(bar["symbol"], bar["ts"], cash, held, cash + held * bar["close"])]

    schema = f"symbol {kind(bars, 'symbol')}, ts {kind(bars, 'ts')}, cash double, position double, equity double"
    return fold(bars, ("symbol",), ("ts",), lambda: (float(capital), 0.0, None, make()), step, schema)


def exposure(positions: DataFrame) -> DataFrame:
    """Gross and net exposure and number of positions (symbol, quantity, price), in all."""
    v = F.col("quantity") * F.col("price")
    return positions.agg(F.sum(F.abs(v)).alias("gross"), F.sum(v).alias("net"), F.count_if(F.col("quantity") != 0).alias("open_positions"))


def flatten(positions: DataFrame, share: float = 1.0) -> DataFrame:
    """Orders that close `share` of every open position."""
    return positions.where("quantity <> 0").select("symbol", F.when(F.col("quantity") > 0, "sell").otherwise("buy").alias("side"), (F.abs("quantity") * share).alias("quantity"))
