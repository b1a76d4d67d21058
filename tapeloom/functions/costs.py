"""Execution-cost models as column expressions, in three families that differ on purpose.

bar_*: of the vectorised backtest, on changes of the position as a fraction. broker_*: of the simulated broker, slippage as
a fraction and commission in money. model_*: stand-alone models per share or per trade, also reached by name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeloom.functions.windows import td


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def bar_slippage(change: Column, volume: Column, model: str = "volume_dependent", bps: float = 5.0, impact: float = 0.1) -> Column:
    if model == "volume_dependent":
        return F.lit(float(impact)) * F.sqrt(F.abs(change) / F.greatest(volume.cast("double"), F.lit(1.0)))
    return F.abs(change) * F.lit(float(bps)) / F.lit(10000.0)


def bar_commission(change: Column, price: Column, per_share: float = 0.005) -> Column:
    return td(F.abs(change) * F.lit(float(per_share)), price)


def broker_slippage(quantity: Column, volume: Column, model: str = "volume_dependent", bps: float = 5.0, impact: float = 0.1) -> Column:
    share = quantity / F.greatest(volume.cast("double"), F.lit(1.0))
    if model == "volume_dependent":
        return F.lit(float(impact)) * F.sqrt(share) + F.lit(float(bps)) / F.lit(10000.0)
    if model == "almgren_chriss":
        return F.lit(0.01) * F.lit(0.02) * share + F.lit(0.1) * F.lit(0.02) * F.sqrt(share)
    return F.lit(float(bps)) / F.lit(10000.0)


def fill_price(side: Column, price: Column, slippage: Column) -> Column:
    return F.when(side == "buy", price * (1 + slippage)).otherwise(price * (1 - slippage))


def broker_commission(quantity: Column, value: Column, model: str = "tiered", minimum: float = 1.0, per_share: float = 0.005, max_pct: float = 0.01) -> Column:
    if model == "zero":
        return F.lit(0.0)
    if model == "per_share":
        return F.greatest(F.lit(float(minimum)), F.least(quantity * F.lit(float(per_share)), value * F.lit(float(max_pct))))
    if model == "percentage":
        return value * F.lit(float(per_share))
    if model == "tiered":
        rate = F.greatest(F.lit(0.0035), F.least(F.lit(0.005), td(F.lit(1.0), quantity)))
        return F.greatest(F.lit(0.35), F.least(rate * quantity, value * F.lit(0.01)))
    return F.lit(float(minimum))


def broker_fill(side: str, quantity: float, price: float, volume: float, slippage, commission) -> tuple[float, float, float]:
    """Fill price, fee and slippage in money of one order, as broker_slippage and broker_commission have them, for folds."""
    share = quantity / max(float(volume), 1.0)
    base = slippage.base_bps / 10000.0
    slip = {"volume_dependent": slippage.impact_factor * math.sqrt(share) + base, "almgren_chriss": 0.01 * 0.02 * share + 0.1 * 0.02 * math.sqrt(share)}.get(slippage.model, base)
    paid = price * (1 + slip) if side == "buy" else price * (1 - slip)
    value, c = quantity * paid, commission
    if c.model == "tiered":
        fee = max(0.35, min(max(0.0035, min(0.005, 1.0 / quantity)) * quantity, value * 0.01))
    else:
        fee = {"zero": 0.0, "per_share": max(c.min_commission, min(quantity * c.per_share, value * c.max_pct)), "percentage": value * c.per_share}.get(c.model, c.min_commission)
    return paid, fee, slip * price * quantity


# Stand-alone slippage, per share.


def model_fixed(price, quantity, volume, volatility, bps: float = 5.0):
    return price * F.lit(float(bps)) / F.lit(10000.0)


def model_percentage(price, quantity, volume, volatility, pct: float = 0.001):
    return price * F.lit(float(pct))


def model_volume(price, quantity, volume, volatility, bps: float = 5.0, impact: float = 0.1):
    hit = F.when(volume > 0, price * F.lit(float(impact)) * F.sqrt(td(quantity, volume))).otherwise(0.0)
    return price * F.lit(float(bps)) / F.lit(10000.0) + hit


def model_almgren_chriss(price, quantity, volume, volatility, eta: float = 0.01, gamma: float = 0.1):
    share = td(quantity, volume)
    full = price * (F.lit(float(eta)) * volatility * share + F.lit(float(gamma)) * volatility * F.sqrt(share))
    return F.when((volume <= 0) | (volatility <= 0), price * F.lit(0.0005)).otherwise(full)


def model_spread(price, quantity, volume, volatility, half_spread_bps: float = 2.5):
    return price * F.lit(float(half_spread_bps)) / F.lit(10000.0)


SLIPPAGE_MODELS = {
    "fixed": model_fixed, "percentage": model_percentage, "volume": model_volume, "volume_dependent": model_volume, "almgren_chriss": model_almgren_chriss, "spread": model_spread,
}


def slippage(name: str, price: Column, quantity: Column, volume: Column, volatility: Column, **options: float) -> Column:
    if name.lower() not in SLIPPAGE_MODELS:
        raise ValueError(f"unknown slippage model {name!r}; one of {sorted(SLIPPAGE_MODELS)}")
    return SLIPPAGE_MODELS[name.lower()](price, quantity, volume, volatility, **options)


def apply_slippage(side: Column, price: Column, per_share: Column) -> Column:
    return F.when(side == "buy", price + per_share).otherwise(price - per_share)


# Stand-alone commissions, per trade.


def trade_value(shares: Column, price: Column, value: Column | None = None) -> Column:
    own = shares * price
    return own if value is None else F.when(value == 0, own).otherwise(value)


def model_zero(shares, value):
    return F.lit(0.0)


def model_fixed_fee(shares, value, amount: float = 5.0):
    return F.lit(float(amount))


def model_per_share(shares, value, per_share: float = 0.005, minimum: float = 1.0, max_pct: float = 0.01):
    return F.least(F.greatest(shares * F.lit(float(per_share)), F.lit(float(minimum))), value * F.lit(float(max_pct)))


def model_percentage_fee(shares, value, pct: float = 0.001, minimum: float = 0.0):
    return F.greatest(value * F.lit(float(pct)), F.lit(float(minimum)))


def model_tiered(shares, value):
    rate = F.greatest(F.lit(0.0035), F.least(F.lit(0.005), td(F.lit(1.0), shares)))
    return F.when(shares <= 0, 0.0).otherwise(F.least(F.greatest(rate * shares, F.lit(0.35)), value * F.lit(0.01)))


def model_crypto(shares, value, maker: float = 0.001, taker: float = 0.002, is_taker: bool = True):
    return value * F.lit(float(taker if is_taker else maker))


COMMISSION_MODELS = {
    "zero": model_zero, "alpaca": model_zero, "fixed": model_fixed_fee, "per_share": model_per_share, "percentage": model_percentage_fee, "tiered": model_tiered, "ibkr": model_tiered, "crypto": model_crypto,
}
#: Fees of crypto tiers.
CRYPTO_TIERS = {"vip": 0.0002, "standard": 0.001, "retail": 0.002}


def commission(name: str, shares: Column, value: Column, **options: float) -> Column:
    if name.lower() not in COMMISSION_MODELS:
        raise ValueError(f"unknown commission model {name!r}; one of {sorted(COMMISSION_MODELS)}")
    return COMMISSION_MODELS[name.lower()](shares, value, **options)


def crypto_fee(tier: Column, value: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in CRYPTO_TIERS.items() for x in pair])
    return value * F.coalesce(known[tier], F.lit(CRYPTO_TIERS["standard"]))


# Trades of a learning agent's environment.


def environment_trade(change: Column, value: Column, price: Column, slippage: float = 0.0005, cost: float = 0.001, least: float = 0.001) -> tuple[Column, Column]:
    """Shares bought (negative: sold) and cash paid for a change of weight: slippage against the trade, a fee on its value; none below `least`."""
    worth = F.when(F.abs(change) < least, 0.0).otherwise(change * value)
    shares = td(worth, price)
    paid = F.when(shares > 0, price * F.lit(1 + slippage)).otherwise(price * F.lit(1 - slippage))
    return shares, shares * paid + F.abs(worth) * F.lit(cost)


def funding(exposure: Column, leverage: float, rate: float = 0.0001) -> Column:
    """The cost of holding a leveraged position for a step."""
    return F.abs(exposure) * F.lit(rate if leverage > 1 else 0.0)
