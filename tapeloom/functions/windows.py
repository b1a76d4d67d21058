"""Window helpers: rolling statistics that are null until the window is full, ranks with average ties, look-ahead checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

td = F.try_divide


def ordered(*keys: str, by: str = "ts") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(by)


def last_rows(n: int, *keys: str, by: str = "ts") -> WindowSpec:
    return ordered(*keys, by=by).rowsBetween(-(n - 1), 0)


def so_far(*keys: str, by: str = "ts") -> WindowSpec:
    return ordered(*keys, by=by).rowsBetween(Window.unboundedPreceding, 0)


def row_index(*keys: str, by: str = "ts") -> Column:
    return F.row_number().over(ordered(*keys, by=by)) - 1


def rolling(agg: Column, of: Column, n: int, *keys: str, by: str = "ts") -> Column:
    """agg over the last n rows, null until n values of `of` are there."""
    w = last_rows(n, *keys, by=by)
    return F.when(F.count(of).over(w) == n, agg.over(w))


def simple_return(price: Column, *keys: str, by: str = "ts") -> Column:
    before = F.lag(price).over(ordered(*keys, by=by))
    return td(price - before, before)


def delta(x: Column, d: int, *keys: str, by: str = "ts") -> Column:
    return x - F.lag(x, d).over(ordered(*keys, by=by))


def delay(x: Column, d: int, *keys: str, by: str = "ts") -> Column:
    return F.lag(x, d).over(ordered(*keys, by=by))


def ts_sum(x, d, *k, by="ts"):
    return rolling(F.sum(x), x, d, *k, by=by)


def ts_mean(x, d, *k, by="ts"):
    return rolling(F.avg(x), x, d, *k, by=by)


def ts_std(x, d, *k, by="ts"):
    return rolling(F.stddev_samp(x), x, d, *k, by=by)


def ts_max(x, d, *k, by="ts"):
    return rolling(F.max(x), x, d, *k, by=by)


def ts_min(x, d, *k, by="ts"):
    return rolling(F.min(x), x, d, *k, by=by)


def ts_argmax(x, d, *k, by="ts"):
    """Offset of the first largest value from the window's start."""
    w = last_rows(d, *k, by=by)
    return F.when(F.count(x).over(w) == d, F.array_position(F.collect_list(x).over(w), F.max(x).over(w)) - 1)


def ts_argmin(x, d, *k, by="ts"):
    w = last_rows(d, *k, by=by)
    return F.when(F.count(x).over(w) == d, F.array_position(F.collect_list(x).over(w), F.min(x).over(w)) - 1)


def ts_corr(x, y, d, *k, by="ts"):
    """Pearson's correlation; null where one of the two doesn't vary."""
    w, both = last_rows(d, *k, by=by), F.when(x.isNotNull() & y.isNotNull(), x)
    value = td(F.covar_pop(x, y).over(w), F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w))
    return F.when(F.count(both).over(w) == d, value)


def ts_cov(x, y, d, *k, by="ts"):
    return rolling(F.covar_samp(x, y), F.when(x.isNotNull() & y.isNotNull(), x), d, *k, by=by)


def ts_rank(x, d, *k, by="ts"):
    """Average rank of the last value among the window's, over d."""
    w = last_rows(d, *k, by=by)
    seen = F.collect_list(x).over(w)
    less = F.size(F.filter(seen, lambda v: v < F.element_at(seen, -1)))
    same = F.size(F.filter(seen, lambda v: v == F.element_at(seen, -1)))
    return F.when((F.count(x).over(w) == d) & x.isNotNull(), (less + (same + 1) / 2) / d)


def pct_rank(x: Column, *keys: str) -> Column:
    """Rank within a cross-section, average ties, over the number of values; null where x is null."""
    below = Window.partitionBy(*keys).orderBy(x.asc_nulls_last())
    peers = Window.partitionBy(*keys, x)
    every = Window.partitionBy(*keys)
    return F.when(x.isNotNull(), td(F.rank().over(below) + (F.count(x).over(peers) - 1) / 2, F.count(x).over(every)))


def zscore(x: Column, *keys: str) -> Column:
    every = Window.partitionBy(*keys)
    return td(x - F.avg(x).over(every), F.stddev_samp(x).over(every))


def forward_fill(x: Column, *keys: str, by: str = "ts") -> Column:
    return F.last(x, ignorenulls=True).over(so_far(*keys, by=by))


class LookaheadError(ValueError):
    """An expression reads rows that come later than its own."""


def forbid_lookahead(expression: Column) -> Column:
    """The expression, unless its text shows a lead, a negative lag or a frame that ends after the current row."""
    text = str(expression).lower()
    frames = re.findall(r"(?:rows|range) between .*? and (\w+) following", text)
    if re.search(r"\blead\(|lag\([^()]*, -\d", text) or frames:
        raise LookaheadError(f"looks ahead: {text[:200]}")
    return expression
