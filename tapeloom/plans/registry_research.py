"""Queries of factor research, risk, portfolios, execution, text and streaming; see registry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.functions import costs
from tapeloom.functions import windows as w
from tapeloom.operators import drawdown, execution, factors, orders, portfolio, risk, text
from tapeloom.plans.registry import _ACCOUNT, PANEL, READY, SQL, TRADES, WEEKLY, _account, _curve, _panel, _returns, cut, q, qs, query
from tapeloom.session import shared_place
from tapeloom.sources import bars

_P = f"{PANEL}, r AS (SELECT *, (high + low + close) / 3 AS vwap, (close - lag(close) OVER (PARTITION BY symbol ORDER BY ts)) / lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS ret FROM bars)"


def _rank(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY ts ORDER BY {x} ASC NULLS LAST) + (count({x}) OVER (PARTITION BY ts, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY ts) END"


def _roll(agg: str, x: str, n: int) -> str:
    o = f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {o} = {n} THEN {agg} OVER {o} END"


def _lag(x: str, n: int) -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY symbol ORDER BY ts)"


def _corr(a: str, b: str, both: str, n: int) -> str:
    o = f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({both}) OVER {o} = {n} THEN covar_pop({a}, {b}) OVER {o} / nullif(stddev_pop({a}) OVER {o} * stddev_pop({b}) OVER {o}, 0) END"


_ALPHA_SQL = {
    "alpha_002": f"a AS (SELECT *, CAST(ln(volume) AS DOUBLE) AS lv FROM r), b AS (SELECT *, lv - {_lag('lv', 2)} AS d2, (close - open) / open AS oc FROM a), c AS (SELECT *, {_rank('d2')} AS ra, {_rank('oc')} AS rb FROM b), d AS (SELECT *, CASE WHEN ra IS NOT NULL AND rb IS NOT NULL THEN ra END AS pair FROM c) SELECT symbol, ts, -1 * {_corr('ra', 'rb', 'pair', 6)} AS v FROM d",
    "alpha_003": f"a AS (SELECT *, {_rank('open')} AS ra, {_rank('volume')} AS rb FROM r) SELECT symbol, ts, -1 * {_corr('ra', 'rb', 'ra', 10)} AS v FROM a",
    "alpha_005": f"a AS (SELECT *, open - {_roll('avg(vwap)', 'vwap', 10)} AS x, close - vwap AS y FROM r), b AS (SELECT *, {_rank('x')} AS rx, {_rank('y')} AS ry FROM a) SELECT symbol, ts, rx * (-1 * abs(ry)) AS v FROM b",
    "alpha_006": f"SELECT symbol, ts, -1 * {_corr('open', 'volume', 'open', 10)} AS v FROM r",
    "alpha_042": f"a AS (SELECT *, vwap - close AS x, vwap + close AS y FROM r), b AS (SELECT *, {_rank('x')} AS rx, {_rank('y')} AS ry FROM a) SELECT symbol, ts, rx / ry AS v FROM b",
    "alpha_053": f"a AS (SELECT *, ((close - low) - (high - close)) / nullif(close - low, 0) AS x FROM r) SELECT symbol, ts, -1 * (x - {_lag('x', 9)}) AS v FROM a",
    "alpha_101": "SELECT symbol, ts, (close - open) / ((high - low) + CAST(0.001 AS DOUBLE)) AS v FROM r",
    "alpha_004": f"a AS (SELECT *, {_rank('low')} AS x FROM r), b AS (SELECT *, list(x) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS l FROM a) SELECT symbol, ts, CASE WHEN len(l) = 9 THEN -1 * (len(list_filter(l, lambda z: z < x)) + (len(list_filter(l, lambda z: z = x)) + 1) / 2.0) / 9 END AS v FROM b",
    "alpha_001": f"a AS (SELECT *, CASE WHEN ret < 0 THEN {_roll('stddev_samp(ret)', 'ret', 20)} ELSE close END AS x FROM r), b AS (SELECT *, sign(x) * pow(abs(x), 2) AS p FROM a), c AS (SELECT *, list(p) OVER o AS l, count(p) OVER o AS n FROM b WINDOW o AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)), d AS (SELECT *, CASE WHEN n = 5 THEN list_position(l, list_max(l)) - 1 END AS am FROM c) SELECT symbol, ts, {_rank('am')} - 0.5 AS v FROM d",
    "momentum_12m_1m": f"a AS (SELECT *, {_lag('ret', 21)} AS d FROM r) SELECT symbol, ts, {_roll('sum(d)', 'd', 231)} AS v FROM a",
    "reversal_5d": f"SELECT symbol, ts, -1 * {_roll('sum(ret)', 'ret', 5)} AS v FROM r",
    "volume_momentum": f"SELECT symbol, ts, {_roll('avg(volume)', 'volume', 5)} / {_roll('avg(volume)', 'volume', 20)} - 1 AS v FROM r",
    "price_range": f"SELECT symbol, ts, ({_roll('max(high)', 'high', 20)} - {_roll('min(low)', 'low', 20)}) / close AS v FROM r",
    "overnight_return": f"SELECT symbol, ts, open / {_lag('close', 1)} - 1 AS v FROM r",
}


def _split(name: str) -> tuple[str, str]:
    head, _, tail = _ALPHA_SQL[name].rpartition(" SELECT symbol, ts, ") if " SELECT symbol, ts, " in _ALPHA_SQL[name] else ("", "", _ALPHA_SQL[name].removeprefix("SELECT symbol, ts, "))
    return head, tail


_W = _P.replace(PANEL, WEEKLY)
for _name in _ALPHA_SQL:
    _custom = _name in factors.CUSTOM  # these reach back a year of bars, so they take the longer series
    _head, _tail = _split(_name)
    _key = f"factor_{_name}" if _custom else _name
    query(_key, f"WITH {_W if _custom else _P}, {_head + ',' if _head else ''} z AS (SELECT symbol, ts, {_tail}) SELECT symbol, ts, {q('v', 'value')} FROM z")(
        lambda spark, sf, f=(factors.ALPHAS | factors.CUSTOM)[_name], source=bars.weekly if _custom else _panel: cut(factors.factor(source(spark, sf), f))
    )


@query("factor_rank", f"WITH {_P}, z AS (SELECT symbol, ts, {_rank('ret')} AS value FROM r) SELECT symbol, ts, {qs('value')} FROM z")
def _(spark, sf):
    return cut(factors.factor(_panel(spark, sf), "rank(returns)"))


@query("factor_zscore", f"WITH {_P}, z AS (SELECT symbol, ts, (close - avg(close) OVER o) / nullif(stddev_samp(close) OVER o, 0) AS value FROM r WINDOW o AS (PARTITION BY ts)) SELECT symbol, ts, {qs('value')} FROM z")
def _(spark, sf):
    return cut(factors.factor(_panel(spark, sf), "zscore(close)"))


_IC = f"""WITH {_P}, f AS (SELECT symbol, ts, -1 * (close / {_lag('close', 1)} - 1) AS value, lead(close) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 AS fwd FROM r), n AS (SELECT * FROM f WHERE value IS NOT NULL AND fwd IS NOT NULL),
k AS (SELECT *, {_rank('value')} AS ra, {_rank('fwd')} AS rb FROM n), ic AS (SELECT ts, corr(ra, rb) AS ic FROM k GROUP BY ts)"""


def _ic(spark, sf):
    p = _panel(spark, sf)
    return factors.ic(factors.factor(p, "-1 * (close / delay(close, 1) - 1)"), factors.forward_return(p))


@query("factor_ic", f"{_IC} SELECT ts, {qs('ic')} FROM ic")
def _(spark, sf):
    return cut(_ic(spark, sf))


@query(
    "ic_summary",
    f"""{_IC}, g AS (SELECT count(*) AS n, avg(ic) AS mean_ic, stddev_samp(ic) AS std_ic, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS pct_positive FROM ic WHERE ic IS NOT NULL AND NOT isnan(ic))
    SELECT n, {qs('mean_ic', 'std_ic')}, {q('mean_ic / std_ic', 'ir')}, {q('pct_positive')}, {q('mean_ic / std_ic * sqrt(n)', 't_stat')}, abs(mean_ic / std_ic * sqrt(n)) > 2 AS significant FROM g""",
)
def _(spark, sf):
    return cut(factors.ic_summary(_ic(spark, sf)))


_H = (1, 2, 3, 5, 10, 20, 40, 60)


@query(
    "factor_decay",
    f"WITH {_P}, f AS (SELECT symbol, ts, close, -1 * (close / {_lag('close', 1)} - 1) AS value FROM r), h AS ("
    + " UNION ALL ".join(f"SELECT symbol, ts, value, {h} AS horizon, lead(close, {h}) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 AS fwd FROM f" for h in _H)
    + f"""), n AS (SELECT * FROM h WHERE value IS NOT NULL AND fwd IS NOT NULL), k AS (SELECT *, rank() OVER (PARTITION BY ts, horizon ORDER BY value) + (count(*) OVER (PARTITION BY ts, horizon, value) - 1) / 2.0 AS ra,
    rank() OVER (PARTITION BY ts, horizon ORDER BY fwd) + (count(*) OVER (PARTITION BY ts, horizon, fwd) - 1) / 2.0 AS rb FROM n), ic AS (SELECT ts, horizon, corr(ra, rb) AS ic FROM k GROUP BY 1, 2),
    g AS (SELECT horizon, avg(ic) AS mean_ic, stddev_samp(ic) AS s FROM ic WHERE ic IS NOT NULL AND NOT isnan(ic) GROUP BY 1) SELECT horizon, {q('mean_ic')}, {q('mean_ic / s', 'ir')} FROM g""",
)
def _(spark, sf):
    p = _panel(spark, sf)
    return cut(factors.decay(p, factors.factor(p, "-1 * (close / delay(close, 1) - 1)")))


@query(
    "multiple_testing",
    """WITH p AS (SELECT concat('F', CAST(p_partkey AS VARCHAR)) AS name, CAST((p_partkey * 7919) % 1000 + 1 AS DOUBLE) / 20000 AS p FROM part), k AS (SELECT *, CAST(row_number() OVER (ORDER BY p, name) AS INTEGER) AS rank, count(*) OVER () AS m FROM p),
    h AS (SELECT *, p <= 0.05 / (m - rank + 1) AS h0, max(CASE WHEN p <= 0.05 * rank / m THEN rank END) OVER () AS reach FROM k)
    SELECT name, p, rank, p <= 0.05 / m AS bonferroni, bool_and(h0) OVER (ORDER BY p, name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS holm, coalesce(rank <= reach, false) AS bh FROM h""",
)
def _(spark, sf):
    k = F.col("p_partkey")
    t = spark.read.parquet(f"{sf}/part.parquet").select(F.concat(F.lit("F"), k.cast("string")).alias("name"), (((k * 7919) % 1000 + 1).cast("double") / 20000).alias("p"))
    return factors.multiple_testing(t)


@query(
    "factor_equal_weight",
    f"""WITH {_P}, z AS (SELECT symbol, ts, (close - avg(close) OVER o) / nullif(stddev_samp(close) OVER o, 0) AS a, (volume - avg(volume) OVER o) / nullif(stddev_samp(volume) OVER o, 0) AS b FROM r WINDOW o AS (PARTITION BY ts))
    SELECT symbol, ts, {q('CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE (coalesce(a, 0.0) + coalesce(b, 0.0)) / ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT) END', 'combined')} FROM z""",
)
def _(spark, sf):
    return cut(factors.equal_weight(_panel(spark, sf), "close", "volume"))


_TWO = """x AS (SELECT symbol, ts, volume AS rg, -ret AS tn, lead(close) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 AS fwd FROM r),
  l AS (SELECT symbol, ts, fwd, 'size' AS factor, rg AS value FROM x UNION ALL SELECT symbol, ts, fwd, 'turn', tn FROM x), z AS (SELECT *, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS z FROM l WINDOW w AS (PARTITION BY ts, factor)),
  n AS (SELECT * FROM l WHERE value IS NOT NULL AND fwd IS NOT NULL), k AS (SELECT *, rank() OVER (PARTITION BY ts, factor ORDER BY value) + (count(*) OVER (PARTITION BY ts, factor, value) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY ts, factor ORDER BY fwd) + (count(*) OVER (PARTITION BY ts, factor, fwd) - 1) / 2.0 AS b FROM n), ic AS (SELECT ts, factor, corr(a, b) AS ic FROM k GROUP BY 1, 2)"""


def _two(spark, sf):
    """Two factors and the forward return."""
    p = factors.ready(_panel(spark, sf)).withColumn("size", F.col("volume").cast("double")).withColumn("turn", -F.col("ret"))
    return p, factors.forward_return(p)


@query(
    "factor_ic_weighted",
    f"""WITH {_P}, {_TWO}, j AS (SELECT d.ts, d.factor, CASE WHEN NOT isnan(ic) THEN ic END AS ic, row_number() OVER (PARTITION BY d.factor ORDER BY d.ts) AS rn FROM (SELECT DISTINCT ts, factor FROM l) d LEFT JOIN ic USING (ts, factor)),
    rw AS (SELECT *, greatest(coalesce(avg(ic) OVER (PARTITION BY factor ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), 0.0), 0.0) AS raw FROM j),
    wt AS (SELECT ts, factor, CASE WHEN rn > 24 AND sum(raw) OVER (PARTITION BY ts) > 0 THEN raw / sum(raw) OVER (PARTITION BY ts) ELSE 0.5 END AS weight FROM rw), o AS (SELECT symbol, ts, coalesce(sum(z * weight), 0.0) AS combined FROM z JOIN wt USING (ts, factor) GROUP BY 1, 2)
    SELECT symbol, ts, {qs('combined')} FROM o""",
)
def _(spark, sf):
    return cut(factors.ic_weighted(*_two(spark, sf), ("size", "turn"), lookback=24))


@query(
    "factor_ridge",
    f"""WITH {_P}, {_TWO}, w AS (SELECT symbol, ts, max(z) FILTER (factor = 'size') AS a, max(z) FILTER (factor = 'turn') AS b, max(fwd) AS f FROM z GROUP BY 1, 2),
    c AS (SELECT count(*) * var_pop(a) + 0.01 AS aa, count(*) * var_pop(b) + 0.01 AS bb, count(*) * covar_pop(a, b) AS ab, count(*) * covar_pop(a, f) AS af, count(*) * covar_pop(b, f) AS bf FROM w WHERE a IS NOT NULL AND b IS NOT NULL AND f IS NOT NULL AND ts <= DATE '1999-12-31')
    SELECT symbol, ts, {q('coalesce(a, 0.0) * ((af * bb - bf * ab) / (aa * bb - ab * ab)) + coalesce(b, 0.0) * ((bf * aa - af * ab) / (aa * bb - ab * ab))', 'combined')} FROM w, c""",
)
def _(spark, sf):
    return cut(factors.ridge(*_two(spark, sf), ("size", "turn"), train_end="1999-12-31"))


_MODELS = "m AS (SELECT symbol, ts, tn AS m1, rg AS m2, tn + rg AS m3, fwd FROM x WHERE tn IS NOT NULL)"


def _models(spark, sf):
    p, forward = _two(spark, sf)
    return p.where("turn is not null").select("symbol", "ts", F.col("turn").alias("m1"), F.col("size").alias("m2"), (F.col("turn") + F.col("size")).alias("m3")), forward


@query("ensemble_average", f"WITH {_P}, {_TWO}, {_MODELS} SELECT symbol, ts, {q('(m1 + m2 + m3) / 3', 'combined')} FROM m")
def _(spark, sf):
    return cut(factors.ensemble(_models(spark, sf)[0], ("m1", "m2", "m3")))


_LONG = "g AS (SELECT symbol, ts, fwd, 'm1' AS model, m1 AS v FROM m UNION ALL SELECT symbol, ts, fwd, 'm2', m2 FROM m UNION ALL SELECT symbol, ts, fwd, 'm3', m3 FROM m)"


@query("ensemble_vote", f"WITH {_P}, {_TWO}, {_MODELS}, {_LONG}, h AS (SELECT symbol, ts, rank() OVER (PARTITION BY model ORDER BY v) + (count(*) OVER (PARTITION BY model, v) - 1) / 2.0 AS k FROM g), o AS (SELECT symbol, ts, avg(k) AS combined FROM h GROUP BY 1, 2) SELECT symbol, ts, {qs('combined')} FROM o")
def _(spark, sf):
    return cut(factors.ensemble(_models(spark, sf)[0], ("m1", "m2", "m3"), "vote"))


@query(
    "ensemble_weights",
    f"""WITH {_P}, {_TWO}, {_MODELS}, {_LONG}, h AS (SELECT ts, model, rank() OVER (PARTITION BY ts, model ORDER BY v) + (count(*) OVER (PARTITION BY ts, model, v) - 1) / 2.0 AS a, rank() OVER (PARTITION BY ts, model ORDER BY fwd) + (count(*) OVER (PARTITION BY ts, model, fwd) - 1) / 2.0 AS b FROM g WHERE fwd IS NOT NULL),
    i AS (SELECT ts, model, corr(a, b) AS ic FROM h GROUP BY 1, 2), o AS (SELECT model, greatest(avg(ic), 0.0) AS raw FROM i WHERE ic IS NOT NULL AND NOT isnan(ic) GROUP BY 1) SELECT model, {q('raw / nullif(sum(raw) OVER (), 0)', 'weight')} FROM o""",
)
def _(spark, sf):
    p, forward = _models(spark, sf)
    long = p.unpivot(["symbol", "ts"], ["m1", "m2", "m3"], "model", "v")
    return cut(factors.ensemble_weights(long, forward))


_DATED = f"{_IC}, p AS (SELECT ts, CASE WHEN NOT isnan(ic) THEN ic END AS ic, row_number() OVER (ORDER BY ts) - 1 AS pos, count(*) OVER () AS n FROM ic), fd AS (SELECT *, CAST(least(pos // (n // 5), 4) AS INTEGER) AS fold FROM p)"


@query(
    "factor_purged_cv",
    f"""{_DATED}, g AS (SELECT fold, first(n) AS n, count(*) AS test_days, min(pos) AS lo, max(pos) AS hi, avg(ic) AS test_ic, stddev_samp(ic) AS sd FROM fd GROUP BY 1)
    SELECT fold, CAST(n - test_days - least(lo, 5) - least(n - 1 - hi, 5) AS BIGINT) AS train_days, test_days, {qs('test_ic')}, {q('CASE WHEN sd > 0 THEN test_ic / sd ELSE 0.0 END', 'test_ir')} FROM g""",
)
def _(spark, sf):
    return cut(factors.dated_folds(_ic(spark, sf)))


_CPCV = f"""{_DATED}, s AS (SELECT fold, min(ts) AS a, max(ts) AS b FROM fd GROUP BY 1), c AS (SELECT concat(CAST(x.fold AS VARCHAR), ',', CAST(y.fold AS VARCHAR)) AS test_folds, x.fold AS f1, y.fold AS f2, x.a AS a1, x.b AS b1, y.a AS a2, y.b AS b2 FROM s x JOIN s y ON x.fold < y.fold),
    o AS (SELECT test_folds, avg(ic) FILTER (fold IN (f1, f2)) AS test_ic, stddev_samp(ic) FILTER (fold IN (f1, f2)) AS sd, count(*) FILTER (NOT (ts BETWEEN a1 - 5 AND b1 + 5) AND NOT (ts BETWEEN a2 - 5 AND b2 + 5)) AS train_days FROM fd, c GROUP BY 1)"""


@query("factor_cpcv", f"{_CPCV} SELECT test_folds, train_days, {qs('test_ic')}, {q('CASE WHEN sd > 0 THEN test_ic / sd ELSE 0.0 END', 'test_ir')} FROM o")
def _(spark, sf):
    return cut(factors.combinatorial_dated(_ic(spark, sf)))


@query("factor_cpcv_summary", f"{_CPCV}, u AS (SELECT avg(test_ic) AS mean_ic, stddev_pop(test_ic) AS std_ic, min(test_ic) AS min_ic, max(test_ic) AS max_ic, count(*) AS num_paths, avg(CASE WHEN test_ic > 0 THEN 1.0 ELSE 0.0 END) AS pct_positive FROM o) SELECT {qs('mean_ic', 'std_ic', 'min_ic', 'max_ic')}, num_paths, {qs('pct_positive')} FROM u")
def _(spark, sf):
    return cut(factors.combinatorial_summary(factors.combinatorial_dated(_ic(spark, sf))))


@query(
    "factor_walk_forward",
    f"""WITH {_P}, {_TWO}, dt AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos, count(*) OVER () AS nd FROM (SELECT DISTINCT ts FROM x)), v AS (SELECT symbol, ts, z, fwd, pos, nd FROM z JOIN dt USING (ts) WHERE factor = 'turn' AND z IS NOT NULL AND fwd IS NOT NULL),
    wn AS (SELECT v.*, CAST(k AS INTEGER) AS window_id, pos - k * 6 AS off FROM v, range(0, 100) t(k) WHERE k * 6 + 36 - 1 + 2 + 6 < nd AND pos BETWEEN k * 6 AND k * 6 + 36 + 2 + 6 - 1),
    ft AS (SELECT window_id, covar_pop(z, fwd) / nullif(var_pop(z), 0) AS slope, count(*) AS n_train, min(ts) AS train_start, max(ts) AS train_end FROM wn WHERE off < 36 GROUP BY 1),
    te AS (SELECT wn.window_id, wn.ts, wn.fwd, z * slope AS pr FROM wn JOIN ft USING (window_id) WHERE off >= 38), rk AS (SELECT *, rank() OVER (PARTITION BY window_id, ts ORDER BY pr) + (count(*) OVER (PARTITION BY window_id, ts, pr) - 1) / 2.0 AS a, rank() OVER (PARTITION BY window_id, ts ORDER BY fwd) + (count(*) OVER (PARTITION BY window_id, ts, fwd) - 1) / 2.0 AS b FROM te),
    dy AS (SELECT window_id, ts, corr(a, b) AS ic, count(*) AS n FROM rk GROUP BY 1, 2), ts_ AS (SELECT window_id, avg(CASE WHEN NOT isnan(ic) THEN ic END) AS ic, CAST(sum(n) AS BIGINT) AS n_test, min(ts) AS test_start, max(ts) AS test_end FROM dy GROUP BY 1)
    SELECT window_id, {qs('slope')}, n_train, n_test, train_start, train_end, test_start, test_end, {qs('ic')} FROM ft JOIN ts_ USING (window_id)""",
)
def _(spark, sf):
    return cut(factors.walk_forward_train(*_two(spark, sf), "turn", train=36, test=6, step=6, gap=2))


@query(
    "factor_significance",
    """WITH t AS (SELECT concat('F', CAST(p_partkey AS VARCHAR)) AS name, CAST((p_partkey * 7919) % 1201 - 600 AS DOUBLE) / 100 AS t FROM part),
    p AS (SELECT name, greatest(1 - sin(atan(abs(t) / sqrt(250.0))) * list_sum(list_transform(range(0, 125), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1.0) - 0.5 * ln(pi()) + 2 * j * ln(cos(atan(abs(t) / sqrt(250.0))))))), 0.0) AS p FROM t),
    r AS (SELECT name, floor(p * 1e9 + 0.5) / 1e9 AS p FROM p), k AS (SELECT *, count(*) OVER () AS m, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS last FROM r)
    SELECT name, floor(p * 1e6 + 0.5) / 1e6 AS p, p <= 0.05 / m AS bonferroni, coalesce(p <= max(CASE WHEN p <= 0.05 * last / m THEN p END) OVER (), false) AS bh FROM k""",
)
def _(spark, sf):
    """From t statistics to decisions; those of Bonferroni and Benjamini-Hochberg don't depend on how ties are ordered."""
    k = F.col("p_partkey")
    t = spark.read.parquet(f"{sf}/part.parquet").select(F.concat(F.lit("F"), k.cast("string")).alias("factor"), (((k * 7919) % 1201 - 600).cast("double") / 100).alias("t_stat"))
    p = t.select(F.col("factor").alias("name"), (F.floor(factors.student_p_column(F.col("t_stat")) * F.lit(1e9) + F.lit(0.5)) / F.lit(1e9)).alias("p"))
    return cut(factors.multiple_testing(p).select("name", "p", "bonferroni", "bh"))


@query(
    "rsi",
    f"""WITH {PANEL}, a AS (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS d FROM bars), b AS (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0.0) END AS up, CASE WHEN d IS NOT NULL THEN greatest(-d, 0.0) END AS dn FROM a),
    c AS (SELECT symbol, ts, {_roll('avg(up)', 'up', 14)} AS g, {_roll('avg(dn)', 'dn', 14)} AS l FROM b) SELECT symbol, ts, {q('100 - 100 / (1 + g / (l + CAST(1e-8 AS DOUBLE)))', 'rsi')} FROM c""",
)
def _(spark, sf):
    return cut(factors.rsi(_panel(spark, sf)))


@query("bollinger", f"WITH {PANEL}, a AS (SELECT symbol, ts, close, {_roll('avg(close)', 'close', 20)} AS m, {_roll('stddev_samp(close)', 'close', 20)} AS s FROM bars) SELECT symbol, ts, {q('(close - (m - 2.0 * s)) / (4.0 * s)', 'position')} FROM a")
def _(spark, sf):
    return cut(factors.bollinger(_panel(spark, sf)))


@query("atr", f"WITH {PANEL}, a AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM bars), b AS (SELECT symbol, ts, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM a), c AS (SELECT symbol, ts, {_roll('avg(tr)', 'tr', 14)} AS v FROM b) SELECT symbol, ts, {q('v', 'atr')} FROM c")
def _(spark, sf):
    return cut(factors.atr(_panel(spark, sf)))


@query(
    "macd",
    f"""WITH RECURSIVE {PANEL}, n AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM bars),
    e AS (SELECT symbol, ts, k, close AS f, close AS s, 0.0::DOUBLE AS g FROM n WHERE k = 1 UNION ALL SELECT symbol, ts, k, f, s, g * (1 - CAST(0.2 AS DOUBLE)) + (f - s) * CAST(0.2 AS DOUBLE) FROM (
    SELECT n.symbol, n.ts, n.k, e.f * (1 - CAST(2 AS DOUBLE) / 13) + n.close * (CAST(2 AS DOUBLE) / 13) AS f, e.s * (1 - CAST(2 AS DOUBLE) / 27) + n.close * (CAST(2 AS DOUBLE) / 27) AS s, e.g FROM e JOIN n ON n.symbol = e.symbol AND n.k = e.k + 1))
    SELECT symbol, ts, {q('f - s', 'macd')}, {q('g', 'signal')} FROM e""",
)
def _(spark, sf):
    return cut(factors.macd(_panel(spark, sf)))


@query("volume_ratio", f"WITH {PANEL}, a AS (SELECT symbol, ts, volume / {_roll('avg(volume)', 'volume', 20)} AS v FROM bars) SELECT symbol, ts, {q('v', 'volume_ratio')} FROM a")
def _(spark, sf):
    return cut(factors.volume_ratio(_panel(spark, sf)))


def _rsi_sql(n: int) -> str:
    return f"100 - 100 / (1 + {_roll('avg(up)', 'up', n)} / ({_roll('avg(dn)', 'dn', n)} + CAST(1e-8 AS DOUBLE)))"


_FEATURES = {"rev": f"-1 * (close / {_lag('close', 1)} - 1)", "rsi_5": _rsi_sql(5), "rsi_14": _rsi_sql(14), "volume_ratio_5": f"volume / {_roll('avg(volume)', 'volume', 5)}", "volume_ratio_14": f"volume / {_roll('avg(volume)', 'volume', 14)}"}


@query(
    "feature_store",
    f"""WITH {PANEL}, d AS (SELECT *, close - {_lag('close', 1)} AS d FROM bars), u AS (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0.0) END AS up, CASE WHEN d IS NOT NULL THEN greatest(-d, 0.0) END AS dn FROM d),
    f AS (SELECT symbol, ts, {', '.join(f'{x} AS {c}' for c, x in _FEATURES.items())} FROM u), l AS (SELECT symbol, ts, {', '.join(f'last_value({c} IGNORE NULLS) OVER o AS {c}' for c in _FEATURES)} FROM f WINDOW o AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    z AS (SELECT symbol, ts, {', '.join(f'({c} - avg({c}) OVER w) / (stddev_samp({c}) OVER w + CAST(1e-8 AS DOUBLE)) AS {c}' for c in _FEATURES)} FROM l WINDOW w AS (PARTITION BY ts)) SELECT symbol, ts, {qs(*_FEATURES)} FROM z""",
)
def _(spark, sf):
    return cut(factors.features(_panel(spark, sf), {"rev": "-1 * (close / delay(close, 1) - 1)"}, ("rsi", "volume_ratio"), (5, 14)))


@query("signal_blend", f"WITH {_P}, x AS (SELECT symbol, ts, 0.4::DOUBLE * coalesce(ret, 0.0) + 0.3::DOUBLE * ((high - low) / close) + 0.2::DOUBLE * (open / close) + 0.1::DOUBLE * (close / open) AS v FROM r) SELECT symbol, ts, {q('v', 'signal')} FROM x")
def _(spark, sf):
    p = factors.ready(_panel(spark, sf)).withColumn("a", F.col("ret")).withColumn("b", (F.col("high") - F.col("low")) / F.col("close")).withColumn("c", F.col("open") / F.col("close")).withColumn("d", F.col("close") / F.col("open"))
    return cut(factors.blend(p, {"a": 0.4, "b": 0.3, "c": 0.2, "d": 0.1}))


@query("factor_output", f"WITH {_P}, z AS (SELECT symbol, ts, {_rank('ret')} AS value FROM r) SELECT symbol, ts, {qs('value')} FROM z")
def _(spark, sf):
    """Written and read again."""
    path = shared_place(spark, "factors")
    factors.save(factors.factor(_panel(spark, sf), "rank(returns)"), path)
    return cut(spark.read.parquet(path).drop("year"))


# Risk.

_CUST = "c AS (SELECT c_custkey, c_acctbal + 20000 AS pv, CAST(10 + c_custkey % 90 AS DOUBLE) AS price, CAST(c_custkey % 10 AS DOUBLE) / 10 AS win, CAST(1 + c_custkey % 3 AS DOUBLE) AS wl, CAST(c_custkey % 21 - 10 AS DOUBLE) / 10 AS sig, CAST(1 + c_custkey % 40 AS DOUBLE) / 100 AS vol FROM customer)"


def _cust(spark, sf):
    k = F.col("c_custkey")
    return spark.read.parquet(f"{sf}/customer.parquet").select(
        "c_custkey", (F.col("c_acctbal") + 20000).alias("pv"), (10 + k % 90).cast("double").alias("price"), ((k % 10).cast("double") / 10).alias("win"), (1 + k % 3).cast("double").alias("wl"),
        ((k % 21 - 10).cast("double") / 10).alias("sig"), ((1 + k % 40).cast("double") / 100).alias("vol"),
    )


@query(
    "size_kelly",
    f"""WITH {_CUST}, f AS (SELECT *, least(greatest((win * wl - (1 - win)) / wl * CAST(0.25 AS DOUBLE), 0.0), CAST(0.1 AS DOUBLE)) AS b FROM c)
    SELECT c_custkey, CAST(floor(pv * (CASE WHEN b < 0.01 THEN 0.0 ELSE b END * abs(sig)) / price) * sign(sig) AS DOUBLE) AS shares FROM f""",
)
def _(spark, sf):
    return _cust(spark, sf).select("c_custkey", risk.kelly(F.col("win"), F.col("wl"), F.col("pv"), F.col("price"), F.col("sig")).cast("double").alias("shares"))


@query("size_fixed_fractional", f"WITH {_CUST} SELECT c_custkey, CAST(floor(least(pv * CAST(0.02 AS DOUBLE) / wl, pv * CAST(0.1 AS DOUBLE) / price)) AS BIGINT) AS shares FROM c")
def _(spark, sf):
    return _cust(spark, sf).select("c_custkey", risk.fixed_fractional(F.col("pv"), F.col("price"), F.col("wl")).cast("long").alias("shares"))


@query("size_vol_target", f"WITH {_CUST} SELECT c_custkey, CAST(floor(pv * (least(CAST(0.15 AS DOUBLE) / vol, CAST(0.25 AS DOUBLE)) * abs(sig)) / price) * sign(sig) AS DOUBLE) AS shares FROM c")
def _(spark, sf):
    return _cust(spark, sf).select("c_custkey", risk.volatility_target(F.col("pv"), F.col("price"), F.col("vol"), F.col("sig")).cast("double").alias("shares"))


@query("size_equal", f"WITH {_CUST} SELECT c_custkey, CAST(floor(pv * least(1.0 / (1 + c_custkey % 30), CAST(0.1 AS DOUBLE)) / price) AS BIGINT) AS shares FROM c")
def _(spark, sf):
    return _cust(spark, sf).select("c_custkey", risk.equal_weight(F.col("pv"), F.col("price"), 1 + F.col("c_custkey") % 30).cast("long").alias("shares"))


@query(
    "pre_trade_checks",
    """WITH o AS (SELECT o_orderkey, o_totalprice AS order_value, CAST(2000000 AS DOUBLE) AS portfolio_value, CAST(o_custkey % 20 AS DOUBLE) * 100000 AS exposure, o_orderkey % 120 AS orders_today, CAST(o_custkey % 9 - 7 AS DOUBLE) * 20000 AS daily_pnl FROM orders),
    x AS (SELECT o_orderkey, CASE WHEN order_value / portfolio_value > 0.10 THEN 'position limit' WHEN (exposure + order_value) / portfolio_value > 1.0 THEN 'exposure limit' WHEN orders_today >= 100 THEN 'order limit' WHEN -daily_pnl / portfolio_value > 0.03 THEN 'daily loss limit' END AS reason FROM o)
    SELECT o_orderkey, reason, reason IS NULL AS approved FROM x""",
)
def _(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(
        "o_orderkey", F.col("o_totalprice").alias("order_value"), F.lit(2e6).alias("portfolio_value"), ((F.col("o_custkey") % 20).cast("double") * 100000).alias("exposure"), (F.col("o_orderkey") % 120).alias("orders_today"),
        ((F.col("o_custkey") % 9 - 7).cast("double") * 20000).alias("daily_pnl"),
    )
    return risk.pre_trade(o).select("o_orderkey", "reason", "approved")


@query("derisk_schedule", f"WITH {WEEKLY}, d AS (SELECT symbol AS run_id, ts, 1 - close / max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x FROM bars) SELECT run_id, ts, CAST(CASE WHEN x < 0.05 THEN 1.0 WHEN x < 0.10 THEN 0.75 WHEN x < 0.15 THEN 0.5 WHEN x < 0.20 THEN 0.25 ELSE 0.0 END AS DOUBLE) AS share FROM d")
def _(spark, sf):
    fall = 1 - F.col("equity") / F.max("equity").over(w.so_far("run_id"))
    return _curve(spark, sf).select("run_id", "ts", risk.derisk(fall).alias("share"))


@query(
    "rolling_var",
    f"""WITH {WEEKLY}, {READY}, x AS (SELECT symbol AS run_id, ts, ret AS r FROM r WHERE ret IS NOT NULL), v AS (SELECT run_id, ts, CASE WHEN count(r) OVER o >= 20 THEN quantile_cont(r, 0.05) OVER o END AS var, list(r) OVER o AS l FROM x
    WINDOW o AS (PARTITION BY run_id ORDER BY ts ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)) SELECT run_id, ts, {q('var')}, {q('CASE WHEN var IS NOT NULL THEN list_avg(list_filter(l, lambda z: z <= var)) END', 'cvar')} FROM v""",
)
def _(spark, sf):
    return cut(risk.rolling_var(_returns(spark, sf)))


@query("var_alerts", f"""WITH {WEEKLY}, {READY}, x AS (SELECT symbol AS run_id, ts, ret AS r FROM r WHERE ret IS NOT NULL), v AS (SELECT run_id, ts, CASE WHEN count(r) OVER o >= 20 THEN quantile_cont(r, 0.05) OVER o END AS var FROM x
    WINDOW o AS (PARTITION BY run_id ORDER BY ts ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)) SELECT run_id, ts, {q('var')}, coalesce(abs(var) > 0.2, false) AS alert FROM v""")
def _(spark, sf):
    return cut(risk.var_alerts(_returns(spark, sf), limit=0.2).drop("cvar"))


@query("limit_utilisation", f"WITH {_CUST} SELECT c_custkey, {q('pv / (price * 500)', 'used')} FROM c")
def _(spark, sf):
    return cut(_cust(spark, sf).select("c_custkey", risk.utilisation(F.col("pv"), F.col("price") * 500).alias("used")))


@query(
    "risk_controls",
    f"""WITH {_CUST} SELECT c_custkey, CASE WHEN win * 0.3 >= 0.2 THEN 0.0 ELSE greatest(least(sig, 0.1::DOUBLE), -0.1::DOUBLE) * CASE WHEN vol < 0.05 THEN 1.0 WHEN vol < 0.10 THEN 0.75 WHEN vol < 0.15 THEN 0.5 WHEN vol < 0.20 THEN 0.25 ELSE 0.0 END END::DOUBLE AS share FROM c""",
)
def _(spark, sf):
    return _cust(spark, sf).select("c_custkey", risk.controls(F.col("sig"), F.col("vol"), F.col("win") * F.lit(0.3)).cast("double").alias("share"))


@query("rl_trade_costs", f"WITH {_CUST}, t AS (SELECT *, CASE WHEN abs(sig / 100) < 0.001 THEN 0.0 ELSE sig / 100 * pv END AS worth FROM c) SELECT c_custkey, {q('worth / price', 'shares')}, {q('worth / price * CASE WHEN worth / price > 0 THEN price * (1 + CAST(0.0005 AS DOUBLE)) ELSE price * (1 - CAST(0.0005 AS DOUBLE)) END + abs(worth) * CAST(0.001 AS DOUBLE)', 'paid')} FROM t")
def _(spark, sf):
    c = _cust(spark, sf)
    shares, paid = costs.environment_trade(F.col("sig") / 100, F.col("pv"), F.col("price"))
    return cut(c.select("c_custkey", shares.alias("shares"), paid.alias("paid")))


@query("action_directions", f"WITH {PANEL}, w AS (SELECT symbol, ts, exp(ln(close) / 5 - max(ln(close) / 5) OVER d) / sum(exp(ln(close) / 5)) OVER d * exp(max(ln(close) / 5) OVER d) AS w FROM bars WINDOW d AS (PARTITION BY ts)) SELECT symbol, ts, {q('w', 'weight')}, CASE WHEN w - 0.05 > 0.01 THEN 'BUY' WHEN w - 0.05 < -0.01 THEN 'SELL' ELSE 'HOLD' END AS direction FROM w")
def _(spark, sf):
    p = _panel(spark, sf).withColumn("weight", risk.softmax(F.ln("close") / 5, "ts"))
    return cut(p.select("symbol", "ts", "weight", risk.directions(F.col("weight"), F.lit(0.05)).alias("direction")))


@query(
    "reward_shaping",
    f"""WITH {WEEKLY}, p AS (SELECT symbol AS run_id, ts, close AS value, CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts) % 3 AS DOUBLE) AS position FROM bars), s AS (SELECT run_id, ts, value, (value - lag(value) OVER o) / (lag(value) OVER o + CAST(1e-8 AS DOUBLE)) AS r, abs(position - lag(position) OVER o) AS moved FROM p WINDOW o AS (PARTITION BY run_id ORDER BY ts)),
    t AS (SELECT * FROM s WHERE r IS NOT NULL), u AS (SELECT *, CASE WHEN count(r) OVER w >= 20 THEN stddev_pop(r) OVER w ELSE 0.0 END AS sd, (max(value) OVER c - value) / max(value) OVER c AS fall FROM t
    WINDOW w AS (PARTITION BY run_id ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), c AS (PARTITION BY run_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT run_id, ts, {q('r - 0.5 * sd - 2.0 * fall * fall - CAST(0.01 AS DOUBLE) * moved', 'reward')} FROM u""",
)
def _(spark, sf):
    b = bars.weekly(spark, sf)
    steps = b.select(F.col("symbol").alias("run_id"), "ts", F.col("close").alias("value"), ((w.row_index("symbol") + 1) % 3).cast("double").alias("position"))
    return cut(risk.shaped_reward(steps))


@query(
    "differential_sharpe",
    f"""WITH RECURSIVE {WEEKLY}, {READY}, x AS (SELECT symbol AS run_id, ts, ret AS r, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM r WHERE ret IS NOT NULL),
    e AS (SELECT run_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS DATE) AS ts, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS g FROM (SELECT DISTINCT run_id FROM x)
    UNION ALL SELECT x.run_id, x.k, x.ts, e.a + CAST(0.001 AS DOUBLE) * (x.r - e.a), e.b + CAST(0.001 AS DOUBLE) * (x.r * x.r - e.b),
      CASE WHEN e.b - e.a * e.a > 0 THEN (e.b * (x.r - e.a) - 0.5 * e.a * (x.r * x.r - e.b)) / pow(e.b - e.a * e.a, 1.5) ELSE 0.0 END FROM e JOIN x ON x.run_id = e.run_id AND x.k = e.k + 1) SELECT run_id, ts, {q('g', 'reward')} FROM e WHERE k > 0""",
)
def _(spark, sf):
    return cut(risk.differential_sharpe(_returns(spark, sf)))


# Portfolios.

_PRET = f"{PANEL}, {READY}, x AS (SELECT symbol, ts, ret AS r FROM r WHERE ret IS NOT NULL)"


def _pret(spark, sf):
    return factors.ready(_panel(spark, sf)).select("symbol", "ts", F.col("ret").alias("r")).where("r is not null")


@query("cov_matrix", f"WITH {_PRET}, g AS (SELECT p.symbol AS a, n.symbol AS b, covar_samp(p.r, n.r) AS cov FROM x p JOIN x n USING (ts) GROUP BY 1, 2) SELECT a, b, {qs('cov')} FROM g")
def _(spark, sf):
    return cut(portfolio.pairs(_pret(spark, sf)).select("a", "b", "cov"))


@query("corr_matrix", f"WITH {_PRET}, g AS (SELECT p.symbol AS a, n.symbol AS b, corr(p.r, n.r) AS corr FROM x p JOIN x n USING (ts) GROUP BY 1, 2) SELECT a, b, {qs('corr')} FROM g")
def _(spark, sf):
    return cut(portfolio.pairs(_pret(spark, sf)).select("a", "b", "corr"))


@query(
    "inverse_vol_weights",
    f"""WITH {_PRET}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM x), g AS (SELECT symbol, stddev_pop(r) AS sd, count(r) AS n FROM k WHERE k <= 60 GROUP BY 1), w AS (SELECT symbol, 1 / CASE WHEN n >= 60 AND sd > 0 THEN sd * sqrt(252.0) ELSE 0.2 END AS raw FROM g)
    SELECT symbol, {q('raw / sum(raw) OVER ()', 'weight')} FROM w""",
)
def _(spark, sf):
    return cut(portfolio.inverse_volatility(_pret(spark, sf)))


@query(
    "strategy_momentum_weights",
    f"""WITH {_PRET}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM x), g AS (SELECT symbol, CASE WHEN count(r) >= 63 THEN greatest(product(1 + r) - 1, 0.0) ELSE 0.0 END AS raw FROM k WHERE k <= 63 GROUP BY 1)
    SELECT symbol, {q('CASE WHEN sum(raw) OVER () > 0 THEN raw / sum(raw) OVER () ELSE 1.0 / count(*) OVER () END', 'weight')} FROM g""",
)
def _(spark, sf):
    return cut(portfolio.momentum_weights(_pret(spark, sf)))


@query("strategy_correlation", f"WITH {_PRET}, k AS (SELECT symbol, r, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM x), l AS (SELECT * FROM k WHERE k <= 60 AND n >= 60), g AS (SELECT p.symbol AS a, o.symbol AS b, corr(p.r, o.r) AS corr FROM l p JOIN l o USING (k) GROUP BY 1, 2) SELECT a, b, {qs('corr')} FROM g")
def _(spark, sf):
    return cut(portfolio.recent_correlation(_pret(spark, sf), "symbol"))


@query("strategy_equal_weights", "SELECT s_nationkey AS symbol, 1.0::DOUBLE / count(*) OVER () AS weight FROM supplier GROUP BY s_nationkey")
def _(spark, sf):
    return portfolio.equal_weights(spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_nationkey").alias("symbol")))


@query("rebalance_calendar", "WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) SELECT o_orderkey, DATE '2001-12-31' - d >= 1 AS daily, DATE '2001-12-31' - d >= 7 AS weekly, DATE '2001-12-31' - d >= 30 AS monthly, DATE '2001-12-31' - d >= 90 AS quarterly FROM o")
def _(spark, sf):
    d, today = F.col("o_orderdate").cast("date"), F.lit("2001-12-31").cast("date")
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", *[portfolio.due(d, today, rule).alias(rule) for rule in ("daily", "weekly", "monthly", "quarterly")])


@query("cost_aware_rebalance")
def _(spark, sf):
    """From equal weights to those in inverse proportion to volatility; held against a search in the tests."""
    names, cov = portfolio.matrix(portfolio.pairs(_pret(spark, sf)))
    target = {r["symbol"]: r["weight"] for r in portfolio.inverse_volatility(_pret(spark, sf)).collect()}  # one number per asset
    n = len(names)
    change = portfolio.cost_aware(portfolio.np.full(n, 1 / n), portfolio.np.array([target[x] for x in names]), cov, value=1.0)
    return portfolio.weights_frame(spark, names, change)


_NAT = "t AS (SELECT s_nationkey AS k, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS weight FROM supplier GROUP BY 1), c AS (SELECT c_nationkey AS k, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS weight FROM customer GROUP BY 1)"


@query(
    "rebalance_trades",
    f"""WITH {_NAT}, j AS (SELECT coalesce(t.k, c.k) AS symbol, coalesce(t.weight, 0.0) AS target, coalesce(c.weight, 0.0) AS current FROM t FULL JOIN c ON t.k = c.k), d AS (SELECT *, target - current AS drift, max(abs(target - current)) OVER () AS m FROM j)
    SELECT symbol, {qs('target', 'current', 'drift')}, {q('drift * 100000.0', 'trade_value')}, {q('abs(drift * 100000.0) * CAST(0.001 AS DOUBLE)', 'cost')} FROM d WHERE m > 0.005 AND abs(drift * 100000.0) >= 100""",
)
def _(spark, sf):
    def share(table, column):
        g = spark.read.parquet(f"{sf}/{table}.parquet").groupBy(F.col(column).alias("symbol")).count()
        return g.select("symbol", (F.col("count") / F.sum("count").over(Window.partitionBy()).cast("double")).alias("weight"))

    return cut(portfolio.rebalance(share("supplier", "s_nationkey"), share("customer", "c_nationkey"), 100000.0, drift=0.005))


@query(
    "combined_positions",
    f"WITH {TRADES}, s(strategy, weight) AS (VALUES ('buy', CAST(0.6 AS DOUBLE)), ('hold', CAST(0.4 AS DOUBLE))), p AS (SELECT side AS strategy, symbol, sum(quantity) AS position FROM t GROUP BY 1, 2) SELECT symbol, {q('sum(position * coalesce(weight, 0.0))', 'position')} FROM p LEFT JOIN s USING (strategy) GROUP BY symbol",
)
def _(spark, sf):
    p = bars.order_trades(spark, sf).groupBy(F.col("side").alias("strategy"), "symbol").agg(F.sum("quantity").alias("position"))
    return cut(portfolio.combined(p, spark.createDataFrame([("buy", 0.6), ("hold", 0.4)], "strategy string, weight double")))


def _allocation(kind: str):
    def run(spark, sf):
        pairs = portfolio.pairs(_pret(spark, sf)).persist()
        try:
            names, cov = portfolio.matrix(pairs, "cov")
            _, corr = portfolio.matrix(pairs, "corr")
        finally:
            pairs.unpersist()
        n = len(names)
        mean = {r["symbol"]: r["m"] for r in _pret(spark, sf).groupBy("symbol").agg(F.avg("r").alias("m")).collect()}  # one number per asset
        mu = portfolio.np.array([mean[x] for x in names])
        if kind == "risk_parity":
            x = portfolio.risk_parity(cov)
        elif kind == "hrp":
            x = portfolio.hierarchical_risk_parity(cov, corr)
        elif kind == "mean_variance":
            x = portfolio.mean_variance(mu, cov)
        else:
            view = portfolio.np.zeros((1, n))
            view[0, 0], view[0, min(1, n - 1)] = 1, -1
            x = portfolio.mean_variance(portfolio.black_litterman(cov, portfolio.np.full(n, 1 / n), view, portfolio.np.array([0.01])), cov)
        return portfolio.weights_frame(spark, names, x)

    return run


for _kind in ("risk_parity", "hrp", "mean_variance", "black_litterman"):
    query(_kind)(_allocation(_kind))


# Execution.

_ORD = "o AS (SELECT o_orderkey AS order_id, 1 + o_custkey % 200 AS quantity FROM orders)"


def _ord(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("order_id"), (1 + F.col("o_custkey") % 200).alias("quantity"))


@query("twap_schedule", f"WITH {_ORD} SELECT order_id, CAST(k AS INTEGER) AS slice, quantity / 10.0::DOUBLE AS slice_quantity, CAST(k * 180 AS DOUBLE) AS offset_seconds FROM o, range(0, 10) t(k)")
def _(spark, sf):
    return execution.twap(_ord(spark, sf))


_SHARES = ", ".join(f"({i}, CAST({p / sum(execution.PROFILE)!r} AS DOUBLE))" for i, p in enumerate(execution.PROFILE))


@query("vwap_schedule", f"WITH {_ORD}, p(k, share) AS (VALUES {_SHARES}), s AS (SELECT order_id, CAST(k AS INTEGER) AS slice, quantity * share AS slice_quantity FROM o, p WHERE quantity * share >= 1) SELECT order_id, slice, slice_quantity, (row_number() OVER (PARTITION BY order_id ORDER BY slice) - 1) * (CAST(3600 AS DOUBLE) / 14) AS offset_seconds FROM s")
def _(spark, sf):
    return execution.vwap(_ord(spark, sf))


@query("iceberg_schedule", f"WITH {_ORD} SELECT order_id, CAST(k AS INTEGER) AS slice, CAST(least(10, quantity - k * 10) AS BIGINT) AS slice_quantity FROM o, range(0, 20) t(k) WHERE k * 10 < quantity")
def _(spark, sf):
    return execution.iceberg(_ord(spark, sf))


@query("flatten_orders", f"WITH {TRADES} SELECT symbol, CASE WHEN sum(CASE WHEN side = 'buy' THEN quantity ELSE -quantity END) > 0 THEN 'sell' ELSE 'buy' END AS side, abs(sum(CASE WHEN side = 'buy' THEN quantity ELSE -quantity END)) * CAST(0.5 AS DOUBLE) AS quantity FROM t GROUP BY symbol")
def _(spark, sf):
    p = bars.order_trades(spark, sf).groupBy("symbol").agg(F.sum(F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))).alias("quantity"))
    return orders.flatten(p, 0.5)


# Text.

_GOOD, _BAD = ("the", "is"), ("of", "and")
_WORDS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\n\\t\\r]+'), lambda z: z <> '')"


_KIND = "CASE doc_id % 7 WHEN 0 THEN 'social' WHEN 1 THEN 'earnings' ELSE 'news' END"
_LEVEL = f"CASE WHEN {_KIND} = 'social' OR len({_WORDS}) < 100 THEN 'simple' WHEN {_KIND} = 'earnings' OR len({_WORDS}) > 1000 THEN 'complex' WHEN " + " OR ".join(f"contains(lower(coalesce(text, '')), '{k}')" for k in text.DEMANDING) + " THEN 'moderate' ELSE 'simple' END"
_OFTEN = "CASE WHEN doc_id % 3 = 0 THEN concat(text, ' the outlook') ELSE text END"


def _articles(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    kind = F.when(F.col("doc_id") % 7 == 0, "social").when(F.col("doc_id") % 7 == 1, "earnings").otherwise("news")
    return d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" the outlook"))).otherwise(F.col("text")).alias("text"), kind.alias("kind"))


@query("text_complexity", f"WITH d AS (SELECT doc_id, {_OFTEN} AS text FROM documents) SELECT doc_id, {_LEVEL} AS complexity FROM d")
def _(spark, sf):
    return _articles(spark, sf).select("doc_id", text.complexity(F.col("text"), F.col("kind")).alias("complexity"))


@query(
    "text_model",
    f"""WITH d AS (SELECT doc_id, {_OFTEN} AS text FROM documents), l AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'speed' WHEN 1 THEN 'cost' WHEN 2 THEN 'accuracy' ELSE 'balanced' END AS priority, {_LEVEL} AS lv FROM d)
    SELECT doc_id, priority, CASE WHEN priority = 'speed' OR lv = 'simple' THEN 'small' WHEN priority = 'cost' THEN CASE WHEN lv = 'complex' THEN 'middle' ELSE 'small' END WHEN lv = 'complex' THEN 'large' WHEN lv = 'moderate' THEN 'middle' ELSE 'small' END AS model FROM l""",
)
def _(spark, sf):
    k = F.col("doc_id") % 4
    x = _articles(spark, sf).withColumn("priority", F.when(k == 0, "speed").when(k == 1, "cost").when(k == 2, "accuracy").otherwise("balanced"))
    return x.select("doc_id", "priority", text.model_for(F.col("priority"), text.complexity(F.col("text"), F.col("kind"))).alias("model"))


@query("text_cost", f"SELECT floor(sum(len({_WORDS}) * CAST(1.3 AS DOUBLE)) / 1000.0 * CAST(0.015 AS DOUBLE) * 1e4 + 0.5) / 1e4 AS estimated_cost FROM documents")
def _(spark, sf):
    x = text.cost(spark.read.parquet(f"{sf}/documents.parquet"), "text", "accuracy")
    return x.select((F.floor(F.col("estimated_cost") * F.lit(1e4) + F.lit(0.5)) / F.lit(1e4)).alias("estimated_cost"))


_HEADS = ("Quarterly results beat", "CEO steps back", "Talks on a takeover", "New launch", "Lawsuit filed", "A weak outlook", "", "Nothing new")


@query(
    "event_detection",
    "WITH d AS (SELECT doc_id, lower(concat(CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(_HEADS)) + " END, ' ', coalesce(text, ''))) AS low FROM documents) SELECT doc_id, CASE "
    + " ".join("WHEN " + " OR ".join(f"contains(low, '{k}')" for k in ks) + f" THEN '{n}'" for n, ks in text.EVENTS.items()) + " END AS event FROM d",
)
def _(spark, sf):
    head = F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("doc_id") % 8 + 1).cast("int"))
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", text.event(F.concat(head, F.lit(" "), F.coalesce("text", F.lit("")))).alias("event"))


@query(
    "news_normalise",
    "SELECT CAST(doc_id AS VARCHAR) AS id, source AS symbol, concat('h', CAST(doc_id AS VARCHAR)) AS headline, '' AS summary, coalesce(text, '') AS content, 'benzinga' AS source, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) AS published_at, concat('u/', CAST(doc_id AS VARCHAR)) AS url FROM documents",
)
def _(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    name = F.col("doc_id").cast("string")
    at = F.date_format(F.timestamp_seconds(F.col("doc_id") + F.lit(1704067200)), "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.to_json(F.struct(name.alias("id"), F.concat(F.lit("h"), name).alias("title"), F.col("text").alias("body"), at.alias("created"), F.concat(F.lit("u/"), name).alias("url")))
    return text.normalise_news(d.select(F.col("source").alias("symbol"), raw.alias("raw")), "benzinga").withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


@query("top_headlines", f"WITH s AS (SELECT source, doc_id, len({_WORDS}) % 97 - 48 AS score FROM documents), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY abs(score) DESC, doc_id) AS INTEGER) AS place FROM s) SELECT source, place, doc_id, score FROM k WHERE place <= 3")
def _(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("source", "doc_id", (text.n_words(F.col("text")) % 97 - 48).cast("long").alias("score"))
    return text.headlines(d, "source", text="doc_id")


@query("monthly_cost", "WITH u AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'alpaca_paid' WHEN 1 THEN 'polygon_basic' WHEN 2 THEN 'binance' ELSE 'unknown' END AS source, o_custkey AS requests FROM orders) SELECT " + q("sum(requests * CASE source WHEN 'alpaca_paid' THEN 0.00003::DOUBLE WHEN 'polygon_basic' THEN 0.0001::DOUBLE ELSE 0.0 END)", "monthly_cost") + " FROM u")
def _(spark, sf):
    k = F.col("o_orderkey") % 4
    u = spark.read.parquet(f"{sf}/orders.parquet").select(F.when(k == 0, "alpaca_paid").when(k == 1, "polygon_basic").when(k == 2, "binance").otherwise("unknown").alias("source"), F.col("o_custkey").alias("requests"))
    return cut(text.monthly_cost(u))


@query(
    "sentiment_signal",
    f"""WITH s AS (SELECT source, CAST(doc_id % 48 AS DOUBLE) AS hours, len(list_filter({_WORDS}, lambda z: z IN {_GOOD})) AS g, len(list_filter({_WORDS}, lambda z: z IN {_BAD})) AS b FROM documents),
    x AS (SELECT source, CASE WHEN g + b = 0 THEN 0.0 ELSE (g - b) / CAST(g + b AS DOUBLE) END AS score, 1 / (1 + hours / 12.0) AS wt FROM s),
    a AS (SELECT source, sum(score * wt) / sum(wt) AS signal, count(*) AS n_articles, count(*) FILTER (score > 0) AS up, count(*) FILTER (score < 0) AS dn FROM x GROUP BY 1)
    SELECT source, {q('signal')}, n_articles, {q('greatest(up, dn) / CAST(n_articles AS DOUBLE) * least(n_articles / 5.0, 1.0)', 'confidence')}, CASE WHEN signal > 0.3 THEN 'bullish' WHEN signal < -0.3 THEN 'bearish' ELSE 'neutral' END AS label FROM a""",
)
def _(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    x = d.select("source", (F.col("doc_id") % 48).cast("double").alias("hours"), text.lexicon_score(F.col("text"), _GOOD, _BAD).alias("score"))
    return cut(text.sentiment_signal(x, "source"))


@query(
    "novelty",
    f"""WITH mid AS (SELECT (min(doc_id) + max(doc_id)) / 2.0 AS m FROM documents), d AS (SELECT doc_id, NOT coalesce(doc_id < m, false) AS cur, text FROM documents, mid), t AS (SELECT doc_id, cur, unnest({_WORDS}) AS term FROM d),
    top AS (SELECT term FROM t GROUP BY 1 ORDER BY count(*) DESC, term LIMIT 1000), tf AS (SELECT doc_id, cur, term, count(*) AS tf FROM t SEMI JOIN top USING (term) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    n AS (SELECT count(*) AS n, count(*) FILTER (NOT cur) AS h FROM d), v AS (SELECT doc_id, cur, term, tf * (ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1) AS raw FROM tf JOIN df USING (term), n), u AS (SELECT *, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS wt FROM v),
    m AS (SELECT term, sum(wt) AS m FROM u WHERE NOT cur GROUP BY 1), s AS (SELECT doc_id, sum(wt * coalesce(m, 0.0)) AS s FROM u LEFT JOIN m USING (term) WHERE cur GROUP BY 1)
    SELECT d.doc_id, {q('coalesce(1 - s / CAST(h AS DOUBLE), 0.5)', 'novelty')} FROM d LEFT JOIN s USING (doc_id), n WHERE cur""",
)
def _(spark, sf):
    """Documents below the middle of the range of ids are the history, all others the news."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    middle = d.agg(((F.min("doc_id") + F.max("doc_id")) / 2).alias("middle"))
    x = d.crossJoin(F.broadcast(middle)).withColumn("old", F.coalesce(F.col("doc_id") < F.col("middle"), F.lit(False)))
    return cut(text.novelty(x.where("not old"), x.where("old"), "doc_id", "text"))


_LINES = """c AS (SELECT conv_id, turn, CASE WHEN turn = 3 THEN 'Question-and-Answer session' WHEN role = 'user' AND turn % 4 = 0 THEN concat('Operator: ', coalesce(text, '')) ELSE coalesce(text, '') END AS t FROM conversations),
p AS (SELECT conv_id, turn, string_split(t, chr(10)) AS parts FROM c), l AS (SELECT conv_id, turn, unnest(range(0, len(parts))) AS k, unnest(parts) AS line FROM p),
x AS (SELECT conv_id, turn * 100000 + k AS line_no, line, lower(line) AS low FROM l), y AS (SELECT *, contains(low, 'question-and-answer') OR contains(low, 'q&a') AS head FROM x),
s AS (SELECT *, max(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked FROM y),
z AS (SELECT conv_id, line_no, line, CASE WHEN contains(low, 'operator') AND contains(line, ':') THEN 'operator_notes' WHEN asked = 1 THEN 'q_and_a' ELSE 'prepared_remarks' END AS section FROM s WHERE NOT head)"""


def _lines(spark, sf):
    """Conversations as transcripts: an operator's notes and a heading among the turns."""
    c, t = spark.read.parquet(f"{sf}/conversations.parquet"), F.coalesce("text", F.lit(""))
    said = F.when(F.col("turn") == 3, "Question-and-Answer session").when((F.col("role") == "user") & (F.col("turn") % 4 == 0), F.concat(F.lit("Operator: "), t)).otherwise(t)
    return text.split_lines(c.select("conv_id", "turn", said.alias("text")), "conv_id", "turn").select("conv_id", (F.col("turn") * 100000 + F.col("line_no")).alias("line_no"), "line")


@query("transcript_sections", f"WITH {_LINES} SELECT * FROM z")
def _(spark, sf):
    return text.sections(_lines(spark, sf), "conv_id")


@query("transcript_collected", f"WITH {_LINES} SELECT conv_id, section, count(*) AS n, string_agg(line, '|' ORDER BY line_no) AS lines FROM z GROUP BY 1, 2")
def _(spark, sf):
    x = text.transcripts(_lines(spark, sf), "conv_id")
    return x.select("conv_id", "section", F.size("lines").cast("long").alias("n"), F.concat_ws("|", "lines").alias("lines"))


@query("cheapest_source", "SELECT mode, arg_min(source, (cost, source)) AS source, min(cost) AS cost FROM (SELECT l_linenumber AS mode, l_returnflag AS source, min(l_extendedprice) AS cost FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def _(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_linenumber").alias("mode"), F.col("l_returnflag").alias("source")).agg(F.min("l_extendedprice").alias("cost"))
    return text.cheapest(li, "mode").select("mode", "source", "cost")


# Streaming.


def _monitored(spark, sf):
    """The account of circuit_breaker as a stream: it's written to files and read from there."""
    path = shared_place(spark, "stream-in")
    x = drawdown.checks(_account(spark, sf)).withColumn("ts", F.col("ts").cast("timestamp")).withColumnRenamed("run_id", "symbol")
    x = x.withColumn("r", w.simple_return(F.col("equity"), "symbol"))
    x.coalesce(1).sortWithinPartitions("ts").write.parquet(path)
    return spark.readStream.schema(x.schema).parquet(path)


@query("stream_drawdown_monitor", f"WITH {_ACCOUNT} SELECT run_id AS symbol, ts, {q('drawdown')}, CASE WHEN drawdown >= 0.15 THEN 'CRITICAL' WHEN drawdown >= 0.10 THEN 'WARNING' ELSE 'OK' END AS level FROM ck")
def _(spark, sf):
    from tapeloom.streaming import monitors

    x = monitors.run_once(monitors.drawdown_monitor(_monitored(spark, sf)), "drawdown", shared_place(spark, "stream"))
    return cut(x.drop("equity")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "stream_var_monitor",
    f"""WITH {_ACCOUNT}, x AS (SELECT run_id AS symbol, ts, (equity - lag(equity) OVER o) / lag(equity) OVER o AS r FROM a0 WINDOW o AS (PARTITION BY run_id ORDER BY ts)), n AS (SELECT * FROM x WHERE r IS NOT NULL),
    v AS (SELECT symbol, ts, count(r) OVER o AS n, quantile_cont(r, 0.05) OVER o AS var, list(r) OVER o AS l FROM n WINDOW o AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))
    SELECT symbol, ts, {q('var')}, {q('list_avg(list_filter(l, lambda z: z <= var))', 'cvar')}, abs(var) > 0.05 AS alert FROM v WHERE n >= 20""",
)
def _(spark, sf):
    from tapeloom.streaming import monitors

    x = monitors.run_once(monitors.var_monitor(_monitored(spark, sf).where("r is not null")), "var", shared_place(spark, "stream"))
    return cut(x).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_breaker", SQL["circuit_breaker"].replace("SELECT run_id, ts, reason, coalesce", "SELECT run_id AS symbol, ts, reason, coalesce"))
def _(spark, sf):
    from tapeloom.streaming import monitors

    x = monitors.run_once(monitors.breaker_monitor(_monitored(spark, sf)), "breaker", shared_place(spark, "stream"))
    return x.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "stream_bars_tumbling",
    """SELECT event_type AS symbol, date_trunc('day', ts) AS ts, min_by(value, event_id) AS open, max(value) AS high, min(value) AS low, max_by(value, event_id) AS close, count(*) AS volume FROM events GROUP BY 1, 2""",
)
def _(spark, sf):
    from tapeloom.streaming import monitors

    bars_ = monitors.tumbling_bars(monitors.read_ticks(spark, sf, "events.parquet"))
    return monitors.run_once(bars_, "bars", shared_place(spark, "stream"), "update", ("symbol", "ts")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
