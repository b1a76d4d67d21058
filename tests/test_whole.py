"""Registered queries over whole tables, against brute force that leaves out no row."""

import collections
import math
import os
import re

import duckdb
import pytest

from tapeloom.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
needs_tables = pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")


def test_novelty_scores_every_document(spark, tmp_path):
    texts = [(i, " ".join(f"w{(i * i + 3 * j) % 17}" for j in range(1 + i % 7)) + (" new" if i % 5 == 0 else "")) for i in range(260)]
    texts[200], texts[10] = (200, None), (10, "")
    spark.createDataFrame(texts, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    counts = {i: collections.Counter(re.findall(r"\S+", (t or "").lower())) for i, t in texts}
    df = collections.Counter(w for c in counts.values() for w in c)
    unit = {}
    for i, c in counts.items():
        raw = {w: n * (math.log((1 + len(texts)) / (1 + df[w])) + 1) for w, n in c.items()}
        size = math.sqrt(sum(x * x for x in raw.values()))
        unit[i] = {w: x / size for w, x in raw.items()}
    want = {}
    for i in range(130, 260):
        cosines = [sum(x * unit[h].get(w, 0.0) for w, x in unit[i].items()) for h in range(130)]
        want[i] = 1 - sum(cosines) / 130 if unit[i] else 0.5
    got = {r["doc_id"]: r["novelty"] for r in registry.QUERIES["novelty"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want, abs=2e-6)


@needs_tables
@pytest.mark.parametrize("name", ["twap_schedule", "vwap_schedule", "iceberg_schedule"])
def test_every_order_is_scheduled(spark, name):
    from tapeloom.operators.execution import PROFILE

    want = set()
    for key, cust in duckdb.sql(f"SELECT o_orderkey, o_custkey FROM '{SF}/orders.parquet'").fetchall():
        n = 1 + cust % 200
        if name == "twap_schedule":  # half an hour in ten slices
            want |= {(key, k, n / 10, k * 180.0) for k in range(10)}
        elif name == "vwap_schedule":  # an hour by the profile; a slice below one unit takes no time
            sent = [(k, n * (p / sum(PROFILE))) for k, p in enumerate(PROFILE) if n * (p / sum(PROFILE)) >= 1]
            want |= {(key, k, q, i * (3600 / 14)) for i, (k, q) in enumerate(sent)}
        else:
            want |= {(key, k, min(10, n - 10 * k)) for k in range(math.ceil(n / 10))}
    got = [tuple(r) for r in registry.QUERIES[name](spark, SF).collect()]
    assert len(got) == len(want)
    assert set(got) == want


@needs_tables
def test_every_bar_places_a_limit_order(spark):
    from tapeloom.sources import bars

    b = bars.weekly(spark, SF).toPandas()
    want = {}
    for symbol, x in b.groupby("symbol"):
        x = x.sort_values("ts").to_dict("records")
        for i, r in enumerate(x):
            side, limit = ("buy", r["close"] * 0.97) if i % 2 == 0 else ("sell", r["close"] * 1.03)
            for later in x[i + 1 :]:
                if later["low"] <= limit if side == "buy" else later["high"] >= limit:
                    price = min(limit, later["open"]) if side == "buy" else max(limit, later["open"])
                    want[f"{symbol}{r['ts']}"] = (side, later["ts"], price)
                    break
    got = {r["order_id"]: (r["side"], r["fill_ts"], r["fill_price"]) for r in registry.QUERIES["limit_order_fills"](spark, SF).collect()}
    assert got.keys() == want.keys()
    for k, (side, ts, price) in want.items():
        assert got[k][:2] == (side, ts) and got[k][2] == pytest.approx(price, abs=2e-6)


@needs_tables
def test_multiple_testing_takes_all_parts(spark):
    keys = duckdb.sql(f"SELECT p_partkey FROM '{SF}/part.parquet'").fetchall()
    p = sorted((float(k * 7919 % 1000 + 1) / 20000, f"F{k}") for (k,) in keys)
    m, holm = len(p), True
    reach = max((i for i, (x, _) in enumerate(p, 1) if x <= 0.05 * i / m), default=0)
    want = {}
    for i, (x, name) in enumerate(p, 1):
        holm = holm and x <= 0.05 / (m - i + 1)
        want[name] = (x, i, x <= 0.05 / m, holm, i <= reach)
    got = {r["name"]: tuple(r)[1:] for r in registry.QUERIES["multiple_testing"](spark, SF).collect()}
    assert got == want


def test_rebalance_weighs_all_nations(spark, tmp_path):
    target, current = [0, 0, 0, 1, 22], [0, 1, 1, 21, 24]  # nations 21 and 24 have customers only, 22 suppliers only
    spark.createDataFrame([(x,) for x in target], "s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(x,) for x in current], "c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r["symbol"]: (r["target"], r["current"], r["trade_value"]) for r in registry.QUERIES["rebalance_trades"](spark, str(tmp_path)).collect()}
    want = {0: (0.6, 0.2, 4e4), 1: (0.2, 0.4, -2e4), 21: (0.0, 0.2, -2e4), 22: (0.2, 0.0, 2e4), 24: (0.0, 0.2, -2e4)}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])
