"""Bar tables: builders over the test tables, a partitioned Parquet store, normalisers, checks and repairs."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.functions.windows import ordered, simple_return, td

COLUMNS = ("symbol", "ts", "open", "high", "low", "close", "volume")


class ValidationError(ValueError):
    """A table isn't a usable bar table."""


def _cents(c: str) -> Column:
    return F.floor(F.col(c) * 100 + F.lit(0.5)).cast("long")


def _priced(rows: DataFrame) -> DataFrame:
    """Bars from exact sums of cents and units: the close is the mean price, the open the last close."""
    b = rows.groupBy("symbol", "ts").agg((F.sum("cents").cast("double") / (100 * F.sum("units"))).alias("close"), F.sum("units").alias("volume"))
    b = b.withColumn("open", F.coalesce(F.lag("close").over(ordered("symbol")), F.col("close")))
    return b.select(
        "symbol", "ts", "open", (F.greatest("open", "close") * F.lit(1.01)).alias("high"), (F.least("open", "close") * F.lit(0.99)).alias("low"), "close", "volume"
    )


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return _priced(li.select(F.col("l_returnflag").alias("symbol"), F.date_trunc("week", "l_shipdate").cast("date").alias("ts"), _cents("l_extendedprice").alias("cents"), F.col("l_quantity").alias("units")))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    symbol = F.concat(F.lit("S"), (F.col("l_suppkey") % 20).cast("string"))
    return _priced(li.select(symbol.alias("symbol"), F.date_trunc("month", "l_shipdate").cast("date").alias("ts"), _cents("l_extendedprice").alias("cents"), F.col("l_quantity").alias("units")))


def daily_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series, ALL, of daily bars of all lines."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return _priced(li.select(F.lit("ALL").alias("symbol"), F.col("l_shipdate").cast("date").alias("ts"), _cents("l_extendedprice").alias("cents"), F.col("l_quantity").alias("units")))


def by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each supplier's lines, with gaps."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return _priced(li.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"), F.col("l_shipdate").cast("date").alias("ts"), _cents("l_extendedprice").alias("cents"), F.col("l_quantity").alias("units")))


def ticks(events: DataFrame) -> DataFrame:
    """(symbol, ts, value, event_id) of an event table."""
    return events.select(F.col("event_type").alias("symbol"), F.col("ts"), "value", "event_id")


def from_ticks(rows: DataFrame, bucket: Column) -> DataFrame:
    """OHLCV bars with vwap from ticks (symbol, value, event_id), by symbol and bucket."""
    return rows.groupBy("symbol", bucket.alias("ts")).agg(
        F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"),
        F.count("*").alias("volume"), (F.sum(_cents("value")).cast("double") / (100 * F.count("*"))).alias("vwap"),
    )


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_ticks(ticks(spark.read.parquet(f"{sf_dir}/events.parquet")), F.date_trunc("day", "ts").cast("date"))


def order_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(
        F.col("o_orderkey").alias("trade_id"), F.col("o_orderdate").cast("date").alias("timestamp"), F.col("o_orderpriority").alias("symbol"),
        F.when(F.col("o_orderkey") % 2 == 0, "buy").otherwise("sell").alias("side"), (1 + F.col("o_custkey") % 100).alias("quantity"), F.col("o_totalprice").alias("price"),
        (F.col("o_totalprice") * ((F.col("o_custkey") % 11) - 5) / F.lit(1000.0)).alias("pnl"), F.lit(1.0).alias("commission"),
    )


# Checks and repairs.


def validate(bars: DataFrame) -> DataFrame:
    """Per symbol: rows and the number of each kind of fault, in one pass and one shuffle of counts."""
    missing = [c for c in COLUMNS if c.lower() not in {x.lower() for x in bars.columns}]
    if missing:
        raise ValidationError(f"missing columns {missing}")
    one = bars.groupBy("symbol", "ts").agg(
        F.count("*").alias("n"), *[F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(f"null_{c}") for c in ("open", "high", "low", "close", "volume")],
        F.count_if((F.col("open") < 0) | (F.col("high") < 0) | (F.col("low") < 0) | (F.col("close") < 0) | (F.col("volume") < 0)).alias("neg"),
        F.count_if(F.col("high") < F.col("low")).alias("hl"), F.count_if(F.col("high") < F.col("open")).alias("ho"), F.count_if(F.col("high") < F.col("close")).alias("hc"),
    )
    return one.groupBy("symbol").agg(
        F.sum("n").alias("n_rows"), F.count_if(F.col("n") > 1).alias("duplicate_keys"), F.sum(F.col("null_open") + F.col("null_high") + F.col("null_low") + F.col("null_close") + F.col("null_volume")).alias("nulls"),
        F.sum("neg").alias("negatives"), F.sum("hl").alias("high_below_low"), F.sum("ho").alias("high_below_open"), F.sum("hc").alias("high_below_close"),
    )


def require_valid(bars: DataFrame) -> DataFrame:
    """The bars themselves; raises if a key (symbol, ts) repeats or the table is empty."""
    if bars.isEmpty():
        raise ValidationError("no bars")
    if not validate(bars).where("duplicate_keys > 0").isEmpty():
        raise ValidationError("a symbol has several bars of one time")
    return bars


def repair(bars: DataFrame, jump: float = 0.5) -> DataFrame:
    """High raised and low lowered to hold open and close, negative volume set to 0; large returns flagged."""
    ret = simple_return(F.col("close"), "symbol")
    return bars.select(
        "symbol", "ts", "open", F.greatest("high", "open", "close").alias("high"), F.least("low", "open", "close").alias("low"), "close",
        F.greatest(F.col("volume"), F.lit(0).cast(bars.schema["volume"].dataType)).alias("volume"), F.coalesce(F.abs(ret) > jump, F.lit(False)).alias("jump"),
    )


def gaps(bars: DataFrame, factor: int = 5) -> DataFrame:
    """Steps between bars longer than factor times the symbol's commonest step (the smaller of equally common ones)."""
    steps = bars.select("symbol", "ts", F.datediff("ts", F.lag("ts").over(ordered("symbol"))).alias("gap")).where("gap is not null")
    usual = steps.groupBy("symbol", "gap").count().groupBy("symbol").agg(F.min_by("gap", F.struct(-F.col("count"), F.col("gap"))).alias("usual"))
    return steps.join(usual, "symbol").where(F.col("gap") > factor * F.col("usual"))


def splits(bars: DataFrame, ratio: float = 1.8, surge: float = 1.0) -> DataFrame:
    """Likely share splits: the price falls by the ratio while volume more than doubles."""
    w = ordered("symbol")
    x = bars.select("symbol", "ts", td(F.lag("close").over(w), F.col("close")).alias("ratio"), td(F.col("volume") - F.lag("volume").over(w), F.lag("volume").over(w)).alias("surge"))
    return x.where((F.col("ratio") > ratio) & (F.col("surge") > surge)).select("symbol", "ts", F.concat(F.bround("ratio").cast("long").cast("string"), F.lit(":1")).alias("label"))


# Store and connectors.


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored and new bars, the new one where both have a key."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy("symbol", "ts").orderBy(F.desc("_new"))
    return both.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "_new")


def save(bars: DataFrame, path: str, timeframe: str) -> None:
    """Writes the bars' partitions (timeframe, symbol, year) of a Parquet store anew; others stay."""
    rows = bars.withColumn("timeframe", F.lit(timeframe)).withColumn("year", F.year("ts"))
    out = rows.repartition("timeframe", "symbol", "year").sortWithinPartitions("symbol", "ts").write.partitionBy("timeframe", "symbol", "year")
    out.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").parquet(path)


def load(spark: SparkSession, path: str, timeframe: str, symbol: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of a store; timeframe, symbol and years prune partitions, times go to the scan."""
    df = spark.read.parquet(path).where(F.col("timeframe") == timeframe)
    if symbol is not None:
        df = df.where(F.col("symbol") == symbol)
    if start is not None:
        df = df.where((F.col("ts") >= F.lit(start).cast("date")) & (F.col("year") >= int(start[:4])))
    if end is not None:
        df = df.where((F.col("ts") <= F.lit(end).cast("date")) & (F.col("year") <= int(end[:4])))
    return df.select(*COLUMNS)


def store_stats(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b")).distinct()
    return files.agg(F.count("*").alias("n_files"), F.sum("b").alias("bytes"), F.avg("b").alias("mean_bytes"))


def missing_rows(stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """What an incremental fetch adds: fetched bars whose key isn't stored."""
    return fetched.join(stored.select("symbol", "ts"), ["symbol", "ts"], "left_anti")


def read_through(spark: SparkSession, path: str, timeframe: str, symbol: str, start: str, end: str, fetch: Callable[[str, str], DataFrame]) -> DataFrame:
    """The bars of a symbol from the store; what lies after the last stored one is fetched (from the day after it on), stored, and returned with the rest.

    fetch(start, end) gives bars; nothing is fetched if the store reaches `end`.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    last = load(spark, path, timeframe, symbol).agg(F.max("ts").alias("last")).first()["last"] if there else None
    if last is None or str(last) < end:
        new = fetch(start if last is None else str(last + dt.timedelta(days=1)), end)
        old = load(spark, path, timeframe, symbol) if there else None
        # partitions are written anew as wholes, so the years that the new bars touch are read first
        whole = new.select(*COLUMNS) if old is None else upsert(old, new.select(*COLUMNS))
        staged = f"{path.rstrip('/')}-staged-{symbol}"
        whole.write.mode("overwrite").parquet(staged)
        save(spark.read.parquet(staged), path, timeframe)
        held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged)
        held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(held, True)
    return load(spark, path, timeframe, symbol, start, end)


def route(symbol: Column) -> Column:
    """The connector of a symbol: crypto pairs go to the crypto one."""
    return F.when(symbol.contains("/") | symbol.endswith("USDT") | symbol.endswith("BTC"), "crypto").otherwise("equity")


def normalise_json(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Vendor bars as JSON (t, o, h, l, c, v, optional vw, n, S) to the bar schema."""
    b = F.from_json(column, "S string, t timestamp, o double, h double, l double, c double, v double, vw double, n long")
    x = raw.select(b.alias("b"))
    return x.select(F.col("b.S").alias("symbol"), F.col("b.t").alias("ts"), *[F.col(f"b.{a}").alias(n) for a, n in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"), ("v", "volume"), ("vw", "vwap"), ("n", "trade_count"))])
