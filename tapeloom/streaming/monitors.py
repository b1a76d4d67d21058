"""Structured Streaming: bars from ticks with watermarks, monitors with keyed state, results in files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_ticks(spark: SparkSession, folder: str, names: str = "*.parquet", files_per_trigger: int = 1000) -> DataFrame:
    """A stream over a folder's Parquet files of events; ts becomes a timestamp with zone, as watermarks need."""
    schema = spark.read.option("pathGlobFilter", names).parquet(folder).schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", names).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return raw.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "value", "event_id")


def tumbling_bars(ticks: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """OHLCV bars per symbol and window; ticks that come later than `late` are dropped."""
    g = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width))
    return g.agg(
        F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"), F.count("*").alias("volume")
    ).select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


class Drawdown(StatefulProcessor):
    """Per key: the peak so far; emits every value with its drawdown and level of alarm."""

    warning, critical = 0.10, 0.15

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.peak = handle.getValueState("peak", "peak double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("ts")
        peak = self.peak.get()[0] if self.peak.exists() else float("-inf")
        tops = pdf["equity"].cummax().clip(lower=peak)
        self.peak.update((float(tops.iloc[-1]),))
        dd = 1 - pdf["equity"] / tops
        level = ["CRITICAL" if d >= self.critical else "WARNING" if d >= self.warning else "OK" for d in dd]
        yield pd.DataFrame({"symbol": key[0], "ts": pdf["ts"], "equity": pdf["equity"], "drawdown": dd, "level": level})

    def close(self) -> None:
        pass


def drawdown_monitor(equity: DataFrame) -> DataFrame:
    """equity (symbol, ts, equity) as a stream or a table, with drawdown and level."""
    return equity.groupBy("symbol").transformWithStateInPandas(
        Drawdown(), outputStructType="symbol string, ts timestamp, equity double, drawdown double, level string", outputMode="Append", timeMode="None"
    )


class Positions(StatefulProcessor):
    """Per symbol: signed quantity and average price; emits realised profit at each fill."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("position", "quantity double, price double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, avg = self.state.get() if self.state.exists() else (0.0, 0.0)
        out = []
        for f in pd.concat(list(rows)).sort_values("ts").itertuples():
            q = f.quantity if f.side == "buy" else -f.quantity
            gain = 0.0
            if held * q >= 0:
                avg = (avg * abs(held) + f.price * abs(q)) / abs(held + q) if held + q else 0.0
            else:
                gain = (f.price - avg) * min(abs(q), abs(held)) * (1 if held > 0 else -1)
                avg = f.price if abs(q) > abs(held) else avg
            held += q
            out.append((key[0], f.ts, held, avg if held else 0.0, gain))
        self.state.update((float(held), float(avg)))
        yield pd.DataFrame(out, columns=["symbol", "ts", "quantity", "price", "realised"])

    def close(self) -> None:
        pass


def position_stream(fills: DataFrame) -> DataFrame:
    """fills (symbol, ts, side, quantity, price) to positions."""
    return fills.groupBy("symbol").transformWithStateInPandas(
        Positions(), outputStructType="symbol string, ts timestamp, quantity double, price double, realised double", outputMode="Append", timeMode="None"
    )


class ValueAtRisk(StatefulProcessor):
    """Per key: the last returns; emits the value at risk and the mean beyond it, once `least` are there, and an alarm above `limit`."""

    window, least, share, limit = 252, 20, 0.05, 0.05

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "r array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = list(self.seen.get()[0]) if self.seen.exists() else []
        out = []
        for row in pd.concat(list(rows)).sort_values("ts").itertuples():
            seen = [*seen, float(row.r)][-self.window :]
            if len(seen) >= self.least:
                x = np.array(seen)
                var = float(np.percentile(x, self.share * 100))
                out.append((key[0], row.ts, var, float(x[x <= var].mean()), abs(var) > self.limit))
        self.seen.update((seen,))
        yield pd.DataFrame(out, columns=["symbol", "ts", "var", "cvar", "alert"])

    def close(self) -> None:
        pass


def var_monitor(returns: DataFrame) -> DataFrame:
    """returns (symbol, ts, r) as a stream, with value at risk."""
    return returns.groupBy("symbol").transformWithStateInPandas(
        ValueAtRisk(), outputStructType="symbol string, ts timestamp, var double, cvar double, alert boolean", outputMode="Append", timeMode="None"
    )


class Breaker(StatefulProcessor):
    """Per key: when it last triggered; emits every check with whether it holds. See drawdown.breaker."""

    limit, daily, cooldown = 0.15, 0.045, pd.Timedelta(minutes=60)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.since = handle.getValueState("since", "ts timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        since = pd.Timestamp(self.since.get()[0]) if self.since.exists() else None
        out = []
        for row in pd.concat(list(rows)).sort_values("ts").itertuples():
            if since is not None and row.ts - since > self.cooldown:
                since = None
            reason = None
            if since is None and (row.drawdown >= self.limit or row.daily_loss >= self.daily):
                since, reason = row.ts, "daily loss" if row.daily_loss >= self.daily else "drawdown"
            out.append((key[0], row.ts, reason, since is not None))
        if since is not None:
            self.since.update((since.to_pydatetime(),))
        yield pd.DataFrame(out, columns=["symbol", "ts", "reason", "active"])

    def close(self) -> None:
        pass


def breaker_monitor(checks: DataFrame) -> DataFrame:
    """checks (symbol, ts, drawdown, daily_loss) as a stream, with what a circuit breaker does."""
    return checks.groupBy("symbol").transformWithStateInPandas(Breaker(), outputStructType="symbol string, ts timestamp, reason string, active boolean", outputMode="Append", timeMode="None")


def sliding_bars(ticks: DataFrame, width: str = "1 day", slide: str = "6 hours", late: str = "2 hours") -> DataFrame:
    """Counts and ranges of overlapping windows (an extension)."""
    g = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width, slide))
    return g.agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("volume")).select("symbol", F.col("window.start").alias("ts"), "low", "high", "volume")


def session_bars(ticks: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Ranges of spells of trading that a pause of `gap` ends (an extension)."""
    g = ticks.withWatermark("ts", late).groupBy("symbol", F.session_window("ts", gap).alias("w"))
    return g.agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("volume")).select("symbol", F.col("w.start").alias("ts"), F.col("w.end").alias("until"), "low", "high", "volume")


def read_news(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of articles from a folder's files of JSON lines (id, symbol, headline, summary, source, published_at)."""
    schema = "id string, symbol string, headline string, summary string, source string, published_at timestamp"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def start(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", every: str | None = None):
    """Writes a stream's batches to folders of `path`, a folder each, so that a batch that is done again replaces itself.

    every: how often to look for new input; without it what is there is worked off and the query ends.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    how = {"processingTime": every} if every else {"availableNow": True}
    conf = stream.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, _ROCKSDB)  # keyed state needs it; a query keeps the settings that it started with
    try:
        return stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(**how).start()
    finally:
        conf.set(_PROVIDER, before) if before else conf.unset(_PROVIDER)


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """Works off what is there into files beside the checkpoint and reads them; in update mode the last row of each of the keys holds."""
    spark, path = stream.sparkSession, f"{checkpoint.rstrip('/')}-{name}"
    start(stream, path, checkpoint, mode).awaitTermination()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], stream.schema)
    out = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(path)
    if mode == "update":
        w = Window.partitionBy(*keys).orderBy(F.desc("batch"))
        out = out.withColumn("_k", F.row_number().over(w)).where("_k = 1")
    return out.select(*stream.columns)
