"""Access to bars up to a current row and no further, for any number of symbols at once."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.windows import LookaheadError, row_index


@dataclass(frozen=True)
class Guard:
    """A view of bars (symbol, ts, ...) whose rows are numbered by symbol, from 0; rows after `current` can't be reached.

    Asking for one raises LookaheadError when the plan is made, without reading a row. Negative numbers count from the last
    visible row.
    """

    bars: DataFrame
    current: int

    def __post_init__(self):
        if self.current < 0:
            raise ValueError("the current row must be 0 or more")

    def update_index(self, current: int) -> Guard:
        return replace(self, current=current)

    def visible(self) -> DataFrame:
        return self.bars.withColumn("row_idx", row_index("symbol")).where(F.col("row_idx") <= self.current)

    def rows(self, start: int = 0, stop: int | None = None) -> DataFrame:
        """Rows from start to before stop."""
        stop = self.current + 1 if stop is None else stop
        if stop > self.current + 1:
            raise LookaheadError(f"row {stop - 1} lies after row {self.current}")
        x = self.visible()
        if start < 0 or stop < 0:
            size = F.max("row_idx").over(Window.partitionBy("symbol")) + 1
            x = x.withColumn("_size", size)
            low = F.col("_size") + start if start < 0 else F.lit(start)
            high = F.col("_size") + stop if stop < 0 else F.lit(stop)
            return x.where((F.col("row_idx") >= low) & (F.col("row_idx") < high)).drop("_size")
        return x.where((F.col("row_idx") >= start) & (F.col("row_idx") < stop))

    def row(self, index: int) -> DataFrame:
        if index > self.current:
            raise LookaheadError(f"row {index} lies after row {self.current}")
        return self.rows(index).where(F.col("row_idx") == index) if index >= 0 else self.rows(index, index + 1 if index < -1 else None)

    def column(self, name: str) -> DataFrame:
        """(symbol, row_idx, value) of a column's visible rows."""
        return self.visible().select("symbol", "row_idx", F.col(name).alias("value"))

    def stats(self, name: str) -> DataFrame:
        """(symbol, n, mean, std, low, high) of a column's visible rows."""
        c = F.col("value")
        return self.column(name).groupBy("symbol").agg(F.count("*").alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("low"), F.max(c).alias("high"))
