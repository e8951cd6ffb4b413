"""Point-in-time views: tables that carry the instant as of which they may be read, and show nothing that came later."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.causal import LookAheadError


class PointInTimeView:
    """Rows of symbols that were available at as_of. Every read goes through the one filter, so it reaches the scan."""

    def __init__(self, df: DataFrame, as_of: dt.datetime | str, symbol: str = "symbol", time: str = "ts", available: str = "available_at"):
        for column in (time, available):
            if column not in df.columns:
                raise LookAheadError(f"no column {column}: a view does not guess when rows were known")
        self._as_of = dt.datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
        self._symbol, self._time, self._available = symbol, time, available
        self._rows = df.where(F.col(available) <= self._instant(self._as_of))

    @staticmethod
    def _instant(at: dt.datetime) -> Column:
        """An instant; without a zone it is UTC."""
        at = at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)
        return F.timestamp_micros(F.lit(int(at.timestamp()) * 1_000_000 + at.microsecond))

    @property
    def as_of(self) -> dt.datetime:
        return self._as_of

    def rows(self) -> DataFrame:
        """All that is visible, in no order."""
        return self._rows

    def of(self, *symbols: str) -> PointInTimeView:
        """The same view of some symbols."""
        return PointInTimeView(self._rows.where(F.col(self._symbol).isin(*symbols)), self._as_of, self._symbol, self._time, self._available)

    def earlier(self, as_of: dt.datetime | str) -> PointInTimeView:
        """The view as of an instant that is not later."""
        found = PointInTimeView(self._rows, as_of, self._symbol, self._time, self._available)
        if _utc(found._as_of) > _utc(self._as_of):
            raise LookAheadError(f"{found._as_of} is after the view's {self._as_of}")
        return found

    def symbols(self) -> DataFrame:
        return self._rows.select(self._symbol).distinct()

    def tail(self, n: int) -> DataFrame:
        """The last n visible rows of each symbol; of rows with equal time those that became available last."""
        if n <= 0:
            raise ValueError("n must be positive")
        place = F.row_number().over(W.partitionBy(self._symbol).orderBy(F.desc(self._time), F.desc(self._available)))
        return self._rows.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")

    def latest(self) -> DataFrame:
        """The last visible row of each symbol."""
        return self.tail(1)

    def values(self, column: str, n: int) -> DataFrame:
        """symbol, values: the last n visible values of a column, oldest first."""
        if column not in self._rows.columns:
            raise KeyError(column)
        item = F.struct(self._time, self._available, F.col(column).cast("double").alias("__value"))
        got = self.tail(n).groupBy(self._symbol).agg(F.sort_array(F.collect_list(item)).alias("x"))
        return got.select(self._symbol, F.col("x.__value").alias("values"))

    def value_at(self, at: dt.datetime, column: str) -> DataFrame:
        """symbol and its value at a time, where it is visible; of several rows the one that became available last."""
        if _utc(at) > _utc(self._as_of):
            raise LookAheadError(f"{at} is after the view's {self._as_of}")
        hit = self._rows.where(F.col(self._time) == self._instant(at))
        return hit.groupBy(self._symbol).agg(F.max_by(column, self._available).alias(column))

    def require_history(self, least: int) -> DataFrame:
        """The visible rows, if each symbol has at least so many (and there is a symbol)."""
        short = self._rows.groupBy(self._symbol).count().where(F.col("count") < least).orderBy("count", self._symbol).limit(5).collect()
        if short or not self._rows.take(1):
            raise LookAheadError(f"fewer than {least} rows as of {self._as_of}: " + (", ".join(f"{r[0]} {r[1]}" for r in short) or "none at all"))
        return self._rows


def _utc(at: dt.datetime) -> dt.datetime:
    return at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)
