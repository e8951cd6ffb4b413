"""Rules with memory as table functions: one call per bar, in order, with nothing later in reach."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


class Rule(ABC):
    """A strategy for one symbol; its attributes are its memory. One object serves one symbol's bars from first to last."""

    #: Bars that the rule sees before its first weight counts.
    warmup = 0

    @abstractmethod
    def on_bar(self, bar: Row) -> float | None:
        """The target weight decided at the bar's close; None: no decision at this bar."""


class TrailingStop(Rule):
    """Long after a close above all of the last `entry` closes, until a close falls `stop` below the highest since then."""

    def __init__(self, entry: int = 20, stop: float = 0.1):
        self.past: deque[float] = deque(maxlen=entry)
        self.warmup, self.stop, self.top = entry, stop, None

    def on_bar(self, bar: Row) -> float | None:
        close = bar["close"]
        if close is None:
            return None
        if self.top is not None:
            self.top = max(self.top, close)
            if close < self.top * (1 - self.stop):
                self.top = None
        elif len(self.past) == self.past.maxlen and close > max(self.past):
            self.top = close
        self.past.append(close)
        return 0.0 if self.top is None else 1.0


def rule_targets(bars: DataFrame, rule: Callable[[], Rule], at: str = "available_at") -> DataFrame:
    """symbol, ts, decided_at, weight: a new rule() for each symbol is shown its bars in the order of ts, one at a time.

    A table function with PARTITION BY symbol ORDER BY ts: a symbol's bars stream through one worker, so a rule holds its
    own memory and never the series. decided_at is the bar's column `at`. Bars without a symbol or ts are left out; bars of
    equal ts come in the order of `at`.
    """

    class Decide:
        def __init__(self):
            self.rule, self.seen = rule(), 0

        def eval(self, bar: Row):
            weight = self.rule.on_bar(bar)
            self.seen += 1
            if weight is not None and self.seen > self.rule.warmup:
                yield bar["symbol"], bar["ts"], bar[at], float(weight)

    decide = F.udtf(Decide, returnType="symbol string, ts timestamp, decided_at timestamp, weight double")
    known = bars.where("symbol IS NOT NULL AND ts IS NOT NULL")
    return decide(known.asTable().partitionBy("symbol").orderBy("ts", at))
