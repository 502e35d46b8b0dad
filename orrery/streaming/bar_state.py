"""Relative strength bar by bar: a stream of bars with state for each symbol gives the rows of the batch indicators."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a symbol's state holds: the last values of each moving mean, the smoothed range, the record, and the last bar's line, mean and zone.
STATE = "close double, rs array<double>, strengths array<double>, ranges array<double>, seed array<double>, atr double, atrs array<double>, record double, strength double, average double, diff double, zone string, seen timestamp"
BAR = "time timestamp, high double, low double, close double, bench double"
OUT = "symbol string, time timestamp, strength double, average double, threshold double, zone string, new_high boolean, crossed boolean, moved_far boolean, zone_changed boolean"

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _mean(values: list, n: int) -> float | None:
    return sum(values) / n if len(values) == n and None not in values else None


def _number(x) -> float | None:
    return None if x is None or x != x else float(x)


class Line:
    """One symbol's indicators; push() takes its bars in order of time."""

    def __init__(self, long: int, ma: int, atr: int, atr_ma: int, state: tuple | None = None):
        self.long, self.ma, self.n, self.atr_ma = long, ma, atr, atr_ma
        empty = (None, [], [], [], [], None, [], 0.0, None, None, None, None, None)
        (self.close, rs, strengths, ranges, seed, self.atr, atrs, self.record, self.strength, self.average, self.diff, self.zone, self.seen) = state or empty
        self.rs, self.strengths, self.ranges, self.seed, self.atrs = (list(x or []) for x in (rs, strengths, ranges, seed, atrs))

    def state(self) -> tuple:
        return (self.close, self.rs, self.strengths, self.ranges, self.seed, self.atr, self.atrs, self.record, self.strength, self.average, self.diff, self.zone, self.seen)

    def push(self, time: datetime, high: float, low: float, close: float, bench: float | None) -> tuple:
        rs = close / bench if close is not None and bench else None
        self.rs = [*self.rs, rs][-self.long :]
        mean = _mean(self.rs, self.long)
        strength = (rs / mean - 1) * 100 if rs is not None and mean else None
        self.strengths = [*self.strengths, strength][-self.ma :]
        average = _mean(self.strengths, self.ma)
        diff = abs(strength - average) if strength is not None and average is not None else None
        reach = [abs(a - b) for a, b in ((high, low), (high, self.close), (low, self.close)) if a is not None and b is not None]
        if reach:
            self._smooth(max(reach))
        self.atrs = [*self.atrs, self.atr][-self.atr_ma :]
        usual = _mean(self.atrs, self.atr_ma)
        threshold = 6 * (self.atr / usual) if self.atr is not None and usual else None
        zone = self._zone(strength, average, diff, threshold)
        new_high = strength is not None and strength > self.record
        crossed = None not in (strength, average, self.strength, self.average) and (strength > average and self.strength <= self.average or strength < average and self.strength >= self.average)
        far = diff is not None and threshold is not None and diff > threshold
        moved_far = far and self.diff is not None and self.diff <= threshold
        changed = self.zone is not None and zone != self.zone
        self.record = max(self.record, strength) if strength is not None else self.record
        self.close, self.strength, self.average, self.diff, self.zone, self.seen = close, strength, average, diff, zone, time
        return time, strength, average, threshold, zone, new_high, crossed, moved_far, changed

    def _smooth(self, reach: float) -> None:
        if self.atr is not None:
            self.atr += (reach - self.atr) / self.n
        else:
            self.seed.append(reach)
            if len(self.seed) == self.n:
                self.atr, self.seed = sum(self.seed) / self.n, []

    @staticmethod
    def _zone(strength, average, diff, threshold) -> str:
        if None in (strength, average, diff, threshold) or diff <= threshold:
            return "Neutral"
        return ("Strong " if diff > threshold * 1.5 else "Mild ") + ("Bull" if strength > average else "Bear")


class BarState(StatefulProcessor):
    """Bars wait until the watermark has passed them, then go through their symbol's line in order of time.

    So bars may come in any order inside the watermark's delay. Of bars with
    one symbol and time the first by its values counts. A bar that is not later
    than the last one that went through is late: it is left out, as its rows
    have been written.
    """

    def __init__(self, long: int, ma: int, atr: int, atr_ma: int):
        self.sizes = (long, ma, atr, atr_ma)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.line = handle.getValueState("line", STATE)
        self.waiting = handle.getListState("waiting", BAR)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = self.line.get()[-1] if self.line.exists() else None
        timers = set()
        for part in rows:
            for r in part[["time", "high", "low", "close", "bench"]].itertuples(index=False):
                time = pd.Timestamp(r.time).to_pydatetime()
                if seen is None or time > seen.replace(tzinfo=time.tzinfo):
                    self.waiting.appendValue((time, *(_number(x) for x in r[1:])))
                    timers.add(int(pd.Timestamp(time).tz_localize(time.tzinfo or "UTC").timestamp() * 1000) if time.tzinfo is None else int(time.timestamp() * 1000))
        for at in timers:
            self.handle.registerTimer(at)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = datetime.fromtimestamp(timerValues.getCurrentWatermarkInMs() / 1000, timezone.utc).replace(tzinfo=None)
        waiting = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[0], [(x is not None, x or 0) for x in r[1:]]))
        ready = [r for r in waiting if r[0].replace(tzinfo=None) <= passed]
        if not ready:
            return iter([])
        line = Line(*self.sizes, tuple(self.line.get()) if self.line.exists() else None)
        out = [(key[0], *line.push(*r)) for r in ready if line.seen is None or r[0].replace(tzinfo=None) > line.seen.replace(tzinfo=None)]
        self.line.update(line.state())
        rest = waiting[len(ready) :]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        return iter([pd.DataFrame(out, columns=[c.split(" ")[0] for c in OUT.split(", ")])]) if out else iter([])

    def close(self) -> None:
        pass


def strength_stream(bars: DataFrame, delay: str = "1 hour", long: int = 144, ma: int = 60, atr: int = 14, atr_ma: int = 100) -> DataFrame:
    """Rows of OUT for a stream (symbol, time, high, low, close, bench), each written once, when the watermark (the latest time less `delay`) has passed it.

    Strength, its average, threshold and zone as relative_strength() has them,
    whether strength is above its record, and the alerts of signals(). Rows
    without a symbol or time are left out. State is a few hundred numbers a symbol.
    """
    spark = bars.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = bars.where("symbol is not null and time is not null").select("symbol", "time", "high", "low", "close", "bench").withWatermark("time", delay)
    return rows.groupBy("symbol").transformWithStateInPandas(BarState(long, ma, atr, atr_ma), OUT, outputMode="Append", timeMode="EventTime")
