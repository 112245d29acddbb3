"""Split events over a stream: a code's state is the dates that were kept, and timers that forget them."""

from __future__ import annotations

import bisect
import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.splits import APART

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DAY = 86_400_000


def _day(ms: int) -> datetime.date:
    return datetime.date(1970, 1, 1) + datetime.timedelta(days=ms // _DAY)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["code", "split_date", "ratio"], dtype=object).astype({"ratio": float})


class KeptDates(StatefulProcessor):
    """Of a code's events, in the order of a batch's dates, each that no kept one lies within APART days of. A kept date is
    forgotten when the watermark says that no event within those days is awaited any more."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", "split_date date")

    def _keep(self, dates: list[datetime.date]) -> None:
        if dates:
            self.kept.put([(d,) for d in dates])
            first = (min(dates) - datetime.date(1970, 1, 1)).days + APART + 1
            self.handle.registerTimer(first * _DAY)
        else:
            self.kept.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = sorted(r[0].toordinal() for r in self.kept.get()) if self.kept.exists() else []
        new = sorted((date.toordinal(), ratio) for pdf in rows for date, ratio in zip(pdf["split_date"], pdf["ratio"], strict=True))
        out = []
        for day, ratio in new:  # only the kept dates on both sides of a day can be near it
            at = bisect.bisect_left(kept, day)
            if (at == 0 or day - kept[at - 1] > APART) and (at == len(kept) or kept[at] - day > APART):
                kept.insert(at, day)
                out.append((key[0], datetime.date.fromordinal(day), ratio))
        kept = [datetime.date.fromordinal(k) for k in kept]
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self._keep(kept)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = _day(timerValues.getCurrentWatermarkInMs())
        kept = [r[0] for r in self.kept.get()] if self.kept.exists() else []
        self._keep([d for d in kept if d + datetime.timedelta(days=APART) >= now])
        yield _frame([])

    def close(self) -> None:
        pass


def distinct_splits(events: DataFrame, late: str = "30 days") -> DataFrame:
    """A stream of events (code, split_date, ratio) as the plausible ones that are to be recorded: what dedup_events keeps,
    if batches come in the order of their dates. Events that are late by more than late don't count. The state store has to
    be one that has timers; the session is set to such a one."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    plausible = events.filter(F.col("ratio").between(0.02, 100) & (F.col("ratio") != 1))
    timed = plausible.select("code", "split_date", F.col("ratio").cast("double").alias("ratio"), F.col("split_date").cast("timestamp").alias("at")).withWatermark("at", late)
    return timed.groupBy("code").transformWithStateInPandas(KeptDates(), "code string, split_date date, ratio double", "Append", "EventTime")
