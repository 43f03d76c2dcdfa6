"""Velocity and bursts over a stream: the rows that operators.trailing gives for a batch, as their time becomes certain."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.trailing import SPANS, bursts, cents

DAY = 24 * 3_600_000_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Trailing(StatefulProcessor):
    """Keyed by account. Rows wait until the watermark has passed them, since an earlier row can still come until then;
    an event-time timer at the earliest waiting row settles all that are due. Settled rows stay as counts and sums by
    instant, one entry a day, as long as a window can reach them."""

    def __init__(self, id_type: str, spans: dict[str, int]):
        self.id_type, self.spans = id_type, spans

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"txn_id {self.id_type}, micros long, cents long")
        self.days = handle.getMapState("days", "day long", "micros array<long>, n array<long>, cents array<long>")
        self.alarm = handle.getValueState("alarm", "ms long")

    def _wake(self, micros: int) -> None:
        ms = -(-micros // 1000)  # the watermark has whole milliseconds
        now = self.alarm.get() if self.alarm.exists() else None
        if now is None or ms < now[0]:
            if now is not None:
                self.handle.deleteTimer(now[0])
            self.handle.registerTimer(ms)
            self.alarm.update((ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(r) for frame in rows for r in frame[["txn_id", "micros", "cents"]].itertuples(index=False)]
        self.waiting.appendList(new)
        self._wake(min(r[1] for r in new))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(((m, i, c) for i, m, c in self.waiting.get()), key=lambda r: r[0])
        due, rest = [r for r in rows if r[0] <= upto], [r for r in rows if r[0] > upto]
        self.alarm.clear()
        if rest:
            self.waiting.put([(i, m, c) for m, i, c in rest])
            self._wake(rest[0][0])
        else:
            self.waiting.clear()
        if due:
            yield self._settled(key, due, upto)

    def _settled(self, key, due: list[tuple], upto: int) -> pd.DataFrame:
        at, value = np.array([r[0] for r in due]), np.array([r[2] for r in due])
        kept = sorted((k[0], v) for k, v in self.days.iterator())
        old = [np.concatenate([np.array(v[j], dtype=np.int64) for _, v in kept] or [np.zeros(0, np.int64)]) for j in range(3)]
        when, back = np.unique(np.concatenate((old[0], at)), return_inverse=True)
        n = np.bincount(back, weights=np.concatenate((old[1], np.ones(len(at)))), minlength=len(when)).astype(np.int64)
        total = np.zeros(len(when), dtype=np.int64)
        np.add.at(total, back, np.concatenate((old[2], value)))
        self._keep(when, n, total, set((at // DAY).tolist()), upto)
        out = {"txn_id": [r[1] for r in due], "account_id": [key[0]] * len(due), "ts": pd.to_datetime(at, unit="us")}
        to = np.searchsorted(when, at, side="right")
        for name, span in self.spans.items():
            start = np.searchsorted(when, at - span, side="left")
            for column, x in ((f"n_{name}", n), (f"cents_{name}", total)):
                sums = np.concatenate(([0], np.cumsum(x)))
                out[column] = sums[to] - sums[start]
        return pd.DataFrame(out)

    def _keep(self, when: np.ndarray, n: np.ndarray, total: np.ndarray, touched: set[int], upto: int) -> None:
        oldest = upto - max(self.spans.values())  # rows to come are later than upto
        days = when // DAY
        for day in np.unique(days).tolist():
            own = days == day
            if when[own].max() < oldest:
                self.days.removeKey((day,))
            elif day in touched:
                self.days.updateValue((day,), (when[own].tolist(), n[own].tolist(), total[own].tolist()))


def trailing_stream(stream: DataFrame, late: str = "2 hours", spans: dict[str, int] | None = None) -> DataFrame:
    """trailing_counts() of a stream (txn_id, account_id, ts, amount): each row once, when the watermark has passed it.
    Rows later than `late` are dropped. State of an account: its instants of the longest span and what waits."""
    spark, spans = stream.sparkSession, spans or SPANS
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)  # the only store for keyed state with timers
    types = dict(stream.dtypes)
    rows = stream.where("ts IS NOT NULL").select("txn_id", "account_id", F.col("ts").cast("timestamp").alias("ts"), F.coalesce(cents(F.col("amount")), F.lit(0)).alias("cents")).withWatermark("ts", late)
    rows = rows.withColumn("micros", F.unix_micros("ts"))
    schema = f"txn_id {types['txn_id']}, account_id {types['account_id']}, ts timestamp" + "".join(f", n_{k} long, cents_{k} long" for k in spans)
    return rows.groupBy("account_id").transformWithStateInPandas(Trailing(types["txn_id"], spans), schema, "Append", "EventTime")


def bursts_stream(stream: DataFrame, late: str = "30 minutes", **how) -> DataFrame:
    """bursts() of a stream: a session comes out once the watermark has passed its end."""
    return bursts(stream.withWatermark("ts", late), **how)
