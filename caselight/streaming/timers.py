"""Keyed state with timers: due visits of courts that come out when their time has come, and jobs that leave after a day.

Both need the RocksDB state store: spark.sql.streaming.stateStore.providerClass =
org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider. Time is event time: a timer fires once the
stream's watermark has passed it, so a replay gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.schedule import ERROR, HIT, LONGEST, MISS
from ..session import ship

#: Hours after its last update that a job is kept.
KEPT = 24
_VISIT = "court string, kind string, failures int, at timestamp"
_JOB = "job string, kind string, status string, at timestamp"


def _ms(at: pd.Timestamp) -> int:
    return int(pd.Timestamp(at).value // 1_000_000)


def _rearm(handle: StatefulProcessorHandle, at: int) -> None:
    """One timer for each key: the new one instead of what there was."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    handle.registerTimer(at)


class _Visits(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "failures int, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        failures, seen = self.last.get() if self.last.exists() else (0, -(1 << 62))
        visits = sorted((_ms(at), str(result)) for piece in rows for at, result in zip(piece["at"], piece["result"], strict=True) if not pd.isna(at))
        wait = None
        for at, result in visits:
            if at <= seen:
                continue  # late or repeated: the court has been visited since
            failures, seen = failures + 1 if result == "error" else 0, at
            wait = HIT if result == "hit" else MISS if result == "miss" else min(ERROR * 1.5 ** (failures - 1), LONGEST)
        if wait is None:
            return
        due = seen + int(wait * 60_000)
        self.last.update((failures, seen))
        _rearm(self.handle, due)
        yield pd.DataFrame({"court": [key[0]], "kind": ["planned"], "failures": [failures], "at": [pd.Timestamp(due, unit="ms")]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        failures = self.last.get()[0] if self.last.exists() else 0
        yield pd.DataFrame({"court": [key[0]], "kind": ["due"], "failures": [failures], "at": [pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")]})

    def close(self) -> None:
        pass


class _Jobs(StatefulProcessor):
    def __init__(self, kept: int):
        self.kept = kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best = tuple(self.last.get()) if self.last.exists() else None
        before = best
        for piece in rows:
            for at, status in zip(piece["at"], piece["status"], strict=True):
                if not pd.isna(at) and (best is None or (_ms(at), str(status)) > (best[1], best[0])):
                    best = (str(status), _ms(at))
        if best is None or best == before:
            return
        self.last.update(best)
        _rearm(self.handle, best[1] + self.kept)
        yield pd.DataFrame({"job": [key[0]], "kind": ["kept"], "status": [best[0]], "at": [pd.Timestamp(best[1], unit="ms")]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        status = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame({"job": [key[0]], "kind": ["evicted"], "status": [status], "at": [pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")]})

    def close(self) -> None:
        pass


def visits(results: DataFrame, late: str = "0 seconds") -> DataFrame:
    """From a stream of (court, at, result): `planned` rows with the failures in a row and the next visit's time, and a `due` row when that time has come.

    A hit or a miss resets failures, errors wait 1.5 times longer each. Results not later than the last one known change
    nothing. One court's results of a batch are sorted in memory; a court is visited every few minutes.
    """
    ship(results.sparkSession)
    known = results.where("court is not null").select("court", "at", "result").withWatermark("at", late)
    return known.groupBy("court").transformWithStateInPandas(_Visits(), _VISIT, "Append", "EventTime")


def jobs(updates: DataFrame, late: str = "0 seconds", hours: int = KEPT) -> DataFrame:
    """From a stream of (job, at, status): `kept` rows with a job's latest status when it changes, and one `evicted` row when its state leaves, `hours` after its last update."""
    ship(updates.sparkSession)
    known = updates.where("job is not null").select("job", "at", "status").withWatermark("at", late)
    return known.groupBy("job").transformWithStateInPandas(_Jobs(hours * 3_600_000), _JOB, "Append", "EventTime")
