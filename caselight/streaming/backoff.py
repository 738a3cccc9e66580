"""Failures and the next visit of each court as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.schedule import ERROR, HIT, LONGEST, MISS


def visits(results: DataFrame) -> DataFrame:
    """From a stream of (court, at, result) the latest (court, failures, next_at) with each batch: a hit or miss resets failures, errors wait 1.5 times longer each, up to the longest wait."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("at")  # one court's visits within a batch
        wait = 0.0
        for result in rows["result"]:
            failures = failures + 1 if result == "error" else 0
            wait = HIT if result == "hit" else MISS if result == "miss" else min(ERROR * 1.5 ** (failures - 1), LONGEST)
        state.update((failures,))
        yield pd.DataFrame({"court": [key[0]], "failures": [failures], "next_at": [rows["at"].iloc[-1] + pd.Timedelta(minutes=wait)]})

    return results.groupBy("court").applyInPandasWithState(step, "court string, failures int, next_at timestamp", "failures int", "update", GroupStateTimeout.NoTimeout)
