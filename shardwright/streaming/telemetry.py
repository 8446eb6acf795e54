"""Live rolling rate and throttled emission on Structured Streaming.

Per-run state with ``applyInPandasWithState``. A micro-batch of a run is one NumPy
computation: the rate of a sample is taken against the earliest sample of its
segment (samples since the last rewind) inside the trailing window, or against
the sample before it when the window holds no other; a throttle jumps from one
emitted row to the next by binary search. State is the segment's samples of the
last window (rate) or one time (throttle). With ``idle_ms`` the state of a run that
has been silent for so long is dropped (Spark then runs empty batches to notice);
without it a run is remembered for as long as the query lives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shardwright.operators.throttle import emitted

RATE_OUT = "run_id long, seq long, us long, units double, rate double, elapsed_s double"
RATE_STATE = "us array<long>, units array<double>"
GATE_OUT = "run_id long, seq long, us long, units double"
GATE_STATE = "last_us long"


def rates(us: np.ndarray, units: np.ndarray, window_us: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rate, elapsed seconds and index of the compared sample, for samples in time order."""
    i = np.arange(len(us))
    begin = np.maximum.accumulate(np.where(np.diff(units, prepend=units[:1]) < 0, i, 0))
    against = np.maximum(np.searchsorted(us, us - window_us, "left"), begin)
    against = np.where((against == i) & (i > begin), i - 1, against)
    elapsed = (us - us[against]) / 1e6
    gained = np.maximum(0.0, units - units[against])
    return np.divide(gained, elapsed, out=np.zeros(len(us)), where=elapsed > 0), elapsed, against


def _timeout(idle_ms: int | None) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout


def _rows(pdfs: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(pdfs)).sort_values(["us", "seq"], ignore_index=True)


def rolling_rate_stream(counters: DataFrame, window_s: float = 30.0, idle_ms: int | None = None) -> DataFrame:
    """Streaming W1: same numbers as the batch ``rolling_rate`` for rows that arrive in time order."""
    if window_s <= 0:
        raise ValueError("a rate needs a window longer than zero seconds")
    window_us = int(round(window_s * 1_000_000))

    def update(key, pdfs: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        new = _rows(pdfs)
        old_us, old_units = state.get if state.exists else ([], [])
        us = np.maximum.accumulate(np.concatenate((np.asarray(old_us, np.int64), new["us"].to_numpy(np.int64))))
        units = np.concatenate((np.asarray(old_units, float), new["units"].to_numpy(float)))
        rate, elapsed, _ = rates(us, units, window_us)
        rewinds = np.flatnonzero(np.diff(units) < 0)
        keep = max(int(np.searchsorted(us, us[-1] - window_us, "left")), int(rewinds[-1]) + 1 if len(rewinds) else 0)
        state.update((us[keep:].tolist(), units[keep:].tolist()))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        n = len(old_us)
        yield pd.DataFrame({"run_id": int(key[0]), "seq": new["seq"], "us": new["us"], "units": units[n:],
                            "rate": rate[n:], "elapsed_s": elapsed[n:]})

    return counters.groupBy("run_id").applyInPandasWithState(
        update, RATE_OUT, RATE_STATE, "append", _timeout(idle_ms))


def throttle_stream(rows: DataFrame, gap_s: float = 0.5, target: float | None = None, idle_ms: int | None = None) -> DataFrame:
    """Streaming W5: emit a row when ``gap_s`` passed since the last emitted
    one, or when ``units`` reached ``target``."""
    gap_us = int(round(gap_s * 1_000_000))

    def update(key, pdfs: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        new = _rows(pdfs)
        us, units = new["us"].to_numpy(np.int64), new["units"].to_numpy(float)
        due = units >= target if target is not None else np.zeros(len(us), bool)
        last = int(state.get[0]) if state.exists else None
        out = emitted(us, due, gap_us, last)
        if len(out):
            last = int(us[out[-1]])
        state.update((last,))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"run_id": int(key[0]), "seq": new["seq"].to_numpy()[out], "us": us[out], "units": units[out]})

    return rows.groupBy("run_id").applyInPandasWithState(
        update, GATE_OUT, GATE_STATE, "append", _timeout(idle_ms))
