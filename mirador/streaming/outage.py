"""Endpoint outage (circuit) state over runs of equal outcomes.

An endpoint's state is (streak, probes, blocked): failures in a row while it is closed,
successes still wanted while it is half open, and the time until which an open one rejects.
Outcomes are taken in time order, a run of equal outcomes at a time, and a run is decided in
jumps: the successes that probe, the failures that fill the streak, the outcomes before
``blocked``. So the work grows with runs and reopenings, and arrays do the rest.

``outage_stream`` keeps the state of a key and its pending outcomes in the state store
(``transformWithState``): outcomes are put in event-time order among all pending ones before
they are folded, and settle when the watermark has passed them. Until then a late outcome
changes the decisions after it, which are emitted again; the update log keeps the last ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from mirador.functions import lookups as L

CLOSED, HALF_OPEN, OPEN = 0, 1, 2
NAMES = np.array(["closed", "half_open", "open"], object)
START = (0, 0, None)
RESET_US = L.OUTAGE_RESET_SECONDS * 1_000_000


def fold(state: tuple, ts: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    """(allowed, state after, end state) of one key's outcomes in time order."""
    streak, probes, blocked = state
    n = len(ts)
    allowed, after = np.ones(n, bool), np.zeros(n, np.int8)
    starts = np.flatnonzero(np.append(True, ok[1:] != ok[:-1])) if n else np.zeros(0, np.int64)
    for a, b in zip(starts.tolist(), np.append(starts[1:], n).tolist()):
        while a < b:
            if blocked is not None:
                k = a + int(np.searchsorted(ts[a:b], blocked))
                allowed[a:k], after[a:k] = False, OPEN
                a = k
                if a < b:
                    blocked, probes = None, L.OUTAGE_HALF_OPEN_SUCCESSES
            elif ok[a]:
                k = a + min(probes, b - a)
                after[a:k] = HALF_OPEN
                probes -= k - a
                if not probes:
                    if k > a:
                        after[k - 1] = CLOSED              # the last probe closes it
                    streak = 0
                a = b
            else:
                k = a + (1 if probes else min(L.OUTAGE_FAILURE_THRESHOLD - streak, b - a))
                streak += k - a
                if probes or streak >= L.OUTAGE_FAILURE_THRESHOLD:
                    after[k - 1], blocked, probes = OPEN, int(ts[k - 1]) + RESET_US, 0
                a = k
    return allowed, after, (streak, probes, blocked)


def decided(key, ts: np.ndarray, event_id: np.ndarray, allowed: np.ndarray, after: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"key": key, "event_id": event_id, "ts": ts.astype("datetime64[us]"),
                         "decision": np.where(allowed, "allowed", "rejected"), "state": NAMES[after]})


def micros(ts: pd.Series) -> np.ndarray:
    """Microseconds since the epoch (UTC) of a column with or without a time zone."""
    if getattr(ts.dt, "tz", None) is not None:
        ts = ts.dt.tz_convert("UTC").dt.tz_localize(None)
    return ts.astype("datetime64[us]").astype("int64").to_numpy()


class Outages(StatefulProcessor):
    """Per key: the circuit at the watermark and the outcomes that are not settled yet."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.circuit = handle.getValueState("circuit", "streak long, probes long, blocked long")
        self.pending = handle.getListState("pending", "ts long, event_id long, ok boolean")

    def held(self) -> tuple[tuple, np.ndarray, np.ndarray, np.ndarray]:
        state = tuple(self.circuit.get()) if self.circuit.exists() else START
        rows = list(self.pending.get()) if self.pending.exists() else []
        ts, ids, ok = zip(*rows) if rows else ((), (), ())
        return state, np.array(ts, np.int64), np.array(ids, np.int64), np.array(ok, bool)

    def settle(self, state, ts, ids, ok, watermark_us: int) -> None:
        """Fold what lies before the watermark for good, keep the rest."""
        k = int(np.searchsorted(ts, watermark_us))
        if k:
            _, _, state = fold(state, ts[:k], ok[:k])
            self.circuit.update(state)
        if k < len(ts):
            self.pending.put(list(zip(ts[k:].tolist(), ids[k:].tolist(), ok[k:].tolist())))
            self.handle.registerTimer(int(ts[-1]) // 1000 + 1)
        elif self.pending.exists():
            self.pending.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, ts, ids, ok = self.held()
        for pdf in rows:
            ts = np.append(ts, micros(pdf["ts"]))
            ids, ok = np.append(ids, pdf["event_id"].to_numpy()), np.append(ok, pdf["ok"].to_numpy().astype(bool))
        order = np.lexsort((ids, ts))
        ts, ids, ok = ts[order], ids[order], ok[order]
        allowed, after, _ = fold(state, ts, ok)
        self.settle(state, ts, ids, ok, timerValues.getCurrentWatermarkInMs() * 1000)
        yield decided(key[0], ts, ids, allowed, after)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.settle(*self.held(), timerValues.getCurrentWatermarkInMs() * 1000)
        yield from ()

    def close(self) -> None:
        pass
