"""Failure streaks as mergeable summaries in the state store.

A key's summary is its last success, the failures after it and the number of events. Summaries
merge: the later success wins and keeps the failures behind it, from either side. Failures that
the watermark has passed can no longer be undone by a late success before them, so only their
number is kept; the later ones keep their places. A micro-batch's rows are reduced to such a
summary with array operations, a batch of rows at a time; a key is never held whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from mirador.streaming.outage import micros

NEVER = (-2 ** 63, -2 ** 63)


class Failures(StatefulProcessor):
    def __init__(self, key: str) -> None:
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.summary = handle.getValueState(
            "summary", "ok_ts long, ok_id long, settled long, settled_last long, events long")
        self.open = handle.getListState("open", "ts long, event_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        had = tuple(self.summary.get()) if self.summary.exists() else (*NEVER, 0, None, 0)
        last_ok, settled, settled_last, events = (had[0], had[1]), had[2], had[3], had[4]
        held = np.array(list(self.open.get()) if self.open.exists() else [], np.int64).reshape(-1, 2)
        for pdf in rows:
            place = np.stack([micros(pdf["ts"]), pdf["event_id"].to_numpy().astype(np.int64)], axis=1)
            failed = pdf["failed"].to_numpy().astype(bool)
            events += len(pdf)
            if (~failed).any():
                good = place[~failed]
                newest = tuple(good[np.lexsort((good[:, 1], good[:, 0]))[-1]].tolist())
                if newest > last_ok:
                    last_ok, settled, settled_last = newest, 0, None      # it lies behind the watermark
            held = np.concatenate([held, place[failed]])
            held = held[(held[:, 0] > last_ok[0]) | ((held[:, 0] == last_ok[0]) & (held[:, 1] > last_ok[1]))]
        latest = max([t for t in (settled_last, int(held[:, 0].max()) if len(held) else None) if t is not None], default=None)
        yield pd.DataFrame({self.key: [key[0]], "consecutive_failures": [settled + len(held)],
                            "last_failure": pd.to_datetime([latest], unit="us"), "events": [events]})
        passed = held[:, 0] < timerValues.getCurrentWatermarkInMs() * 1000
        if passed.any():
            settled += int(passed.sum())
            settled_last = max(settled_last or 0, int(held[passed, 0].max()))
        self.summary.update((*last_ok, settled, settled_last, events))
        if passed.all():
            self.open.clear()
        else:
            self.open.put([tuple(r) for r in held[~passed].tolist()])

    def close(self) -> None:
        pass
