"""Stability of files and folders as streams whose state ends: what isn't observed any more is forgotten after a time to live.

Both are stateful processors; the state store must be RocksDB (see STORE). Only observations let something through. An
observation without a size says that a path is gone, and clears what is known of it. A path that just stops being
observed keeps its state for the time to live from its last change of state, not for ever.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

#: What a session needs for these operators.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # else a query that should end goes on for ever to look for what has lived long enough
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
FILE_OUT, FOLDER_OUT = "path string, size bigint, observed_at timestamp", "root string, entries bigint, size bigint, observed_at timestamp"


def _observed(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(path, size, changed, at, observed_at) in the order of observation; size is none where the path is gone."""
    rows = pd.concat(list(batches)).sort_values("observed_at", kind="stable")
    for r in rows.itertuples():
        gone = r.size is None or pd.isna(r.size)
        yield r.path, None if gone else int(r.size), None if gone else r.changed_at.value / 1e9, r.observed_at.value / 1e9, r.observed_at


class FileStability(StatefulProcessor):
    """A file is let through when an observation shows the size and time of an earlier one so many seconds before."""

    def __init__(self, seconds: float, live_ms: int) -> None:
        self.seconds, self.live_ms = seconds, live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "size bigint, changed double, since double", self.live_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held, out = (self.run.get() if self.run.exists() else None), []
        for path, size, changed, at, observed in _observed(rows):
            if size is None:
                held = None
            elif held is None or (held[0], held[1]) != (size, changed):
                held = (size, changed, at)
            elif at - held[2] >= self.seconds:
                out.append((path, size, observed))
                held = None
        if held is None:
            self.run.clear()
        else:
            self.run.update(tuple(held))
        yield pd.DataFrame(out, columns=["path", "size", "observed_at"])

    def close(self) -> None:
        pass


class FolderStability(StatefulProcessor):
    """A folder is let through when none of its entries has come, changed or gone for so many seconds; the
    entries are a map, so that an observation reads and writes one of them."""

    def __init__(self, seconds: float, live_ms: int) -> None:
        self.seconds, self.live_ms = seconds, live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "path string", "size bigint, changed double", self.live_ms)
        self.run = handle.getValueState("run", "since double", self.live_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        since, out = (self.run.get()[0] if self.run.exists() else None), []
        for path, size, changed, at, observed in _observed(rows):
            before = self.entries.getValue((path,)) if self.entries.containsKey((path,)) else None
            if size is None:
                if before is not None:
                    self.entries.removeKey((path,))
                    since = at
            elif before is None or (before[0], before[1]) != (size, changed):
                self.entries.updateValue((path,), (size, changed))
                since = at
            elif since is not None and at - since >= self.seconds:
                sizes = [v[0] for v in self.entries.values()]
                out.append((key[0], len(sizes), sum(sizes), observed))
                since = None
        if since is None:
            self.run.clear()
        else:
            self.run.update((since,))
        yield pd.DataFrame(out, columns=["root", "entries", "size", "observed_at"])

    def close(self) -> None:
        pass


def stable_files(observations: DataFrame, seconds: float = 2.0, live_seconds: float = 3600.0) -> DataFrame:
    """Stream of (path, size, changed_at, observed_at) to (path, size, observed_at)."""
    return observations.groupBy("path").transformWithStateInPandas(FileStability(seconds, int(live_seconds * 1000)), FILE_OUT, "Append", "ProcessingTime")


def stable_folders(observations: DataFrame, seconds: float = 30.0, live_seconds: float = 3600.0) -> DataFrame:
    """Stream of (root, path, size, changed_at, observed_at) to (root, entries, size, observed_at)."""
    return observations.groupBy("root").transformWithStateInPandas(FolderStability(seconds, int(live_seconds * 1000)), FOLDER_OUT, "Append", "ProcessingTime")
