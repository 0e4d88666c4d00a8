"""Hosts that stop reporting and return, on the event time of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from lagscope.operators.rollups import interval_seconds
from lagscope.operators.silence import RETURNED, SILENT
from lagscope.streaming.changes import rocksdb_state


class _Hosts(StatefulProcessor):
    """Per host the stretches of beats that may still matter, at most ``length`` apart inside, and whether it counts as silent.

    An event comes out when the watermark has passed it: no beat that could undo it can still come.
    """

    def __init__(self, length: int):
        self.length = length

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("stretches", "silent boolean, firsts array<long>, lasts array<long>")

    def _read(self) -> tuple[bool, list[list[int]]]:
        if not self.state.exists():
            return False, []
        silent, firsts, lasts = self.state.get()
        return silent, [list(s) for s in zip(firsts, lasts)]

    def _write(self, silent: bool, stretches: list[list[int]]) -> None:
        self.state.update((silent, [s[0] for s in stretches], [s[1] for s in stretches]))
        due = self._due(silent, stretches)
        wanted = None if due is None else -(-due // 1000)
        timers = list(self.handle.listTimers())
        for timer in timers:
            if timer != wanted:
                self.handle.deleteTimer(timer)
        if wanted is not None and wanted not in timers:
            self.handle.registerTimer(wanted)

    def _due(self, silent: bool, stretches: list[list[int]]) -> int | None:
        """When the next event happens if nothing else comes, in microseconds."""
        if not stretches:
            return None
        return stretches[0][0] if silent else stretches[0][1] + self.length

    def handleInputRows(self, key, rows, timerValues):
        silent, stretches = self._read()
        merged: list[list[int]] = []
        for first, last in sorted([*stretches, *([r.us, r.us] for r in rows)]):
            if merged and first - merged[-1][1] <= self.length:
                merged[-1][1] = max(merged[-1][1], last)
            else:
                merged.append([first, last])
        self._write(silent, merged)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        silent, stretches = self._read()
        now = timerValues.getCurrentWatermarkInMs() * 1000
        while (due := self._due(silent, stretches)) is not None and due <= now:
            yield Row(host=key[0], event=RETURNED if silent else SILENT, us=due)
            if not silent:
                stretches.pop(0)
            silent = not silent
        self._write(silent, stretches)

    def close(self) -> None:
        pass


def watch_hosts(beats: DataFrame, host: str, ts: str, after: str, delay: str = "0 seconds") -> DataFrame:
    """A streaming table of the events of ``silences``, with timers on event time; beats may come up to ``delay`` late.

    State is a few numbers per host, whatever the number of beats. A host that never reports is seen if the stream has a row for it
    at the time since which it is expected. The session needs the RocksDB state store, which ``stream_silences`` sets.
    """
    kind = beats.schema[ts].dataType
    rows = beats.filter(F.col(host).isNotNull() & F.col(ts).isNotNull()).select(F.col(host).alias("host"), F.col(ts).cast("timestamp").alias("_ts"))
    timed = rows.withWatermark("_ts", delay).select("host", "_ts", F.unix_micros("_ts").alias("us"))
    schema = f"host {timed.schema['host'].dataType.simpleString()}, event string, us long"
    events = timed.groupBy("host").transformWithState(_Hosts(interval_seconds(after) * 1_000_000), schema, "Append", "EventTime")
    return events.select("host", "event", F.timestamp_micros("us").cast(kind).alias("at"))


def stream_silences(beats: DataFrame, host: str, ts: str, after: str, folder: str, delay: str = "0 seconds", available_now: bool = False):
    """Starts a query that writes ``watch_hosts`` to ``folder``/events, its state and position to ``folder``/checkpoint."""
    folder = folder.rstrip("/")
    with rocksdb_state(beats.sparkSession):
        writer = watch_hosts(beats, host, ts, after, delay).writeStream.format("parquet").option("path", f"{folder}/events").option("checkpointLocation", f"{folder}/checkpoint")
        return (writer.trigger(availableNow=True) if available_now else writer).start()
