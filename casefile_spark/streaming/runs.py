"""Run liveness and live tallies over a stream of run events."""

from __future__ import annotations

import contextlib
import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.registry import ACTIVE, STALE_SECONDS, TERMINAL

OUT = "run_id string, matter_id long, status string, last_seen timestamp"
#: Event time for which a run that has ended is remembered, so that late beats cannot start it again.
KEEP_SECONDS = 30 * 86_400
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Start a stream with state variables and timers in here; they need the RocksDB store."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def _millis(at: pd.Timestamp) -> int:
    return int(pd.Timestamp(at).tz_localize("UTC").timestamp() * 1000) if pd.Timestamp(at).tz is None else int(pd.Timestamp(at).timestamp() * 1000)


def _timer(handle: StatefulProcessorHandle, at_ms: int, times: TimerValues) -> None:
    """The key's only timer; one that is due already fires with the next watermark."""
    for held in [*handle.listTimers()]:
        handle.deleteTimer(held)
    handle.registerTimer(max(at_ms, times.getCurrentWatermarkInMs() + 1))


class RunLiveness(StatefulProcessor):
    """State of one run: the first terminal state is final, and a timer reports silence.

    The timer runs ``STALE_SECONDS`` after the newest beat; once the run has ended it runs ``KEEP_SECONDS`` later and
    removes the state.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "matter_id long, status string, seen_ms long")

    def _report(self, key: tuple, matter: int, status: str, seen: int) -> pd.DataFrame:
        return pd.DataFrame({"run_id": [key[0]], "matter_id": [matter], "status": [status], "last_seen": [pd.Timestamp(seen, unit="ms")]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        matter, before, seen = self.run.get() if self.run.exists() else (None, None, None)
        newest, end = None, None
        for frame in rows:  # a busy run comes in several frames; only its extremes are kept
            frame = frame.sort_values(["at", "event_id"])
            matter = int(frame["matter_id"].iloc[0]) if matter is None else matter
            last = (frame["at"].iloc[-1], frame["event_id"].iloc[-1], frame["status"].iloc[-1])
            newest = max(newest, last) if newest else last
            ended = frame[frame["status"].isin(TERMINAL)]
            if len(ended):
                first = (ended["at"].iloc[0], ended["event_id"].iloc[0], ended["status"].iloc[0])
                end = min(end, first) if end else first
        status = before if before in TERMINAL else (end or newest)[2]
        seen = _millis(newest[0]) if seen is None else max(seen, _millis(newest[0]))
        self.run.update((matter, status, seen))
        _timer(self.handle, seen + 1000 * (STALE_SECONDS if status in ACTIVE else KEEP_SECONDS), timerValues)
        if status != before:
            yield self._report(key, matter, status, seen)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.run.exists():
            return
        matter, status, seen = self.run.get()
        if status not in ACTIVE:
            self.run.clear()
            return
        self.run.update((matter, "interrupted", seen))
        self.handle.registerTimer(max(seen + 1000 * KEEP_SECONDS, timerValues.getCurrentWatermarkInMs() + 1))
        yield self._report(key, matter, "interrupted", seen)

    def close(self) -> None:
        pass


class ActiveRun(StatefulProcessor):
    """At most one active run per matter: a run that starts meanwhile is told the holder's id.

    The holder gives the matter up with its first terminal state, or after ``STALE_SECONDS`` without a beat. Beats of runs
    that don't hold the matter change nothing. State is one run per matter; a micro-batch's events count in order of time.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.holder = handle.getValueState("holder", "run_id string, seen_ms long")
        self.known = handle.getMapState("known", "run_id string", "granted boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        holder, seen = self.holder.get() if self.holder.exists() else (None, 0)
        out = []
        for frame in sorted_frames(rows):
            for run, status, at in zip(frame["run_id"], frame["status"], frame["at"]):
                now = _millis(at)
                if holder is not None and now - seen > 1000 * STALE_SECONDS:
                    holder = None
                if holder == run:
                    holder, seen = (None if status in TERMINAL else run), max(seen, now)
                elif status in ACTIVE and not self.known.containsKey((run,)):
                    if holder is None:
                        holder, seen = run, now
                    self.known.updateValue((run,), (holder == run,))
                    out.append((int(key[0]), run, holder, holder == run, at))
        if holder is None:
            self.holder.clear()
        else:
            self.holder.update((holder, seen))
        _timer(self.handle, (seen or timerValues.getCurrentWatermarkInMs()) + 1000 * KEEP_SECONDS, timerValues)
        if out:
            yield pd.DataFrame(out, columns=["matter_id", "run_id", "holder", "granted", "at"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Nothing has come for so long that the matter is forgotten."""
        self.holder.clear()
        self.known.clear()
        return iter([])

    def close(self) -> None:
        pass


def sorted_frames(frames: Iterator[pd.DataFrame]) -> list[pd.DataFrame]:
    """The rows of one key and micro-batch in order of time; event ids settle ties."""
    held = [*frames]
    return [pd.concat(held).sort_values(["at", "event_id"])] if held else []


def run_liveness(events: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Status changes per run: queued, running, a terminal state, or interrupted after silence.

    events: run_id, matter_id, status, at, event_id. Start the stream within ``keyed_state``.
    """
    return events.withWatermark("at", late).groupBy("run_id").transformWithStateInPandas(RunLiveness(), OUT, "append", "EventTime")


def active_runs(events: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Every run's start with the run that holds the matter then: matter_id, run_id, holder, granted, at."""
    out = "matter_id long, run_id string, holder string, granted boolean, at timestamp"
    return events.withWatermark("at", late).groupBy("matter_id").transformWithStateInPandas(ActiveRun(), out, "append", "EventTime")


def activity_spells(events: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Spells of activity per run, closed by a silence of the stale limit."""
    return (
        events.withWatermark("at", late)
        .groupBy("run_id", F.session_window("at", f"{STALE_SECONDS} seconds").alias("_w"))
        .agg(F.count("*").alias("beats"), F.max("at").alias("last_seen"))
        .select("run_id", F.col("_w.start").alias("started_at"), "last_seen", "beats")
    )


def run_tally(progress: DataFrame) -> DataFrame:
    """Live totals per run. progress: run_id, batch_no, input_tokens, output_tokens, cost_usd."""
    return progress.groupBy("run_id").agg(
        F.max("batch_no").alias("batches_done"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.when(F.count("cost_usd") == F.count("*"), F.sum("cost_usd")).alias("cost_usd"),
    )
