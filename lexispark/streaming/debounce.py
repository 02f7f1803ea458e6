"""Signals gathered into bursts, so that a file that is saved ten times in a row is indexed once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lexispark.operators.segments import SegmentedCorpus
from lexispark.runtime import checkpointed

#: Milliseconds of quiet after which a burst is over.
QUIET = 2000
_STATE = "firsts array<long>, lasts array<long>, counts array<long>"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def joined(bursts: list[tuple[int, int, int]], quiet: int, restart: bool) -> list[tuple[int, int, int]]:
    """Bursts (first, last, signals) in order, those that belong together as one.

    With `restart` each signal starts the wait anew, so a burst ends after `quiet` without one; else it ends `quiet` after its first.
    """
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted(bursts):
        if out and first < (out[-1][1] if restart else out[-1][0]) + quiet:
            out[-1] = out[-1][0], max(out[-1][1], last), out[-1][2] + n
        else:
            out.append((first, last, n))
    return out


class Debouncer(StatefulProcessor):
    """Keeps a path's open bursts and one timer, for the first that will be over; a burst is a row when the time has come.

    With times of their own (event time) signals may come in any order within the watermark: bursts that a late
    signal ties together become one. Without, a signal counts as of when it is processed.
    """

    def __init__(self, quiet: int, restart: bool, event_time: bool):
        self.quiet, self.restart, self.event_time = quiet, restart, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _STATE)

    def _held(self) -> list[tuple[int, int, int]]:
        state = self.open.get() if self.open.exists() else None
        return list(zip(*state)) if state is not None else []

    def _end(self, burst: tuple[int, int, int]) -> int:
        return (burst[1] if self.restart else burst[0]) + self.quiet

    def _hold(self, before: list, after: list) -> None:
        """Keep `after`, with one timer for the path: that of the burst that is over first."""
        was, now = (min((self._end(b) for b in x), default=None) for x in (before, after))
        if was != now:
            if was is not None:
                self.handle.deleteTimer(was)
            if now is not None:
                self.handle.registerTimer(now)
        if after:
            self.open.update(tuple(list(x) for x in zip(*after)))
        else:
            self.open.clear()

    def _rows(self, key, bursts: list) -> pd.DataFrame:
        times = [pd.to_datetime([b[k] for b in bursts], unit="ms", utc=True) for k in (0, 1)]
        return pd.DataFrame({"path": [key[0]] * len(bursts), "first": times[0], "last": times[1], "signals": [b[2] for b in bursts]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        bursts = list(held)
        for part in rows:
            if self.event_time:
                bursts = joined([*bursts, *part[["first", "last", "signals"]].itertuples(index=False, name=None)], self.quiet, self.restart)
            else:
                now = timerValues.getCurrentProcessingTimeInMs()
                bursts.append((now, now, int(part["signals"].sum())))
        self._hold(held, joined(bursts, self.quiet, self.restart))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, until = self._held(), expiredTimerInfo.getExpiryTimeInMs()
        until = max(until, timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs())
        over = [b for b in held if self._end(b) <= until]
        self._hold([], [b for b in held if self._end(b) > until])  # the timer that went off is gone
        if over:
            yield self._rows(key, over)

    def close(self) -> None:
        pass


def _combined(quiet: int):
    """Signals (path, ms) of a portion as bursts (path, first, last, signals), so that a busy path is a few rows in the shuffle."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = part.sort_values(["path", "ms"], kind="stable")
            new = (x["path"] != x["path"].shift()) | (x["ms"] - x["ms"].shift() >= quiet)
            yield x.groupby(new.cumsum()).agg(path=("path", "first"), first=("ms", "min"), last=("ms", "max"), signals=("ms", "size"))

    return run


@contextmanager
def _rocks(spark: SparkSession):
    """Timers need this state store, named when a stream is started."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def debounced(signals: DataFrame, path: str = "path", ts: str | None = None, late: str = "0 seconds", quiet: int = QUIET, restart: bool = True) -> DataFrame:
    """(path, first, last, signals) for each burst of a stream of signals, once it is over.

    Without `ts` the time is when a signal is processed and a burst is over after `quiet` milliseconds of the clock; with it, when
    the watermark (`late`) has passed its end. Signals without a path or, with `ts`, without a time are left out. One that
    comes after its burst is over begins another. `restart=False` ends a burst `quiet` after its first signal; a signal that
    comes out of order then joins whole bursts. Portions of signals are combined before the shuffle; state is one row a path
    with an open burst. Start it by `started`.
    """
    x = signals.filter(F.col(path).isNotNull())
    if ts is not None:
        x = x.filter(F.col(ts).isNotNull()).withColumn("__at", F.col(ts).cast("timestamp")).withWatermark("__at", late)
        ms = F.unix_millis("__at")
    else:
        ms = F.lit(0).cast("long")
    # with restart=False a burst's later signals must stay apart, as an earlier one may yet end it before them
    x = x.select(F.col(path).alias("path"), ms.alias("ms")).mapInPandas(_combined(quiet if restart else 1), "path string, first long, last long, signals long")
    kind = "EventTime" if ts is not None else "ProcessingTime"
    return x.groupBy("path").transformWithStateInPandas(Debouncer(quiet, restart, ts is not None), "path string, first timestamp, last timestamp, signals long", "Append", kind)


def started(bursts: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None] | None = None, table: str | None = None, **trigger) -> StreamingQuery:
    """Start a stream of bursts, into a function of (batch, number) or a Parquet table."""
    out = bursts.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True})
    out = out.foreachBatch(handle) if handle else out.format("parquet").option("path", table)
    with _rocks(bursts.sparkSession):
        return out.start()


def reindex_stream(signals: DataFrame, corpus: SegmentedCorpus, read: Callable[[DataFrame], DataFrame], checkpoint: str, quiet: int = QUIET, restart: bool = True, ts: str | None = None, **trigger) -> StreamingQuery:
    """Bring an index up to date in the background: each micro-batch of bursts that are over is one version of a corpus.

    `read` gives the docs of some paths (path) as they are now; paths without any are gone. Versions are numbered by
    micro-batches on top of what there was when the checkpoint began, which the corpus remembers, so a batch that is run again
    after a restart changes nothing.
    """
    mark = "streams/" + checkpoint.strip("/").replace("/", "_").replace(":", "_")
    corpus.files.commit(mark, str(corpus.version().number))
    base = int(corpus.files.read(mark))

    def apply(batch: DataFrame, number: int) -> None:
        if base + 1 + number in corpus.versions() or batch.isEmpty():
            return
        paths = checkpointed(batch.select("path").distinct())
        docs = checkpointed(read(paths))
        corpus.apply(docs, paths.join(docs.select("path"), "path", "left_anti"), base + 1 + number)

    trigger = trigger or {"processingTime": "1 second"}
    return started(debounced(signals, ts=ts, quiet=quiet, restart=restart), checkpoint, handle=apply, **trigger)
