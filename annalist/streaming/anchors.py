"""Anchors written by a stream: each subject's newest entry is state, and timers at the ends of intervals emit it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.anchors import FULL_EVERY, INTERVAL
from ..operators.history import REMOVALS

OUT = "history string, subject string, anchor long, full boolean, size long"
#: What a removed subject's size is in state, where null isn't told from zero.
GONE = -1


class AnchorWriter(StatefulProcessor):
    """State of one subject: the newest operation of each interval that isn't written yet, and the entry that the last anchor has.

    A timer stands at the end of each such interval, and at the next full anchor as long as the subject exists; when the
    watermark passes it, all that is due is emitted in order. So the state is a row a subject, and a few more while it is written to.
    """

    def __init__(self, interval: int, full_every: int, first: int):
        self.interval, self.full_every, self.first = interval, full_every, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "anchor long", "sequence long, size long")
        self.entry = handle.getValueState("entry", "size long, done long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest: dict[int, tuple[int, int]] = {}
        for df in rows:
            for anchor, sequence, size in zip(df["anchor"].tolist(), df["sequence"].tolist(), df["size"].tolist()):
                newest[anchor] = max((sequence, size), newest.get(anchor, (sequence, size)))
        for anchor, (sequence, size) in newest.items():
            if self.waiting.containsKey((anchor,)):
                sequence, size = max((sequence, size), tuple(self.waiting.getValue((anchor,))))
            self.waiting.updateValue((anchor,), (sequence, size))
            self.handle.registerTimer(self._end(anchor))
        yield from ()

    def _end(self, anchor: int) -> int:
        return -(-(anchor + 1) * self.interval // 1000)  # milliseconds, rounded up

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        due = sorted(a[0] for a in self.waiting.keys() if self._end(a[0]) <= passed)
        size, done = self.entry.get() if self.entry.exists() else (GONE, self.first - 1)
        out = []
        for anchor in [*due, None]:
            # full anchors that passed since the last entry, as the subject was then
            after = (done // self.full_every + 1) * self.full_every
            while size != GONE and (anchor is None or after < anchor) and self._end(after) <= passed:
                out.append((after, True, size))
                done, after = after, after + self.full_every
            if anchor is None:
                break
            size, done = tuple(self.waiting.getValue((anchor,)))[1], anchor
            self.waiting.removeKey((anchor,))
            full = anchor % self.full_every == 0 or anchor == self.first
            if size != GONE or not full:
                out.append((anchor, full, size))
        if size != GONE:
            self.entry.update((size, done))
            self.handle.registerTimer(self._end((done // self.full_every + 1) * self.full_every))
        elif self.entry.exists():
            self.entry.clear()
        if out:
            history, subject = key
            anchors, fulls, sizes = zip(*out)
            sizes = pd.array([None if s == GONE else s for s in sizes], dtype="Int64")
            yield pd.DataFrame({"history": [history] * len(out), "subject": [subject] * len(out), "anchor": anchors, "full": fulls, "size": sizes})


def anchor_stream(ops: DataFrame, first: int, interval: int = INTERVAL, full_every: int = FULL_EVERY, late: str = "10 minutes") -> DataFrame:
    """The rows of operators.anchors.written() as a stream of operations gives them, once the watermark has passed an interval's end.

    The session's state store must be RocksDB's, as transformWithState asks for it. Operations later than `late` are dropped.
    """
    gone = F.col("verb").isin(*REMOVALS)
    rows = ops.withColumn("at", F.timestamp_micros("microtime")).withWatermark("at", late)
    rows = rows.select(F.col("realm").alias("history"), "subject", "at", F.expr(f"microtime div {interval}").alias("anchor"), "sequence", F.when(gone, GONE).otherwise(F.coalesce("payload_length", F.lit(0))).cast("long").alias("size"))
    return rows.where(F.col("anchor") >= first).groupBy("history", "subject").transformWithStateInPandas(AnchorWriter(interval, full_every, first), OUT, "Append", "EventTime")
