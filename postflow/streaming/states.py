"""Stateful processors and functions: one state for each key, kept by the state store, with event-time timers that give out what time brings about.

What must happen later (a posting is retired, a cooldown ends, a key is forgotten) is a timer of its key: it fires once the watermark has
passed it, whether or not the key has rows then. If rows of the key come first, they settle what was due before them, so that answers
do not depend on how rows fall into batches. A key's state goes when nothing of it is needed any more.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000  # a run's number stands for a day of event time


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, by key and on disk; the session's own setting comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def processed(df: DataFrame, keys: list[str], processor: StatefulProcessor) -> DataFrame:
    """What a processor makes of a watermarked stream, in append mode and event time."""
    return df.groupBy(*keys).transformWithState(processor, processor.SCHEMA, "append", "eventTime")


class Absences(StatefulProcessor):
    """Items (key, item) seen in numbered runs: (key, item, at, missed, kind), for groups by key and, if keys have many items, ranges of items.

    `seen`: seen in run `at`, after `missed` runs without it (-1: new, or forgotten). `retired`: run `at` was the `grace`-th in a row
    without it. With `forget` (more than grace), an item is forgotten after as many. State: of each item of the group the run it was
    last in and whether it is retired, in one value, as the store is asked from Python call by call; and the group's one timer, for
    what is due first.
    """

    SCHEMA = "key bigint, item bigint, at bigint, missed bigint, kind string"

    def __init__(self, grace: int = 2, forget: int | None = None):
        self.grace, self.forget = grace, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "due bigint, items array<bigint>, last array<bigint>, retired array<boolean>")

    def _due(self, at: int, retired: bool) -> int | None:
        """When something becomes of an item: at its retirement, then at its end."""
        wait = self.forget if retired else self.grace
        return None if wait is None else (at + wait) * DAY_MS

    def _load(self) -> tuple[int | None, dict[int, tuple[int, bool]]]:
        due, *columns = self.held.get() or (None, [], [], [])
        return due, {item: (last, retired) for item, last, retired in zip(*columns)}

    def _keep(self, before: int | None, items: dict[int, tuple[int, bool]]) -> None:
        due = min((d for x in items.values() if (d := self._due(*x)) is not None), default=None)
        if before is not None and before != due:
            self.handle.deleteTimer(before)
        if due is not None and before != due:
            self.handle.registerTimer(due)
        if items:
            self.held.update((due, list(items), [last for last, _ in items.values()], [retired for _, retired in items.values()]))
        else:
            self.held.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        due, items = self._load()
        runs: dict[int, set[int]] = {}
        for r in rows:
            runs.setdefault(r["item"], set()).add(r["at"])
        for item, seen in runs.items():
            last, retired = items.get(item, (None, False))
            for at in sorted(seen):
                gap = -1 if last is None else at - last - 1
                if gap >= self.grace and not retired:
                    yield Row(key=key[0], item=item, at=last + self.grace, missed=self.grace, kind="retired")
                known = self.forget is None or gap < self.forget
                yield Row(key=key[0], item=item, at=at, missed=gap if known else -1, kind="seen")
                last, retired = at, False
            items[item] = (last, False)
        self._keep(due, items)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        _, items = self._load()
        for item, (last, retired) in list(items.items()):
            if not retired and self._due(last, False) <= now:
                yield Row(key=key[0], item=item, at=last + self.grace, missed=self.grace, kind="retired")
                retired = True
                items[item] = (last, True)
            if retired and self.forget is not None and self._due(last, True) <= now:
                del items[item]
        self._keep(None, items)


SIGHTING = ("key", "item", "at")


def _packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False).replace_schema_metadata(None)
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(held: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(held).read_all().to_pandas()


def absences(df: DataFrame, bundle: str, grace: int | None = None, forget: int | None = None) -> DataFrame:
    """As Absences, for streams of (key, item, at) with many items: (key, item, at, missed) in append mode and event time.

    Items are dealt into bundles, whose state is one value and one timer: each item's last run. A bundle's rows are settled as arrays, as a
    call for each row or item costs more than all else. With `grace` retired items are given out, and an item goes when it is retired, for it is as
    good as new if it is seen again; without it items that are seen are, and they go after `forget` runs, if that is given.
    """
    wait = forget if grace is None else grace

    def settle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = _unpacked(state.get[0]) if state.exists else pd.DataFrame({c: np.zeros(0, np.int64) for c in SIGHTING})
        new = [] if state.hasTimedOut else [b[list(SIGHTING)] for b in batches]
        rows = pd.concat([held, *(b.drop_duplicates() for b in new)], ignore_index=True)
        rows = pd.concat([rows, pd.Series(np.arange(len(rows)) >= len(held), name="fresh")], axis=1).sort_values([*SIGHTING, "fresh"], ignore_index=True)
        rows = rows[~(rows["fresh"] & rows.duplicated([*SIGHTING, "fresh"]))] if len(new) > 1 else rows
        k, item, at, fresh = (rows[c].to_numpy() for c in (*SIGHTING, "fresh"))
        again = np.r_[False, (k[1:] == k[:-1]) & (item[1:] == item[:-1])] if len(k) else np.zeros(0, bool)
        gap = np.where(again, at - np.r_[0, at[:-1]][: len(at)] - 1, -1)
        if grace is None:
            told = pd.DataFrame({"key": k, "item": item, "at": at, "missed": gap if forget is None else np.where(gap < forget, gap, -1)})[fresh]
        else:
            told = pd.DataFrame({"key": k, "item": item, "at": at - 1 - gap + grace, "missed": grace})[fresh & (gap >= grace)]
        left = rows.loc[~np.r_[again[1:], False] if len(k) else again, list(SIGHTING)]
        now = state.getCurrentWatermarkMs()
        if wait is not None:
            gone = ((left["at"] + wait) * DAY_MS <= now).to_numpy()
            if grace is not None:
                told = pd.concat([told, left[gone].assign(at=left["at"] + grace, missed=grace)], ignore_index=True)
            left = left[~gone]
        if len(left):
            state.update((_packed(left),))
            if wait is not None:
                state.setTimeoutTimestamp(int(left["at"].min() + wait) * DAY_MS)
        elif state.exists:
            state.remove()
        yield told

    return df.groupBy(bundle).applyInPandasWithState(settle, "key bigint, item bigint, at bigint, missed bigint", "held binary", "append", GroupStateTimeout.EventTimeTimeout)


class Breakers(StatefulProcessor):
    """Refusals of a user among its requests: (event_id, user_id, streak, cooldown, kind, at).

    `refused`: the streak-th refusal in a row, and the seconds to stay away, which double from `first` up to `longest`. `released`: the
    cooldown that refusal event_id set has ended, and no later refusal came before its end. State: the streak, and the cooldown in
    force; a user with neither has no state. Times (`us` of a row, `at`) are microseconds: timestamps come back from the state without
    the zone that those of rows may have.
    """

    SCHEMA = "event_id bigint, user_id bigint, streak bigint, cooldown bigint, kind string, at bigint"

    def __init__(self, refusal: str = "error", first: int = 60, longest: int = 3600):
        self.refusal, self.first, self.longest = refusal, first, longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "streak bigint, cooldown bigint, event_id bigint, until bigint")

    @staticmethod
    def _fires(until: int) -> int:
        """The millisecond at which a cooldown is surely over."""
        return -(-until // 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        streak, cooldown, event, until = self.now.get() if self.now.exists() else (0, None, None, None)
        if until is not None:
            self.handle.deleteTimer(self._fires(until))
        for r in sorted(rows, key=lambda r: (r["us"], r["event_id"])):
            if until is not None and until <= r["us"]:
                yield Row(event_id=event, user_id=key[0], streak=streak, cooldown=cooldown, kind="released", at=until)
                until = None
            if r["event_type"] != self.refusal:
                streak = 0
                continue
            streak, event = streak + 1, r["event_id"]
            cooldown = min(self.first << min(streak - 1, 40), self.longest)
            until = r["us"] + cooldown * 1_000_000
            yield Row(event_id=event, user_id=key[0], streak=streak, cooldown=cooldown, kind="refused", at=r["us"])
        yield from ()
        self._keep(streak, cooldown, event, until)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        streak, cooldown, event, until = self.now.get()
        yield Row(event_id=event, user_id=key[0], streak=streak, cooldown=cooldown, kind="released", at=until)
        self._keep(streak, cooldown, event, None)

    def _keep(self, streak: int, cooldown: int | None, event: int | None, until: int | None) -> None:
        if until is not None:
            self.handle.registerTimer(self._fires(until))
        if streak or until is not None:
            self.now.update((streak, cooldown, event, until))
        elif self.now.exists():
            self.now.clear()
