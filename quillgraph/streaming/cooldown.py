"""Rules that cool down, on a stream: keyed state with event-time timers; the same firings as ``operators.analyze.cooled_down`` of the whole table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed state with timers needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Microseconds of matches that are one value of the state, and matches that are held until they are put there.
SPAN, HELD = 600_000_000, 1 << 20


def _least(us: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times in order, each once with its least id."""
    order = np.lexsort((ids, us))
    us, ids = us[order], ids[order]
    new = np.r_[True, us[1:] != us[:-1]][: len(us)]
    return us[new], ids[new]


def _unpacked(value: bytes) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(value, np.int64).reshape(2, -1))


class Cooldown(StatefulProcessor):
    """Per key: when it fired last, and the matches that the watermark hasn't passed, the least id of each time.

    Matches come out of order, so one is settled when the watermark reaches its time; what waits is bounded by the stream's lateness. A span of time is
    one value of the state, so calls of the state store follow the spans and not the matches.
    """

    def __init__(self, seconds: int) -> None:
        self.pause = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts long")
        self.waiting = handle.getMapState("waiting", "span long", "matches binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for part in rows:
            held.append((part["us"].to_numpy(np.int64), part["id"].to_numpy(np.int64)))
            n += len(part)
            if n >= HELD:
                self._put(held)
                held, n = [], 0
        if held:
            self._put(held)
        yield from self._settled(key, timerValues)

    def _put(self, held: list[tuple[np.ndarray, np.ndarray]]) -> None:
        us, ids = _least(*(np.concatenate(c) for c in zip(*held)))
        spans, first = np.unique(us // SPAN, return_index=True)
        for span, x, y in zip(spans.tolist(), np.split(us, first[1:]), np.split(ids, first[1:])):
            if self.waiting.containsKey((span,)):
                own = _unpacked(self.waiting.getValue((span,))[0])
                x, y = _least(np.concatenate([own[0], x]), np.concatenate([own[1], y]))
            self.waiting.updateValue((span,), (np.concatenate([x, y]).tobytes(),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settled(key, timerValues)

    def _settled(self, key, timer) -> Iterator[pd.DataFrame]:
        passed = timer.getCurrentWatermarkInMs()
        last = self.last.get()[0] if self.last.exists() else None
        fired = []
        for span in sorted(k[0] for k in self.waiting.keys()):
            us, ids = _unpacked(self.waiting.getValue((span,))[0])
            done = int(np.searchsorted(us, passed * 1000))
            at = 0 if last is None else int(np.searchsorted(us, last + self.pause))
            while at < done:
                last = int(us[at])
                fired.append((last, int(ids[at])))
                at = max(at + 1, int(np.searchsorted(us, last + self.pause)))
            if done < len(us):
                if done:
                    self.waiting.updateValue((span,), (np.concatenate([us[done:], ids[done:]]).tobytes(),))
                # the earliest one that waits wakes the key up again
                for other in list(self.handle.listTimers()):
                    self.handle.deleteTimer(other)
                self.handle.registerTimer(int(us[done]) // 1000 + 1)
                break
            self.waiting.removeKey((span,))
        if fired:
            self.last.update((last,))
            yield pd.DataFrame({"key": [key[0]] * len(fired), "us": [f[0] for f in fired], "id": [f[1] for f in fired]})

    def close(self) -> None:
        pass


def cooled_down_stream(matches: DataFrame, seconds: int, key: str = "rule", late: str = "10 minutes") -> DataFrame:
    """(key, ts, id): of a stream of matches (key, ts, id) those that fire, each at least ``seconds`` after the one of its key that fired before it.

    A match comes out when the watermark (``late`` behind the newest time) has passed it; later ones than that are dropped. The session needs the state store ``PROVIDER``.
    """
    own = matches.select(F.col(key).cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("id").cast("long")).withWatermark("ts", late)
    own = own.withColumn("us", F.unix_micros("ts"))
    fired = own.groupBy("key").transformWithStateInPandas(Cooldown(seconds), "key string, us long, id long", "Append", "EventTime")
    return fired.select(F.col("key").alias(key), F.timestamp_micros("us").alias("ts"), "id")
