"""The newest n records of each key in a stream, kept as lists in state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RING = "key string, position int, us long, tie string, payload string, size int, evicted long, stamp long"


def ring_stream(records: DataFrame, key: str, ts: str, tie: str, payload: str, n: int, late: str = "1 hour", idle_s: int | None = None) -> DataFrame:
    """Every key's ring after each micro-batch that touches it, newest first (position from 1), in update mode.

    ``key, position, us, tie, payload, size, evicted, stamp``: ``us`` is the record's time in microseconds, ``size`` the
    ring's, ``evicted`` how many records of the key have left it so far, ``stamp`` numbers the key's
    emissions, so that a sink keeps the rows of its largest one (``newest_rings``).  Order is by time, then ``tie``, as in
    ``records.retain``; a record that comes late, but within ``late`` of the newest one, takes its place by its time
    and may be too old to enter a full ring; later ones are dropped by the watermark.  A key without a record for
    ``idle_s`` seconds of event time loses its ring when the watermark passes that point; it is then emitted once with a
    size of 0 (position 0), and begins anew if it returns.  Null keys are a key of their own, named "".
    Records without a time are left out.

    State per key is ``n`` records, whatever the stream's length.  Needs the RocksDB state store.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Ring(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.ring = handle.getListState("ring", "us long, tie string, payload string")
            self.told = handle.getValueState("told", "evicted long, stamp long, timer long")

        def _emit(self, key, rows, evicted, stamp) -> pd.DataFrame:
            shown = [(i, *r) for i, r in enumerate(rows, 1)] or [(0, None, None, None)]
            cols = list(zip(*shown))
            size = len(shown)
            frame = {"key": [str(key[0])] * size, "position": cols[0], "us": pd.array(cols[1], "Int64"), "tie": cols[2], "payload": cols[3], "size": [len(rows)] * size, "evicted": [evicted] * size, "stamp": [stamp] * size}
            return pd.DataFrame(frame)

        def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
            evicted, stamp, timer = self.told.get() if self.told.exists() else (0, 0, -1)
            held = [tuple(r) for r in self.ring.get()] if self.ring.exists() else []
            for frame in rows:
                held += [(int(u), t, p) for u, t, p in zip(frame["us"], frame["tie"], frame["payload"])]
                held.sort(key=lambda r: (r[0], r[1] is not None, r[1] or ""), reverse=True)
                evicted += max(0, len(held) - n)
                held = held[:n]
            self.ring.put(held)
            if idle_s is not None:
                if timer >= 0:
                    self.handle.deleteTimer(timer)
                timer = held[0][0] // 1000 + idle_s * 1000
                self.handle.registerTimer(timer)
            self.told.update((evicted, stamp + 1, timer))
            yield self._emit(key, held, evicted, stamp + 1)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            evicted, stamp, _ = self.told.get()
            evicted += sum(1 for _ in self.ring.get())
            self.ring.clear()
            self.told.update((evicted, stamp + 1, -1))
            yield self._emit(key, [], evicted, stamp + 1)

        def close(self) -> None:
            pass

    at = F.col(ts).cast("timestamp")
    rows = records.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), at.alias("at"), F.unix_micros(at).alias("us"), F.col(tie).cast("string").alias("tie"), F.col(payload).cast("string").alias("payload"))
    rows = rows.filter("at is not null").withWatermark("at", late)
    return rows.groupBy("key").transformWithStateInPandas(Ring(), RING, "Update", "eventTime")


def newest_rings(emitted: DataFrame) -> DataFrame:
    """The rings as they stand, of everything that a sink has collected: ``key, position, us, tie, payload, evicted``."""
    last = emitted.groupBy("key").agg(F.max("stamp").alias("stamp"))
    return emitted.join(last, ["key", "stamp"], "left_semi").filter("position > 0").select("key", "position", "us", "tie", "payload", "evicted")
