"""Sliding-log rate limits and change streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def admit(events: DataFrame, key: str, ts: str, tie: str, limit: int, window_s: int) -> DataFrame:
    """``events`` with ``accepted``: fewer than ``limit`` accepted ones in the window before.

    The verdict depends on earlier verdicts, so it is a fold over a key's events in order.  Memory
    per key is ``limit`` times; events come sorted from the shuffle, batch by batch.
    """
    import pyarrow as pa

    cols = events.columns
    ordered = events.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))).repartition(key).sortWithinPartitions(key, "_us", tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import deque

        now, log = object(), deque()
        for b in batches:
            out = []
            for k, t in zip(b.column(key).to_pylist(), b.column("_us").to_pylist()):
                if k != now:
                    now, log = k, deque()
                while log and log[0] < t - window_s * 1_000_000:
                    log.popleft()
                out.append(len(log) < limit)
                if out[-1]:
                    log.append(t)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in cols] + [pa.array(out, pa.bool_())], names=[*cols, "accepted"])

    return ordered.mapInArrow(run, events.schema.add("accepted", "boolean"))


def admit_stream(events: DataFrame, key: str, ts: str, limit: int, window_s: int) -> DataFrame:
    """The same on a stream: ``key, ts, accepted`` with the accepted times as keyed state.

    Needs the RocksDB state store.  State lasts for the window only.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Limiter(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.log = handle.getValueState("log", "times array<long>")

        def handleInputRows(self, key_, rows, timer_values) -> Iterator[pd.DataFrame]:
            times = list(self.log.get()[0]) if self.log.exists() else []
            frame = pd.concat(list(rows)).sort_values("us", kind="stable")
            out = []
            for t in frame["us"]:
                times = [x for x in times if x >= t - window_s * 1_000_000]
                out.append(len(times) < limit)
                if out[-1]:
                    times.append(int(t))
            self.log.update((times,))
            yield pd.DataFrame({"key": [str(key_[0])] * len(frame), "us": frame["us"].to_list(), "accepted": out})

        def close(self) -> None:
            pass

    rows = events.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    return rows.groupBy("key").transformWithStateInPandas(Limiter(), "key string, us long, accepted boolean", "Append", "none")


def apply_changes(stream: DataFrame, store: Callable[[], tuple[DataFrame, DataFrame, DataFrame]], save: Callable[..., None], checkpoint: str):
    """Each micro-batch's new document versions are applied to the stored graph in one plan.

    ``store`` reads nodes, edges and snapshots; ``save`` writes the next version of all three and then
    swaps the pointer, so that a batch repeated after a failure starts from the version before it.
    """
    from ..operators import cdc

    def batch(df: DataFrame, number: int) -> None:
        nodes, edges, snapshots, _ = cdc.apply_batch(*store(), df)
        save(nodes, edges, snapshots, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_metrics(events: DataFrame, ts: str, kind: str, value: str, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and means per window and kind, batch or stream; late events are awaited for ``late``."""
    return events.withColumn("t", F.col(ts).cast("timestamp")).withWatermark("t", late).groupBy(F.window("t", size).alias("w"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean_value")).select(F.col("w.start").alias("start"), "kind", "n", "mean_value")
