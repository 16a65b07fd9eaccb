"""Runs that follow changed files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def follow(spark: SparkSession, folder: str, run: Callable[[DataFrame, int], None], checkpoint: str, pattern: str = "*.csv", once: bool = True):
    """``run(files, batch)`` for new files of ``folder``; ``files``: ``path, modificationTime, length, content``.

    A batch counts as done only after ``run`` returned, so one that fails is run again from the
    checkpoint: state is saved for a whole chain or not at all.  With ``once`` the query ends when
    all present files are done; otherwise it goes on waiting.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).load(folder)
    writer = files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
