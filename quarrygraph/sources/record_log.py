"""Logs of records, a line each, as a data source: whole lines in parallel, by offsets in a stream.

``spark.dataSource.register(RecordLog)`` makes ``spark.read.format("record_log")`` and ``spark.readStream`` know it.
Files are read in pieces of bytes.  A line belongs to the piece in which it begins, so that every line is read
once, whatever its length.  A last line without its line break is still being written: it is left for the next read.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

PIECE = 32 << 20
LINES = 4096
SCHEMA = "path string, offset long, line string"
_TAIL = 1 << 16


def _system(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def _files(path: str) -> dict[str, int]:
    """Sizes of the log's files by path; names that begin with _ or . are not its own."""
    from pyarrow import fs

    system, at = _system(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        return {}
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(at, recursive=True))
    own = lambda p: not any(x[:1] in ("_", ".") for x in p[len(at) :].split("/"))
    return {f.path: f.size for f in found if f.is_file and own(f.path)}


def _whole(system, path: str, size: int) -> int:
    """Where the last whole line ends."""
    with system.open_input_file(path) as f:
        end = size
        while end > 0:
            start = max(0, end - _TAIL)
            at = f.read_at(end - start, start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return 0


class Piece(InputPartition):
    """Bytes of a file: lines that begin from ``start`` on and before ``end``."""

    def __init__(self, log: str, path: str, start: int, end: int):
        self.log, self.path, self.start, self.end = log, path, start, end


def _pieces(log: str, spans: dict[str, tuple[int, int]], size: int) -> list[Piece]:
    return [Piece(log, p, a, min(a + size, end)) for p, (start, end) in sorted(spans.items()) for a in range(start, end, size)]


def _lines(piece: Piece | None) -> Iterator[pa.RecordBatch]:
    if piece is None:  # a read of no pieces is one task without any
        return
    system, _ = _system(piece.log)
    with system.open_input_file(piece.path) as raw:
        raw.seek(max(0, piece.start - 1))
        f = io.BufferedReader(raw, 1 << 20)
        # the line that holds the byte before is another piece's
        at = piece.start - 1 + len(f.readline()) if piece.start else 0
        offsets, lines = [], []
        while at < piece.end:
            line = f.readline()
            if not line.endswith(b"\n"):
                break
            offsets.append(at)
            lines.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
            at += len(line)
            if len(lines) == LINES:
                yield _batch(piece.path, offsets, lines)
                offsets, lines = [], []
        if lines:
            yield _batch(piece.path, offsets, lines)


def _batch(path: str, offsets: list[int], lines: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(lines)), pa.array(offsets, pa.int64()), pa.array(lines)], names=["path", "offset", "line"])


class LogReader(DataSourceReader):
    def __init__(self, log: str, piece: int):
        self.log, self.piece = log, piece

    def partitions(self) -> list[Piece]:
        return _pieces(self.log, {p: (0, n) for p, n in _files(self.log).items() if n}, self.piece)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        yield from _lines(partition)


class LogStream(DataSourceStreamReader):
    """Offsets are the bytes of whole lines read so far, by file.

    Files only grow.  One that has become shorter was written anew: the stream fails rather than lose or repeat lines.
    """

    def __init__(self, log: str, piece: int):
        self.log, self.piece = log, piece

    def initialOffset(self) -> dict:
        return {"read": "{}"}

    def latestOffset(self) -> dict:
        system, _ = _system(self.log)
        return {"read": json.dumps({p: _whole(system, p, n) for p, n in _files(self.log).items()}, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        old, new = json.loads(start["read"]), json.loads(end["read"])
        shorter = sorted(p for p in new if new[p] < old.get(p, 0))
        if shorter:
            raise ValueError(f"rewritten while it was followed: {', '.join(shorter)}")
        return _pieces(self.log, {p: (old.get(p, 0), n) for p, n in new.items() if n > old.get(p, 0)}, self.piece)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        yield from _lines(partition)

    def commit(self, end: dict) -> None:
        pass


class RecordLog(DataSource):
    """Options: ``path`` (a file or folder, also of another file system by its URI), ``piece`` (bytes to a task)."""

    @classmethod
    def name(cls) -> str:
        return "record_log"

    def schema(self) -> str:
        return SCHEMA

    def _how(self) -> tuple[str, int]:
        if not self.options.get("path"):
            raise ValueError("a record log needs a path")
        return self.options["path"], max(1, int(self.options.get("piece", PIECE)))

    def reader(self, schema) -> LogReader:
        return LogReader(*self._how())

    def streamReader(self, schema) -> LogStream:
        return LogStream(*self._how())


def parsed(lines: DataFrame, schema: str) -> DataFrame:
    """Lines as records of ``schema``; what is no JSON object is left out."""
    record = F.from_json("line", schema, {"mode": "PERMISSIVE"})
    is_object = F.try_parse_json("line").isNotNull() & F.startswith(F.ltrim("line"), F.lit("{"))
    return lines.filter(is_object).select(record.alias("r")).select("r.*")


def read_log(spark: SparkSession, path: str, schema: str, piece: int = PIECE) -> DataFrame:
    spark.dataSource.register(RecordLog)
    return parsed(spark.read.format("record_log").option("piece", piece).load(path), schema)


def follow_log(spark: SparkSession, path: str, schema: str, piece: int = PIECE) -> DataFrame:
    """The log as a stream of records: each line once, also after a restart from a checkpoint."""
    spark.dataSource.register(RecordLog)
    return parsed(spark.readStream.format("record_log").option("piece", piece).load(path), schema)
