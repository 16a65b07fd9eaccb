"""Helpers that several training-data operators share.

Two ideas recur.

*Blocks and buckets.*  Documents are dealt into ``blocks`` by a hash of the row.  A block boils its
documents down to distinct 64-bit keys and sends each *bucket* (keys dealt by a second, independent
hash) one packed row.  A bucket answers one packed row per block.  A key that occurs in a third of
all documents therefore costs one entry per block, never one per occurrence, and both counts grow
with the input, so neither a block nor a bucket outgrows a task.

*Shared folder.*  Intermediate tables go to ``spark.checkpoint.dir``, which every executor sees, so
that a lost executor never takes the only copy along.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_BYTES = 8 << 20
LEAST_BLOCKS = 96
#: What a memo may hold, in bytes as ``Memo`` counts them.
MEMO = 48 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; set only where the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove a table that ``materialise`` wrote and nothing will read again."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def block_count(df: DataFrame, text: str = "text") -> int:
    """Blocks for a table: its text in pieces of about ``BLOCK_BYTES``, ``LEAST_BLOCKS`` at least."""
    total = df.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    return max(LEAST_BLOCKS, -(-total // BLOCK_BYTES))


def block_of(n: int, *cols: str) -> Column:
    """Block of a row: from all of ``cols``, so that rows without an id still spread."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def share(of: Column, part: float) -> Column:
    """A condition that about ``part`` of all values of ``of`` meet, by hash: the same ones every time."""
    return F.lit(True) if part >= 1 else F.xxhash64(of) < int(-(2**63) + part * 2**64)


def spare(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class Memo(dict):
    """``of(key)`` remembered until about ``MEMO`` bytes are held, then begun anew.

    It lives as long as the task or block that made it, so a reused worker carries nothing on.
    """

    def __init__(self, of: Callable, most: int = MEMO):
        super().__init__()
        self.of, self.most, self.held = of, most, 0

    def __missing__(self, key):
        v = self.of(key)
        self.held += 200 + len(key) + (len(v) if hasattr(v, "__len__") else 32)
        if self.held > self.most:
            self.clear()
            self.held = 0
        self[key] = v
        return v


class WordHash:
    """XXH3-64 of words (bytes)."""

    def __init__(self):
        self.memo = Memo(xxhash.xxh3_64_intdigest)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))


def column_bytes(col: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    return col.cast(pa.binary()).to_pylist()


def mix64(x: np.ndarray, salt: int) -> np.ndarray:
    """A finaliser over 64-bit words; another salt gives an independent order."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64(salt)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


PACKED = "bucket int, block int, keys binary, vals binary, n long"
ANSWER = "block int, keys binary, vals binary"


def pack_by_bucket(block: int, bucket: np.ndarray, keys: np.ndarray, vals: np.ndarray) -> pa.Table:
    """One row per bucket with the block's keys for it and a value of fixed width for each."""
    order = np.argsort(bucket, kind="stable")
    bucket, keys, vals = bucket[order], keys[order], vals[order]
    names, start = np.unique(bucket, return_index=True)
    ends = np.append(start[1:], len(bucket))
    return pa.table({
        "bucket": pa.array(names.astype(np.int32)),
        "block": pa.array(np.full(len(names), block, np.int32)),
        "keys": pa.array([keys[a:b].tobytes() for a, b in zip(start, ends)], pa.binary()),
        "vals": pa.array([vals[a:b].tobytes() for a, b in zip(start, ends)], pa.binary()),
        "n": pa.array(ends - start, pa.int64()),
    })


def unpack_bucket(table: pa.Table, dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, values and the row (block's position in ``table``) of each entry."""
    blobs, vals = table["keys"].to_pylist(), table["vals"].to_pylist()
    keys = np.frombuffer(b"".join(blobs), np.uint64)
    row = np.repeat(np.arange(len(blobs)), [len(b) // 8 for b in blobs])
    return keys, np.frombuffer(b"".join(vals), dtype), row


def answer_blocks(table: pa.Table, row: np.ndarray, keys: np.ndarray, vals: np.ndarray) -> pa.Table:
    """One row per asking block; ``row`` must be ascending."""
    blocks = table["block"].to_numpy()
    cut = np.searchsorted(row, np.arange(len(blocks) + 1))
    use = [i for i in range(len(blocks)) if cut[i + 1] > cut[i]]
    return pa.table({
        "block": pa.array(blocks[use], pa.int32()),
        "keys": pa.array([keys[cut[i] : cut[i + 1]].tobytes() for i in use], pa.binary()),
        "vals": pa.array([vals[cut[i] : cut[i + 1]].tobytes() for i in use], pa.binary()),
    })


def joined_answers(table: pa.Table, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All answers to a block, sorted by key."""
    keys = np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint64)
    vals = np.frombuffer(b"".join(table["vals"].to_pylist()), dtype)
    order = np.argsort(keys, kind="stable")
    return keys[order], vals[order]


def look_up(sorted_keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Position of each wanted key in ``sorted_keys``, -1 if absent."""
    if not len(sorted_keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == wanted, at, -1)
