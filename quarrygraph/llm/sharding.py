"""Byte-balanced sharding of indivisible groups by Karmarkar-Karp differencing.

Documents with equal texts form a group that stays together.  Groups are hashed into buckets.  Each
bucket boils its groups down to lumps: differencing spreads them over ``width`` lumps, one of these
is spread over ``width`` finer ones, and so on until the last lumps are single groups.  The lumps of
all buckets, coarse and fine, are far fewer sums; while they are too many for one task they are
lumped in turn.  Differencing over the shards places the large ones (and any group that is large by
itself) and the fine ones even out what is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .differencing import spread_numbers

SHARDS = 8
GROUPS_PER_BUCKET = 20_000
#: Lumps that the driver spreads over the shards; where there are more, lumps are lumped again.
MOST_LUMPS = 1 << 17
ROWS_PER_SLOT_RANGE = 20_000


def lumps(sizes: np.ndarray, width: int) -> np.ndarray:
    """Lump of each group: ``width`` - 1 of equal size, then as many of a ``width``-th of it, ..."""
    out = np.zeros(len(sizes), np.int64)
    left, base = np.arange(len(sizes)), 0
    while len(left) > width:
        part, sums = spread_numbers(sizes[left], width)
        counts = np.bincount(part, minlength=width)
        # the finer level needs a lump of many groups
        split = int(np.argmax(counts))
        out[left] = base + part
        base += width
        if counts[split] == len(left):
            break
        left = left[part == split]
    out[left] = base + np.arange(len(left))
    return out


def tagged(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    return docs.select(id_col, (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.unhex(F.sha1(body)).alias("group"))


def lumped(items: DataFrame, per_bucket: int = GROUPS_PER_BUCKET) -> DataFrame:
    """``item``, ``bytes`` -> plus ``lump`` (long)."""
    buckets = max(16, -(-items.count() // per_bucket))
    # well below a bucket's items, so that every lumping leaves fewer
    width = max(4, min(64, 16384 // buckets, per_bucket // 8))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("bytes", "descending"), ("item", "ascending")])
        lump = lumps(t["bytes"].to_numpy(), width) + (t["bucket"][0].as_py() << 32)
        return t.drop_columns(["bucket"]).append_column("lump", pa.array(lump, pa.int64()))

    dealt = items.withColumn("bucket", F.pmod(F.xxhash64("item"), F.lit(buckets)).cast("int"))
    return dealt.groupBy("bucket").applyInArrow(run, f"item {dict(items.dtypes)['item']}, bytes long, lump long")


def groups_to_shards(rows: DataFrame, shards: int = SHARDS, per_bucket: int = GROUPS_PER_BUCKET, most: int = MOST_LUMPS) -> DataFrame:
    """``group``, ``shard`` for rows with ``group`` (binary) and ``size``."""
    items = shared.materialise(rows.groupBy(F.col("group").alias("item")).agg(F.sum("size").alias("bytes")), "groups")
    levels = []
    while True:
        levels.append(shared.materialise(lumped(items, per_bucket), "lumps"))
        shared.drop_table(items)
        items = shared.materialise(levels[-1].groupBy(F.col("lump").alias("item")).agg(F.sum("bytes").alias("bytes")), "sums")
        if items.count() <= most:
            break
    sums = items.orderBy(F.desc("bytes"), "item").collect()  # at most ``most`` rows
    part, _ = spread_numbers(np.array([r.bytes for r in sums], np.int64), shards)
    placed = F.broadcast(rows.sparkSession.createDataFrame([(r["item"], int(s)) for r, s in zip(sums, part)], "lump long, shard int"))
    for level in reversed(levels):
        placed = level.join(placed, "lump").select(F.col("item").alias("lump"), "shard")
    return placed.withColumnRenamed("lump", "group")


def shard(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """A row per document: id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the text's UTF-8 bytes plus 1; null and empty texts are one group of size 1 each.
    Equal texts share a shard, repeated rows too.  Slots run from 0 without gaps in each shard, in
    the order of a hash of the row (rows equal in id and text are interchangeable).  The law is
    ``bytes``, so ``grown_shard`` is null.  Other columns are not read; an empty table gives none.
    """
    rows = shared.materialise(tagged(docs, id_col, text), "tagged")
    placed = rows.join(groups_to_shards(rows, shards), "group")
    ranges = max(96, -(-rows.count() // ROWS_PER_SLOT_RANGE))
    placed = placed.withColumn("range", F.pmod(F.xxhash64(id_col, "group"), F.lit(ranges)).cast("int"))
    placed = shared.materialise(placed, "placed")
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    first = counts.select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "range").orderBy(id_col, "group")
    return (
        placed.withColumn("nth", F.row_number().over(inside))
        .join(first, ["shard", "range"])
        .select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", shards: int = SHARDS) -> None:
    """Write ``docs`` with a folder per shard; a group's rows end up in one of them."""
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    of_group = groups_to_shards(shared.materialise(tagged(docs, id_col, text), "tagged"), shards)
    group = shared.spare(docs, "group_")
    keyed = docs.withColumn(group, F.unhex(F.sha1(body)))
    joined = keyed.join(of_group.withColumnRenamed("group", group), group).drop(group)
    joined.write.partitionBy("shard").parquet(path)
