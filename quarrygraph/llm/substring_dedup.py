"""Removal of passages that occur more than once, by difference-cover anchors.

A window is ``window`` consecutive words.  Words are hashed once; the hash of ``window - period + 1``
words is kept only where the position modulo ``period`` lies in a difference cover.  Any two equal
windows then share an aligned anchor: whatever the two starts are, some shift below ``period`` puts
both on cover positions.  So only windows around an anchor that occurs twice can repeat; these are
extended to their whole length, and it is the whole windows' hashes that decide.

Hashes travel as packed rows (see ``shared``): a block sends each distinct hash once, so a passage
that all documents share costs an entry per block.  Whole windows are compared by 64 bits inside one
of the buckets that a second polynomial chooses.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

WINDOW = 35
PERIOD = 21
#: A perfect difference set modulo 21.
COVER = (0, 1, 4, 14, 16)

_STEP = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _powers(n: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and those of its inverse."""
    both = []
    for base in (step, pow(step, -1, 1 << 64)):
        out = np.full(n, base, np.uint64)
        out[:1] = 1
        both.append(np.multiply.accumulate(out) if n else out)
    return both[0], both[1]


class Block:
    """The words of a block's documents, end to end."""

    def __init__(self, texts: list[bytes | None]):
        self.texts = texts
        hashes, counts, memo = [], [], shared.WordHash()
        for t in texts:
            h = memo.of((t or b"").split())
            hashes.append(h)
            counts.append(len(h))
        self.count = np.array(counts, np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.count)))
        n = int(self.start[-1])
        x = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.of_doc = np.repeat(np.arange(len(texts)), self.count)
        self.at = np.arange(n) - self.start[self.of_doc]
        self.left = self.start[self.of_doc + 1] - np.arange(n) if n else np.zeros(0, np.int64)
        self.sums = []
        for step in _STEP:
            up, down = _powers(n, step)
            self.sums.append((np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * up, dtype=np.uint64))), down))

    def hashes(self, where: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of the ``width`` words from each position."""
        out = []
        for (total, down), salt in zip(self.sums, (1, 2)):
            out.append(shared.mix64((total[where + width] - total[where]) * down[where], salt))
        return out[0], out[1]

    def anchors(self, period: int, cover: tuple[int, ...], width: int) -> np.ndarray:
        member = np.zeros(period, bool)
        member[list(cover)] = True
        return np.flatnonzero(member[self.at % period] & (self.left >= width))

    def around(self, anchors: np.ndarray, window: int, period: int) -> np.ndarray:
        """Starts of the windows that hold one of ``anchors`` within their first ``period`` words."""
        if not len(anchors):
            return anchors
        edge = np.zeros(int(self.start[-1]) + 1, np.int32)
        np.add.at(edge, np.maximum(anchors - period + 1, self.start[self.of_doc[anchors]]), 1)
        np.add.at(edge, anchors + 1, -1)
        return np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (self.left >= window))

    def covered(self, starts: np.ndarray, window: int) -> np.ndarray:
        edge = np.zeros(int(self.start[-1]) + 1, np.int32)
        edge[starts] += 1
        np.add.at(edge, starts + window, -1)
        return np.cumsum(edge[:-1]) > 0


def _distinct(block: int, h: np.ndarray, second: np.ndarray, buckets: int) -> pa.Table:
    """Each distinct hash of a block once; the value is 2 where it occurs twice or more there."""
    order = np.argsort(h)
    h, second = h[order], second[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, int)
    often = np.diff(np.append(first, len(h))) > 1
    bucket = (second[first] % np.uint64(buckets)).astype(np.int64)
    return shared.pack_by_bucket(block, bucket, h[first], (often + 1).astype(np.uint8))


def _repeated(table: pa.Table) -> pa.Table:
    """For each block, the hashes that occur elsewhere too, or twice in the block itself."""
    keys, often, row = shared.unpack_bucket(table, np.uint8)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.append(False, k[1:] == k[:-1])
    twice = np.empty(len(k), bool)
    twice[order] = same | np.append(same[1:], False)
    keep = np.flatnonzero(twice | (often > 1))
    return shared.answer_blocks(table, row[keep], keys[keep], often[keep])


def remove_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER, names: tuple[str, str, str] = ("n_words", "n_removed", "kept_text")) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` (long) and ``kept_text`` (words joined by one space).

    A word goes if a window over it starts anywhere else too, in the same document or another one;
    all windows are judged on the input.  Every copy goes, the first one as well.  A null or blank
    text has no words: 0, 0 and the empty string.  Texts of fewer than ``window`` words stay whole,
    though rejoined by single spaces.  Repeated rows are copies of one another.  ``names`` are those of
    the three new columns; columns of the input that are named so are replaced, others pass through.
    An empty table gives an empty one.
    """
    if len({(a - b) % period for a in cover for b in cover}) != period:
        raise ValueError("cover must hold a pair for each difference modulo period")
    width = window - period + 1
    if width < 1:
        raise ValueError("window must not be shorter than period")
    docs = docs.drop(*names)
    n = shared.block_count(docs, text)
    keys = [c for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))]
    block = shared.spare(docs, "block_")
    # all three hops start from this one table, so that its texts are shuffled once
    blocks = docs.withColumn(block, shared.block_of(n, *keys))

    def first_hop(t: pa.Table) -> pa.Table:
        b = Block(shared.column_bytes(t[text]))
        where = b.anchors(period, cover, width)
        return _distinct(t[block][0].as_py(), *b.hashes(where, width), n)

    def second_hop(t: pa.Table, hits: pa.Table) -> pa.Table:
        if not t.num_rows or not hits.num_rows:
            return pa.Table.from_batches([], pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("vals", pa.binary()), ("n", pa.int64())]))
        b = Block(shared.column_bytes(t[text]))
        where = b.anchors(period, cover, width)
        known, _ = shared.joined_answers(hits, np.uint8)
        where = where[shared.look_up(known, b.hashes(where, width)[0]) >= 0]
        starts = b.around(where, window, period)
        return _distinct(t[block][0].as_py(), *b.hashes(starts, window), n)

    fields = [f for f in blocks.schema.fields]
    out_schema = "struct<" + ",".join([f"`{f.name}`:{f.dataType.simpleString()}" for f in fields if f.name != block] + [f"`{n}`:{kind}" for n, kind in zip(names, ("bigint", "bigint", "string"))]) + ">"

    def third_hop(t: pa.Table, hits: pa.Table) -> pa.Table:
        b = Block(shared.column_bytes(t[text]))
        known, _ = shared.joined_answers(hits, np.uint8)
        every = np.flatnonzero(b.left >= window)
        starts = every[shared.look_up(known, b.hashes(every, window)[0]) >= 0] if len(known) else every[:0]
        gone = b.covered(starts, window)
        removed = np.add.reduceat(np.append(gone, False).astype(np.int64), b.start[:-1]) * (b.count > 0) if len(b.count) else b.count
        kept = []
        for i, raw in enumerate(b.texts):
            words = (raw or b"").split()
            if removed[i]:
                off = gone[b.start[i] : b.start[i + 1]].tolist()
                words = [w for w, x in zip(words, off) if not x]
            kept.append(b" ".join(words))
        out = t.drop_columns([block])
        out = out.append_column(names[0], pa.array(b.count, pa.int64())).append_column(names[1], pa.array(removed, pa.int64()))
        return out.append_column(names[2], pa.array(kept, pa.binary()).cast(pa.string()))

    anchors = blocks.groupBy(block).applyInArrow(first_hop, shared.PACKED)
    hits = anchors.groupBy("bucket").applyInArrow(_repeated, shared.ANSWER)
    windows = blocks.groupBy(block).cogroup(hits.groupBy("block")).applyInArrow(second_hop, shared.PACKED)
    again = windows.groupBy("bucket").applyInArrow(_repeated, shared.ANSWER)
    return blocks.groupBy(block).cogroup(again.groupBy("block")).applyInArrow(third_hop, out_schema)
