"""Compression of vectors to product codes, in DataFrame operations around one vectorised step.

Vectors become integers and are cut into parts.  Lloyd's rounds see each distinct part once, with the
number of vectors that hold it as its weight: assignments depend on a part's value alone, and a mean over
distinct values with weights is the mean over all of them.  A round sends the codebooks (a bounded table)
to the tasks, which return one row of sums per entry used; nothing is shuffled but these sums.

Codes travel back to the vectors in two hops.  Rows are dealt into *groups*; a group's distinct parts meet
the table of codes, then the group's vectors.  A part that a third of all vectors share is thus one row per
group in the first hop and a group's share in the second, however common it is.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
GROUP = 1 << 13
LEAST_GROUPS = 64
#: Products of components up to here are exact in double precision.
_EXACT = 1 << 20


def whole(vectors: DataFrame, id_col: str, col: str, extra: list[str], scale: int = SCALE) -> DataFrame:
    """``row``, id, ``extra``, ``v``: usable vectors as integers floor(scale * x), of any numeric type.

    Rows whose vector is null, empty or holds a null or non-finite component are left out.
    """
    x = F.transform(F.col(col), lambda c: c.cast("double"))
    sound = F.forall(F.col("x"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), *extra, x.alias("x")).filter(F.col("x").isNotNull() & (F.size("x") > 0)).filter(F.coalesce(sound, F.lit(False)))
    v = F.transform("x", lambda c: F.floor(c * scale).cast("long"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", *extra, v.alias("v"))


def first_entries(rows: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    """Each position's start codebook: the parts of the first ``entries`` vectors by id, null ids last, then by vector."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    size = len(first[0].v) // parts
    if any(len(r.v) != size * parts for r in first):
        raise ValueError(f"vectors must share one dimension, a multiple of {parts}")
    return [np.array([r.v[p * size : (p + 1) * size] for r in first], object) for p in range(parts)]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties: the lower one) and squared distance, exactly, for rows of integers."""
    exact = max((int(abs(a).max()) for a in (x, book) if a.size), default=0) <= _EXACT and x.shape[1] <= 1 << 10
    kind = np.float64 if exact else object
    a, b = x.astype(kind), book.astype(kind)
    # whole numbers below 2^53 in double precision; Python's own integers beyond
    d = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None]
    at = np.argmin(d, axis=1)
    return at, d[np.arange(len(d)), at]


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 1)


def lloyd(distinct: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round over ``pos, part, n``: floor of the weighted mean; unused entries stay."""
    size = books[0].shape[1]
    sent = distinct.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        now, total = sent.value, {}
        for b in batches:
            pos, n, x = b.column("pos").to_numpy(), b.column("n").to_numpy(), _matrix(b.column("part"))
            for p in np.unique(pos):
                mine = pos == p
                at, _ = nearest(x[mine], now[p])
                weight = n[mine].astype(object)[:, None]
                rows = np.hstack((weight, x[mine].astype(object) * weight))
                for e in np.unique(at):
                    got = rows[at == e].sum(axis=0)
                    total[p, e] = got + total[p, e] if (p, e) in total else got
        if total:
            keys = list(total)
            sums = [[str(c) for c in total[k]] for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array([int(p) for p, _ in keys], pa.int32()), pa.array([int(e) for _, e in keys], pa.int32()), *(pa.array([s[i] for s in sums]) for i in range(size + 1))], names=["pos", "entry", *(f"s{i}" for i in range(size + 1))])

    # sums travel as decimals, which no number of vectors overflows
    sums = distinct.mapInArrow(run, "pos int, entry int, " + ", ".join(f"s{i} string" for i in range(size + 1)))
    sums = sums.groupBy("pos", "entry").agg(*[F.sum(F.col(f"s{i}").cast("decimal(38,0)")).alias(f"s{i}") for i in range(size + 1)])
    out = [b.copy() for b in books]
    for r in sums.collect():  # at most a row per entry
        count, *rest = (int(v) for v in r[2:])
        out[r.pos][r.entry] = [v // count for v in rest]
    sent.unpersist()
    return out


def assign(distinct: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``pos, part, code, err``: each distinct part's entry and squared distance."""
    sent = distinct.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for b in batches:
            pos, x = b.column("pos").to_numpy(), _matrix(b.column("part"))
            code, err = np.zeros(len(pos), np.int32), np.zeros(len(pos), object)
            for p in np.unique(pos):
                mine = pos == p
                code[mine], err[mine] = nearest(x[mine], sent.value[p])
            yield pa.RecordBatch.from_arrays([b.column("pos"), b.column("part"), pa.array(code), pa.array([int(e) for e in err], pa.int64())], names=["pos", "part", "code", "err"])

    return distinct.select("pos", "part").mapInArrow(run, f"pos int, part {dict(distinct.dtypes)['part']}, code int, err long")


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and position, as decimals joined by commas."""
    return hashlib.sha256(",".join(str(c) for b in books for entry in b for c in entry).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding", label: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, group: int = GROUP) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes and codebooks: a row per usable vector with id, label, ``code``, ``error``, ``label_error``.

    ``code`` holds each part's entry in two hex digits (as many as ``entries`` needs), ``error`` the squared
    distances summed over the parts, ``label_error`` the errors summed over rows of the same label, nulls
    together.  Rows whose vector is null, empty or holds null or non-finite components are left out.  Repeated
    rows count as often as they occur; null ids come last where the first vectors start the codebooks, and ties
    are settled by the vectors.  With fewer than ``entries`` vectors the codebooks are as short.  Vectors of another
    dimension than the first one's raise an error when they are met, as does a dimension that ``parts`` does not
    divide; distances that a long does not hold do too.  Other columns are not read.  Without usable vectors the
    result is empty and so are the codebooks.
    """
    spark = vectors.sparkSession
    rows = shared.materialise(whole(vectors, id_col, col, [F.col(label).alias("label")], scale), "whole")
    n, least, most = rows.agg(F.count(F.lit(1)), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    if not n:
        kinds = vectors.schema
        return spark.createDataFrame([], f"{id_col} {kinds[id_col].dataType.simpleString()}, {label} {kinds[label].dataType.simpleString()}, code string, error long, label_error long"), []
    # the narrowest type that holds every component: parts are what is shuffled
    kind = next(k for k, bits in (("smallint", 15), ("int", 31), ("bigint", 63)) if -(1 << bits) <= least and most < 1 << bits)
    rows = rows.withColumn("v", F.col("v").cast(f"array<{kind}>"))
    books = first_entries(rows, parts, entries)
    size, groups = books[0].shape[1], max(LEAST_GROUPS, -(-n // group))
    sound = F.when(F.size("v") == size * parts, F.col("v")).otherwise(F.raise_error(F.lit("vectors differ in dimension")))
    pieces = F.array(*[F.struct(F.lit(p).alias("pos"), F.slice(sound, p * size + 1, size).alias("part")) for p in range(parts)])
    of_group = F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")
    cut = rows.select("row", of_group.alias("g"), F.explode(pieces).alias("piece")).select("row", "g", "piece.pos", "piece.part")
    held = shared.materialise(cut.groupBy("g", "pos", "part").agg(F.count(F.lit(1)).alias("n")), "held")
    distinct = shared.materialise(held.groupBy("pos", "part").agg(F.sum("n").alias("n")), "parts")
    for _ in range(rounds):
        books = lloyd(distinct, books)
    known = shared.materialise(assign(distinct, books), "codes")
    answers = held.select("g", "pos", "part").join(known, ["pos", "part"])
    digits = max(2, len(f"{entries - 1:x}"))
    code = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda s: F.lower(F.lpad(F.hex(s["code"].cast("long")), digits, "0"))), "")
    coded = cut.join(answers, ["g", "pos", "part"]).groupBy("row", "g").agg(code.alias("code"), F.sum("err").alias("error"))
    labelled = shared.materialise(rows.select("row", "id", "label").join(coded, "row"), "coded")
    # a label's sum: from groups to all, and back over groups to rows
    of_label = shared.materialise(labelled.groupBy("g", "label").agg(F.sum("error").alias("e")), "labels")
    total = of_label.groupBy("label").agg(F.sum("e").alias("label_error"))
    mine = of_label.alias("l").join(total.alias("t"), F.col("l.label").eqNullSafe(F.col("t.label"))).select("l.g", "l.label", "label_error")
    out = labelled.alias("r").join(mine.alias("m"), (F.col("r.g") == F.col("m.g")) & F.col("r.label").eqNullSafe(F.col("m.label")))
    return out.select(F.col("r.id").alias(id_col), F.col("r.label").alias(label), "code", "error", "label_error"), books


def decode(codes: DataFrame, books: list[np.ndarray], col: str = "code") -> DataFrame:
    """``codes`` with ``vector``: the integers that each code stands for; a null code gives null."""
    digits = max(2, len(f"{len(books[0]) - 1:x}")) if books else 2

    def run(batches):
        for b in batches:
            at = [None if c is None else [int(c[i : i + digits], 16) for i in range(0, len(c), digits)] for c in b.column(col).to_pylist()]
            vector = [None if a is None else [int(x) for book, e in zip(books, a) for x in book[e]] for a in at]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vector, pa.list_(pa.int64()))], names=[*b.schema.names, "vector"])

    return codes.mapInArrow(run, T.StructType([*codes.schema, T.StructField("vector", T.ArrayType(T.LongType()))]))
