"""Mixing sources to target weights by entropy balancing, in DataFrame operations alone.

A document of size z (in means of its source) is taken at a rate r between 0 and ``cap``.  Among all
rates that meet the source's token target, those of largest (bounded) entropy are tilted
exponentially: r / (cap - r) = base * exp(lambda * z), with the odds of rate 1 as base.  Lambda
maximises a concave dual; Newton steps find it from three sums over the source.  Since r depends on
source and size only, every sum runs over the table of (source, size) with its counts, which is
aggregated once.  Newton starts on the target's side that makes it monotone for cap 2.

Rates become whole copies by systematic rounding along each source's sizes: neighbours in that order
are alike in size, so the rounding's error in tokens stays about one document's size per source, and
a few single copies then settle it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
NEWTON_ROUNDS = 24
STEPS_PER_ROUND = 2
TOLERANCE = 1e-10
SETTLE = 3
_UNIT = 1_000_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(shared.WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``source``, ``source_size`` -> plus ``target``.

    Weights repeat along the sources by code point, null last.  The shares of ``share`` times all
    tokens stop at ``cap`` times a source; what is above is shared anew by weight.  That is a level
    theta with target = min(cap * size, theta * weight), found by running sums over the sources in
    the order in which they fill up.  A row per source passes one task here, nothing else.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (nth + 1).cast("int"))
    s = sources.withColumn("w", w).withColumn("most", cap * F.col("source_size")).withColumn("fills", F.col("most") / F.col("w"))
    order = Window.orderBy("fills", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    s = s.withColumn("all", share * F.sum("source_size").over(everything))
    s = s.withColumn("full", F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("open", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.col("all") - F.col("full")) / F.col("open"))
    theta = F.min(F.when(F.col("level") <= F.col("fills"), F.col("level"))).over(everything)
    # among levels that don't fill their own source, the first in order is the largest remaining
    first = F.min(F.when(F.col("level") <= F.col("fills"), F.struct("fills", F.col("source").isNull().alias("last"), F.col("source"), "level"))).over(everything)
    s = s.withColumn("theta", F.coalesce(first["level"], theta))
    t = F.when(F.col("theta").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("theta") * F.col("w")))
    return s.select("source", "source_size", t.cast("double").alias("target"))


def _rate(lam: Column, z: Column, cap: float) -> Column:
    return F.lit(cap) / (1 + (cap - 1) * F.exp(-lam * z))


def tilts(cells: DataFrame, goal: DataFrame, cap: float = CAP) -> DataFrame:
    """``goal`` with ``mean`` and ``lam`` per source.

    ``lam`` is null where every rate is the cap, or 0 for want of words; a source without any word has no ``mean``.
    """
    mean = cells.groupBy("source").agg(F.nullif(F.sum(F.col("n") * F.col("size")) / F.sum("n"), F.lit(0.0)).alias("mean"))
    free = (F.col("target") > 0) & (F.col("target") < cap * F.col("source_size") * (1 - 1e-12))
    now = goal.join(mean, goal.source.eqNullSafe(mean.source)).select(goal.source, "source_size", "target", "mean", F.when(free, 0.0).alias("lam"))
    now = shared.materialise(now.withColumn("off", F.lit(1.0)), "tilts")
    cells = cells.filter("size > 0").select(F.col("source").alias("of"), "size", "n")
    for _ in range(NEWTON_ROUNDS):
        following = now.drop("off")
        for _ in range(STEPS_PER_ROUND):
            z = F.col("size") / F.col("mean")
            r = _rate(F.col("lam"), z, cap)
            joined = cells.join(following.filter("lam is not null"), F.col("of").eqNullSafe(F.col("source")))
            sums = joined.groupBy("of").agg(F.sum(F.col("n") * z * r).alias("got"), F.sum(F.col("n") * z * z * r * (cap - r) / cap).alias("slope"))
            want = F.col("target") / F.col("mean")
            step = F.when(F.col("slope") > 0, (want - F.col("got")) / F.col("slope")).otherwise(0.0)
            following = following.join(sums, F.col("source").eqNullSafe(F.col("of")), "left").select("source", "source_size", "target", "mean", (F.col("lam") + F.coalesce(step, F.lit(0.0))).alias("lam"), F.coalesce(F.abs(F.col("got") - want) / want, F.lit(0.0)).alias("off"))
        before, now = now, shared.materialise(following, "tilts")
        shared.drop_table(before)
        off = now.agg(F.max("off")).first()[0] or 0.0
        if off < TOLERANCE:
            break
    else:
        if off > 1e-6:
            raise RuntimeError(f"a source's tilt is still {off:.1e} off its target")
    return now.drop("off")


def copies(sized: DataFrame, id_col: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Rows with ``source``, ``size`` -> plus ``source_size``, ``target``, ``copies`` (long)."""
    cells = shared.materialise(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "cells")
    goal = targets(cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, share, cap)
    tilt = tilts(cells, goal, cap)
    c = cells.alias("c").join(tilt.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select("c.source", "size", "n", "source_size", "target", "mean", "lam")
    full = F.when(F.col("target") > 0, F.lit(cap)).otherwise(0.0)
    c = c.withColumn("rate", F.when(F.col("lam").isNull(), full).otherwise(_rate(F.col("lam"), F.col("size") / F.col("mean"), cap)))
    # whole units, so that neither the order of additions nor the last bit of lambda matters
    c = c.withColumn("units", F.least(F.round(F.col("rate") * _UNIT), F.lit(cap * _UNIT)).cast("long"))
    c = c.withColumn("part", F.col("units") % _UNIT)
    along = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("upto", F.sum(F.col("part") * F.col("n")).over(along))
    half = _UNIT // 2
    more = F.floor((F.col("upto") + half) / _UNIT) - F.floor((F.col("upto") - F.col("part") * F.col("n") + half) / _UNIT)
    c = c.withColumn("total", (F.floor(F.col("units") / _UNIT) * F.col("n") + more).cast("long"))
    # what rounding left over: a copy more or less of the size that comes nearest to it, a few times
    whole_source = Window.partitionBy("source")
    for _ in range(SETTLE):
        over = F.sum(F.col("total") * F.col("size")).over(whole_source) - F.col("target")
        step = -F.signum(over)
        able = (F.col("total") + step >= 0) & (F.col("total") + step <= cap * F.col("n"))
        gain = F.abs(over) - F.abs(over + step * F.col("size"))
        best = F.max(F.when(able & (gain > 0), F.struct(gain.alias("gain"), F.col("size")))).over(whole_source)
        c = c.withColumn("total", F.col("total") + F.when(best["size"] == F.col("size"), step).otherwise(0).cast("long"))
    whole = F.floor(F.col("total") / F.col("n"))
    c = c.select(F.col("source").alias("of"), F.col("size").alias("of_size"), "n", "source_size", "target", whole.alias("whole"), (F.col("total") - whole * F.col("n")).alias("more"))
    c = shared.materialise(c, "rates")
    rows = sized.join(c, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("of_size"))).drop("of", "of_size")
    # which of a cell's n documents get the copy more: the first by hash; a large cell is cut into
    # about sqrt(n) ranges, each numbered by itself
    rows = rows.withColumn("range", F.pmod(F.xxhash64(id_col, F.lit(1)), F.ceil(F.sqrt("n"))).cast("int"))
    some = (F.col("more") > 0) & (F.col("more") < F.col("n"))
    counts = rows.filter(some).groupBy("source", "size", "range").agg(F.count(F.lit(1)).alias("here"))
    earlier = Window.partitionBy("source", "size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("source").alias("of"), F.col("size").alias("of_size"), F.col("range").alias("of_range"), F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("first"))
    inside = Window.partitionBy("source", "size", "range").orderBy(F.xxhash64(id_col, F.lit(2)), id_col)
    rows = rows.withColumn("nth", F.row_number().over(inside))
    rows = rows.join(counts, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("of_size")) & (F.col("range") == F.col("of_range")), "left")
    extra = F.when(F.col("more") >= F.col("n"), 1).when(F.col("more") <= 0, 0).otherwise((F.col("first") + F.col("nth") <= F.col("more")).cast("int"))
    return rows.withColumn("copies", (F.col("whole") + extra).cast("long")).drop("n", "whole", "more", "range", "nth", "of", "of_size", "of_range", "first")


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """A row per document: id, source, size, source_size, target, copies, taken (copies x size).

    A null text has size 0; a null source is a source of its own, last in order.  Documents of size
    0 are taken at whatever rate the tilt gives size 0 and add no words; a source without words has
    the target 0 and no copies.  Ties in size are broken by
    a hash of the id, then the id; repeated rows are documents of their own and interchangeable.
    Copies are whole, so a source's taken words miss its target by less than its largest document.
    Other columns are not read.  An empty table gives an empty one.
    """
    sized = docs.select(F.col(id_col), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    rows = copies(shared.materialise(sized, "sized"), id_col, weights, share, cap)
    return rows.withColumn("taken", F.col("copies") * F.col("size")).select(id_col, F.col("source").alias(source), "size", "source_size", "target", "copies", "taken")


def take(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix itself: ``docs`` with each row as often as it is taken, columns unchanged.

    Rows equal in id, source and text share their copies as evenly as whole numbers allow; which of
    them get one more is decided by a hash of the whole row, so that reruns agree.
    """
    to_id, to_source, to_hash, all_copies, all_rows, my_hash, nth = (shared.spare(docs, f"mix_{x}_") for x in ("id", "source", "hash", "copies", "rows", "my_hash", "nth"))
    sized = docs.select(F.col(id_col).alias(to_id), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(text).alias(to_hash))
    rows = copies(shared.materialise(sized, "sized"), to_id, **how).withColumnRenamed("source", to_source)
    per_row = rows.groupBy(to_id, to_source, to_hash).agg(F.sum("copies").alias(all_copies), F.count(F.lit(1)).alias(all_rows))
    keyed = docs.withColumn(my_hash, F.xxhash64(text))
    joined = keyed.join(per_row, F.col(id_col).eqNullSafe(F.col(to_id)) & F.col(source).eqNullSafe(F.col(to_source)) & (F.col(my_hash) == F.col(to_hash)))
    # only rows that repeat need numbers; the rest pass without another shuffle of their texts
    every = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    number = F.row_number().over(Window.partitionBy(id_col, source, my_hash).orderBy(F.xxhash64(*every)))
    single = joined.filter(F.col(all_rows) == 1).withColumn(nth, F.lit(1))
    joined = single.union(joined.filter(F.col(all_rows) > 1).withColumn(nth, number))
    times = (F.floor(F.col(all_copies) / F.col(all_rows)) + (F.col(nth) <= F.col(all_copies) % F.col(all_rows)).cast("int")).cast("int")
    return joined.withColumn(nth, F.explode(F.array_repeat(F.lit(1), times))).select(*docs.columns)
