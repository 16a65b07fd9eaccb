"""Counts that follow changes: references of entities, support of derived edges, and what is summed from them.

A *ledger* is a table of (key, +/- n) in which every batch of changes is a folder of its own.  A key's count is
the sum of its rows, so that a batch costs its own changes plus the rows of the keys that it touches, never a scan of
all snapshots.  Keys are dealt to parts by hash and the files lie by part: a small batch reads the parts of its keys
alone.  Writing a batch again replaces its folder, so that a run that failed half-way can be repeated; folders
are folded into a base now and then (``compact``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cdc, graph

PARTS = 16


@dataclass
class Ledger:
    """Counts by ``keys`` (a schema string) under ``path``."""

    spark: SparkSession
    path: str
    keys: str
    parts: int = PARTS

    @property
    def names(self) -> list[str]:
        return [k.split()[0] for k in self.keys.split(",")]

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.names), F.lit(self.parts)).cast("int").alias("part")

    def _folders(self) -> list[tuple[int, bool]]:
        """Batches on disk by number, and whether each is a base; a folder without its mark was not finished."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(fs_path):
            return []
        found = []
        for s in fs.listStatus(fs_path):
            kind, _, number = s.getPath().getName().partition("=")
            done = fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
            if kind in ("batch", "base") and done:
                found.append((int(number), kind == "base"))
        return sorted(found)

    def _live(self, upto: int | None = None) -> list[str]:
        """Folders that count: the newest base and the batches after it, up to a batch."""
        found = [(n, base) for n, base in self._folders() if upto is None or n <= upto]
        start = max((n for n, base in found if base), default=None)
        return [f"{self.path}/{'base' if base else 'batch'}={n}" for n, base in found if (base and n == start) or (not base and (start is None or n > start))]

    def add(self, delta: DataFrame, batch: int) -> None:
        """Store a batch's rows (keys, ``n``); its number is larger than those before it, or that of a run to repeat."""
        if any(base and n >= batch for n, base in self._folders()):
            raise ValueError(f"batch {batch} has been folded into a base")
        net = delta.groupBy(*self.names).agg(F.sum("n").cast("long").alias("n")).filter("n <> 0")
        net.withColumn("part", self._part()).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/batch={batch}")

    def read(self, only: DataFrame | None = None, upto: int | None = None) -> DataFrame:
        """Keys and ``n`` of all keys with a count other than 0, or of those of ``only`` alone."""
        schema, live = f"{self.keys}, n long, part int", self._live(upto)
        rows = None
        for folder in live:
            one = self.spark.read.schema(schema).parquet(folder)
            rows = one if rows is None else rows.union(one)
        if rows is None:
            return self.spark.createDataFrame([], f"{self.keys}, n long")
        if only is not None:
            only = only.select(*self.names).distinct()
            parts = [r.part for r in only.select(self._part()).distinct().collect()]  # at most ``parts`` numbers
            rows = rows.filter(F.col("part").isin(parts)).join(only, self.names, "left_semi")
        return rows.groupBy(*self.names).agg(F.sum("n").alias("n")).filter("n <> 0")

    def moved(self, delta: DataFrame, before: int | None = None) -> DataFrame:
        """Keys of ``delta`` with their counts ``before`` and ``after`` it; ``before``: the last batch that counts."""
        net = delta.groupBy(*self.names).agg(F.sum("n").cast("long").alias("d")).filter("d <> 0")
        net = graph._cut(net)
        old = self.read(net, before).withColumnRenamed("n", "o")
        was = F.coalesce("o", F.lit(0))
        return net.join(old, self.names, "left").select(*self.names, was.cast("long").alias("before"), (was + F.col("d")).cast("long").alias("after"))

    def compact(self) -> None:
        """Fold all batches into a base; the old folders go once the base is whole."""
        found = self._folders()
        if not found or found[-1][1]:
            return
        last, old = found[-1][0], found
        self.read().withColumn("part", self._part()).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/base={last}")
        for n, base in old:
            graph.remove(self.spark, f"{self.path}/{'base' if base else 'batch'}={n}")


def appeared(moved: DataFrame) -> Column:
    """+1 for a key that came to be, -1 for one that ceased, 0 for others."""
    return (F.col("after") > 0).cast("long") - (F.col("before") > 0).cast("long")


@dataclass
class Counts:
    """The counts of a set of snapshots: ``refs`` by entity, ``ids`` by id, ``support`` by derived edge, ``labels``, ``types`` and ``around``."""

    spark: SparkSession
    path: str
    parts: int = PARTS

    def __post_init__(self):
        made = lambda name, keys, parts=self.parts: Ledger(self.spark, f"{self.path.rstrip('/')}/{name}", keys, parts)
        self.refs = made("refs", "label string, id string")
        self.ids = made("ids", "id string")
        self.support = made("support", "src string, type string, dst string")
        self.labels, self.types = made("labels", "label string", 1), made("types", "type string", 1)
        self.around = made("around", "id string")

    @property
    def ledgers(self) -> list[Ledger]:
        return [self.refs, self.ids, self.support, self.labels, self.types, self.around]

    def compact(self) -> None:
        for ledger in self.ledgers:
            ledger.compact()

    def apply(self, old: DataFrame, new: DataFrame, batch: int) -> DataFrame:
        """Move all counts by a batch of documents; returns ``doc_id, added, modified, deleted, deleted_skipped``.

        ``old`` and ``new`` (``doc_id, label, id, props, nums``) are the versions before and after of the batch's
        documents alone.  An entity that a document drops counts as skipped if its id is still referenced after the
        batch.  The same batch applied again gives the same counts.
        """
        kinds = ["doc_id", "label", "id", "props", "nums"]
        old, new = graph._cut(old.select(*kinds)), graph._cut(new.select(*kinds))
        changes = graph._cut(cdc.diff(old, new, ("doc_id", "label", "id")))
        step = F.when(F.col("change") == "added", 1).when(F.col("change") == "deleted", -1).otherwise(0)
        delta = changes.select("label", "id", step.cast("long").alias("n")).filter("n <> 0")
        refs = graph._cut(self.refs.moved(delta, batch - 1))
        ids = graph._cut(self.ids.moved(delta, batch - 1))
        # derived edges of what changed: those of the old version go, those of the new one come
        changed = lambda rows: rows.join(changes.select("doc_id", "label", "id"), ["doc_id", "label", "id"], "left_semi")
        edges = _derived(changed(new), 1).union(_derived(changed(old), -1))
        support = graph._cut(self.support.moved(edges, batch - 1))
        self.refs.add(delta, batch)
        self.ids.add(delta, batch)
        self.support.add(edges, batch)
        self.labels.add(refs.select("label", appeared(refs).alias("n")), batch)
        self.types.add(support.select("type", appeared(support).alias("n")), batch)
        ends = support.select(F.explode(F.array("src", "dst")).alias("id"), appeared(support).alias("n"))
        self.around.add(ends, batch)
        dropped = changes.filter("change = 'deleted'").select("id").distinct()
        # an id with a net move is in ``ids``; one that another document took over in the same batch has none
        still = dropped.join(ids.filter("after <= 0"), "id", "left_anti").withColumn("skipped", F.lit(True))
        skipped = F.count_if((F.col("change") == "deleted") & F.col("skipped"))
        counts = [F.count_if(F.col("change") == c).alias(c) for c in ("added", "modified", "deleted")]
        return changes.join(still, "id", "left").groupBy("doc_id").agg(*counts, skipped.alias("deleted_skipped"))

    def touching(self, ids: DataFrame) -> DataFrame:
        """Number of derived edges around ``ids``, an edge between two of them twice (``graph.touching`` over counts)."""
        return self.around.read(ids.select("id")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))

    def still_referenced(self, ids: DataFrame) -> DataFrame:
        """Those of ``ids`` that any snapshot holds."""
        return self.ids.read(ids.select("id")).filter("n > 0").select("id")


def _derived(entities: DataFrame, n: int) -> DataFrame:
    """A row per derived edge and document that derives it."""
    parts = None
    for label, rules in cdc.DERIVED.items():
        for key, _, kind in rules:
            fk = F.col("props")[key]
            one = entities.filter((F.col("label") == label) & fk.isNotNull()).select(fk.alias("src"), F.lit(kind).alias("type"), F.col("id").alias("dst"), F.lit(n).cast("long").alias("n"))
            parts = one if parts is None else parts.union(one)
    return parts


def recount(snapshots: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``labels``, ``types`` and ``around`` from all snapshots: what the moved counts must equal."""
    labels = snapshots.select("label", "id").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    edges = _derived(snapshots, 1).select(*graph.EDGE).distinct()
    types = edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    around = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return labels, types, around
