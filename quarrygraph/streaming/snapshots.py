"""Documents' versions in a stream: the newest snapshot of each is keyed state, its differences come out."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cdc

#: Parts of a document's state; an entity's name tells which.
BLOCKS = 256
CHANGES = "doc_id string, version long, label string, id string, change string"


def stream_changes(versions: DataFrame) -> DataFrame:
    """``doc_id, version, label, id, change`` (added, modified, deleted) of a stream of whole versions.

    ``versions``: ``doc_id, version, entities array<struct<label, id, props, nums>>``, a row per version; an empty
    (or null) array is a document that holds nothing any more.  Versions of a document take effect in their
    order within a micro-batch; one that is not newer than the newest seen is left out, so that a source which
    delivers twice changes nothing.  Equality is that of ``cdc.diff``: properties by name, a null one is no missing one.
    Of an entity that a version lists twice the last one counts.  Null documents and versions are left out.

    State per document is a map from entity to a digest of its properties, which a document's size bounds,
    not the number of versions.  It lies in at most ``BLOCKS`` packed parts, each read once and written at most once in a
    micro-batch, since a call to the state store costs far more than an entity.  Needs the RocksDB state store; state survives a restart from the checkpoint.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Snapshots(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.version = handle.getValueState("version", "version long")
            self.blocks = handle.getMapState("blocks", "block int", "entities string")

        def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
            frame = pd.concat(list(rows)).sort_values(["version", "position"], kind="stable")
            first = last = int(self.version.get()[0]) if self.version.exists() else None
            held: dict[int, dict[tuple[str, str], str]] = {}
            if last is not None and self.blocks.exists():
                held = {k[0]: {(a, b): d for a, b, d in json.loads(v[0])} for k, v in self.blocks.iterator()}
            stored, dirty = set(held), set()
            old = {entity: digest for block in held.values() for entity, digest in block.items()}
            out = []

            def block_of(entity):
                n = zlib.crc32("\0".join(entity).encode()) % BLOCKS
                dirty.add(n)
                return held.setdefault(n, {})

            for version, part in frame.groupby("version", sort=True):
                if last is not None and version <= last:
                    continue
                last = int(version)
                # a row without a position tells of a version without entities
                new = {(a, b): d for a, b, d, at in zip(part["label"], part["id"], part["digest"], part["position"]) if at >= 0}
                for entity, digest in new.items():
                    if old.get(entity) != digest:
                        out.append((last, *entity, "modified" if entity in old else "added"))
                        block_of(entity)[entity] = digest
                for entity in old.keys() - new.keys():
                    out.append((last, *entity, "deleted"))
                    del block_of(entity)[entity]
                old = new
            if last != first:
                self.version.update((last,))
            for n in dirty:
                if held[n]:
                    self.blocks.updateValue((n,), (json.dumps([(*e, d) for e, d in held[n].items()]),))
                elif n in stored:
                    self.blocks.removeKey((n,))
            yield pd.DataFrame({"doc_id": [str(key[0])] * len(out), "version": [r[0] for r in out], "label": [r[1] for r in out], "id": [r[2] for r in out], "change": [r[3] for r in out]})

        def close(self) -> None:
            pass

    rows = versions.filter("doc_id is not null and version is not null")
    each = rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("version").cast("long").alias("version"), F.posexplode_outer("entities").alias("position", "e"))
    same = F.sha2(F.to_json(F.struct(cdc.canonical(F.col("e.props")).alias("p"), cdc.canonical(F.col("e.nums")).alias("n")), {"ignoreNullFields": "false"}), 256)
    each = each.select("doc_id", "version", F.coalesce("position", F.lit(-1)).alias("position"), F.coalesce("e.label", F.lit("")).alias("label"), F.coalesce("e.id", F.lit("")).alias("id"), F.coalesce(same, F.lit("")).alias("digest"))
    return each.groupBy("doc_id").transformWithStateInPandas(Snapshots(), CHANGES, "Append", "none")


def changes_between(versions: DataFrame) -> DataFrame:
    """The same of a table of all versions, each against the one before it: ``cdc.diff`` in batch."""
    from pyspark.sql import Window

    of_doc = Window.partitionBy("doc_id").orderBy("version")
    numbered = versions.filter("doc_id is not null and version is not null").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("version").cast("long").alias("version"), "entities", F.row_number().over(of_doc).alias("step"))
    each = numbered.select("doc_id", "version", "step", F.inline("entities"))
    key = ["doc_id", "step", "label", "id"]
    before = each.select("doc_id", (F.col("step") + 1).alias("step"), "label", "id", "props", "nums")
    changes = cdc.diff(before, each.select(*key, "props", "nums"), tuple(key))
    # the step after a document's last version is none
    return changes.join(numbered.select("doc_id", "step", "version"), ["doc_id", "step"]).select("doc_id", "version", "label", "id", "change")
