"""Snapshots of documents' entities: difference, reference counts, surgical apply.

Snapshots: ``doc_id, label, id, props map<string,string>, nums map<string,double>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph

# Edges derived from foreign keys, by the label that carries the key:
# (key, label at the source, type); the carrier is the target.
DERIVED = {
    "Policy": [("policyholder_id", "Policyholder", "HAS_POLICY")],
    "Coverage": [("policy_id", "Policy", "COVERS")],
    "Endorsement": [("policy_id", "Policy", "ENDORSED_BY")],
    "Claim": [("policy_id", "Policy", "HAS_CLAIM"), ("investigator_id", "Investigator", "INVESTIGATES_CLAIM")],
    "FraudFlag": [("claim_id", "Claim", "FRAUD_DETECTED")],
}
JOIN_FIELDS = ["policy_id", "claim_id", "investigator_id", "policyholder_id", "doc_id"]


def canonical(m: Column) -> Column:
    """A map as sorted entries: equal maps have equal forms, and a key without a value is no missing key."""
    return F.array_sort(F.map_entries(m))


def diff(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("label", "id")) -> DataFrame:
    """``keys, change`` (added, modified, deleted) between two snapshots.

    A row with null maps is there all the same.  With ``doc_id`` among the keys the snapshots may be those of many documents.
    """
    here = F.lit(True).alias("_here")
    a, b = old.select("*", here).alias("a"), new.select("*", here).alias("b")
    joined = a.join(b, list(keys), "full_outer")
    same = canonical(F.col("a.props")).eqNullSafe(canonical(F.col("b.props"))) & canonical(F.col("a.nums")).eqNullSafe(canonical(F.col("b.nums")))
    change = F.when(F.col("a._here").isNull(), "added").when(F.col("b._here").isNull(), "deleted").when(~same, "modified")
    return joined.select(*keys, change.alias("change")).filter("change is not null")


def still_referenced(snapshots: DataFrame, doc_id: str | int, ids: DataFrame) -> DataFrame:
    """Those of ``ids`` that another document's snapshot holds too."""
    return ids.join(snapshots.filter(F.col("doc_id") != doc_id).select("id").distinct(), "id", "left_semi")


def derive_edges(entities: DataFrame) -> DataFrame:
    """``src_label, src, type, dst_label, dst`` from the foreign keys among ``props``."""
    parts = []
    for label, rules in DERIVED.items():
        for key, source, kind in rules:
            fk = F.col("props")[key]
            parts.append(entities.filter((F.col("label") == label) & fk.isNotNull()).select(F.lit(source).alias("src_label"), fk.alias("src"), F.lit(kind).alias("type"), F.lit(label).alias("dst_label"), F.col("id").alias("dst")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def strip_join_fields(props: Column) -> Column:
    return F.map_filter(props, lambda k, v: ~k.isin(JOIN_FIELDS))


def apply(nodes: DataFrame, edges: DataFrame, snapshots: DataFrame, doc_id: str | int, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and snapshots after a new version of a document, and its change counts.

    Deletes come first and spare what other documents mention; upserts merge; stale derived edges of
    modified entities go, whether or not their old source still exists; edges are derived again.
    """
    old = snapshots.filter(F.col("doc_id") == doc_id).drop("doc_id")
    changes = diff(old, new)
    deleted = changes.filter("change = 'deleted'").select("id")
    kept = still_referenced(snapshots, doc_id, deleted)
    nodes, edges = graph.detach_delete(nodes, edges, deleted.join(kept, "id", "left_anti"))
    touched = changes.filter("change <> 'deleted'").select("label", "id")
    upserts = new.join(touched, ["label", "id"], "left_semi")
    nodes = graph.upsert_nodes(nodes, upserts.select("label", "id", strip_join_fields(F.col("props")).alias("props"), "nums"))
    modified = changes.filter("change = 'modified'").select("label", "id")
    edges = graph.drop_derived(edges, modified, {lab: [t for _, _, t in rules] for lab, rules in DERIVED.items()})
    nodes, edges = graph.upsert_edges(nodes, edges, derive_edges(upserts), endpoints="create")
    now = snapshots.filter(F.col("doc_id") != doc_id).unionByName(new.withColumn("doc_id", F.lit(doc_id).cast(dict(snapshots.dtypes)["doc_id"])))
    counts = changes.groupBy().agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "modified", "deleted")]).crossJoin(kept.agg(F.count(F.lit(1)).alias("deleted_skipped")))
    return nodes, edges, now, counts


def latest(versions: DataFrame, order: str = "version") -> DataFrame:
    """Each document's rows of its newest version; ``versions`` has ``doc_id`` and ``order`` besides."""
    newest = versions.groupBy("doc_id").agg(F.max(order).alias(order))
    return versions.join(newest, ["doc_id", order], "left_semi")


def baseline(entities: DataFrame) -> DataFrame:
    """First snapshots of documents (``doc_id, label, id, props, nums``): the same upload again changes nothing."""
    of_doc = entities.select("doc_id", "label", "id", "props", "nums")
    return of_doc.groupBy("doc_id", "label", "id").agg(F.max_by(F.struct("props", "nums"), F.to_json(F.struct("props", "nums"))).alias("r")).select("doc_id", "label", "id", "r.props", "r.nums").withColumn("version", F.lit(1).cast("long"))


def merged_entities(rows: DataFrame) -> DataFrame:
    """``label, id, props, nums`` of ``doc_id, label, id, props, nums``, property by property.

    Of documents that state the same property the largest ``doc_id`` wins.  Properties are merged as
    rows, so an entity that very many documents mention is combined before it is shuffled.
    """
    key = ["label", "id"]
    props = rows.select(*key, "doc_id", F.explode_outer("props").alias("k", "s")).withColumn("v", F.lit(None).cast("double"))
    nums = rows.select(*key, "doc_id", F.explode_outer("nums").alias("k", "v")).withColumn("s", F.lit(None).cast("string"))
    flat = props.withColumn("number", F.lit(False)).unionByName(nums.withColumn("number", F.lit(True)))
    won = flat.groupBy(*key, "number", "k").agg(F.max_by(F.struct("s", "v"), "doc_id").alias("w"))
    entry = lambda number, f: F.map_from_entries(F.collect_list(F.when((F.col("number") == number) & F.col("k").isNotNull(), F.struct("k", F.col(f"w.{f}")))))
    return won.groupBy(*key).agg(entry(False, "s").alias("props"), entry(True, "v").alias("nums"))


def apply_batch(nodes: DataFrame, edges: DataFrame, snapshots: DataFrame, new: DataFrame, docs: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``apply`` for new versions of many documents in one plan; counts are per document.

    ``new``: ``doc_id, label, id, props, nums``; ``docs`` (``doc_id``) names the documents too that
    hold nothing any more.  The outcome does not depend on an order of the documents: an entity goes
    if a document drops it and no document's snapshot after the batch holds it.
    """
    docs = (new if docs is None else docs).select("doc_id").distinct()
    kinds = ["doc_id", "label", "id", "props", "nums"]
    changes = diff(snapshots.join(docs, "doc_id", "left_semi").select(*kinds), new.select(*kinds), ("doc_id", "label", "id"))
    now = snapshots.select(*kinds).join(docs, "doc_id", "left_anti").select(*kinds).union(new.select(*kinds))
    deleted = changes.filter("change = 'deleted'")
    kept = deleted.select("id").distinct().join(now.select("id").distinct(), "id", "left_semi")
    nodes, edges = graph.detach_delete(nodes, edges, deleted.select("id").distinct().join(kept, "id", "left_anti"))
    upserts = new.join(changes.filter("change <> 'deleted'").select("doc_id", "label", "id"), ["doc_id", "label", "id"], "left_semi")
    merged = merged_entities(upserts.select("doc_id", "label", "id", strip_join_fields(F.col("props")).alias("props"), "nums"))
    nodes = graph.upsert_nodes(nodes, merged)
    modified = changes.filter("change = 'modified'").select("label", "id").distinct()
    edges = graph.drop_derived(edges, modified, {lab: [t for _, _, t in rules] for lab, rules in DERIVED.items()})
    nodes, edges = graph.upsert_edges(nodes, edges, derive_edges(upserts), endpoints="create")
    skipped = kept.withColumn("skipped", F.lit(True))
    counts = changes.join(skipped, "id", "left").groupBy("doc_id").agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "modified", "deleted")], F.count_if((F.col("change") == "deleted") & F.col("skipped")).alias("deleted_skipped"))
    return nodes, edges, now, counts
