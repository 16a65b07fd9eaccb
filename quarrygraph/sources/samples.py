"""Nested sample records to a property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import cdc, graph

_NUMBERS = (T.NumericType,)


def _node(df: DataFrame, label: str, record: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """A struct column as a node: its strings and numbers become properties, nested fields go."""
    fields = [f for f in df.schema[record].dataType.fields if f.name not in ("id", *drop)]
    def pairs(kinds, cast):
        found = [x for f in fields if isinstance(f.dataType, kinds) for x in (F.lit(f.name), F.col(f"{record}.`{f.name}`").cast(cast))]
        made = F.create_map(*found) if found else F.create_map().cast(f"map<string,{cast}>")
        return F.map_filter(made, lambda k, v: v.isNotNull())
    return df.filter(F.col(f"{record}.id").isNotNull()).select(F.lit(label).alias("label"), F.col(f"{record}.id").alias("id"), pairs((T.StringType, T.BooleanType), "string").alias("props"), pairs(_NUMBERS, "double").alias("nums"))


def _edge(df: DataFrame, src: str, kind: str, dst: str) -> DataFrame:
    return df.select(F.col(src).alias("src"), F.lit(kind).alias("type"), F.col(dst).alias("dst")).filter("src is not null and dst is not null")


def flatten(policies: DataFrame, claims: DataFrame, endorsements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of policies (holder, coverages, endorsements within), claims and endorsements.

    Rows that name the same node merge property by property; endorsements of their own win over those
    within policies, and of other rows that state the same property the one largest as JSON.
    """
    p = policies.select(F.struct("*").alias("p"))
    inner = lambda col: p.select("p", F.explode(f"p.{col}").alias("x"))
    loose = endorsements.select(F.struct("*").alias("x"))
    cov, end = inner("coverages"), inner("endorsements")
    nodes = _node(p.select("p.policyholder"), "Policyholder", "policyholder").union(_node(p, "Policy", "p")).union(_node(cov, "Coverage", "x"))
    nodes = nodes.union(_node(claims, "Claim", "claim", ("policy_id", "doc_id"))).union(_node(claims, "FraudFlag", "fraud_flag")).union(_node(claims, "Investigator", "investigator"))
    by_key = lambda df: cdc.merged_entities(df.withColumn("doc_id", F.to_json(F.struct("props", "nums"))))
    ends = graph.upsert_nodes(by_key(_node(end, "Endorsement", "x", ("policy_id",))), by_key(_node(loose, "Endorsement", "x", ("policy_id",))))
    edges = _edge(p, "p.policyholder.id", "HAS_POLICY", "p.id").union(_edge(cov, "p.id", "COVERS", "x.id")).union(_edge(end, "p.id", "ENDORSED_BY", "x.id")).union(_edge(loose, "x.policy_id", "ENDORSED_BY", "x.id"))
    edges = edges.union(_edge(claims, "claim.policy_id", "HAS_CLAIM", "claim.id")).union(_edge(claims, "claim.id", "FRAUD_DETECTED", "fraud_flag.id")).union(_edge(claims, "investigator.id", "INVESTIGATES_CLAIM", "claim.id"))
    return by_key(nodes).union(ends.select("label", "id", "props", "nums")), edges.distinct()
