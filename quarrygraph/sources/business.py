"""The business tables at hand as a property graph.

customer - Policyholder, orders - Policy, lineitem - Claim, supplier - Investigator, part - Coverage;
flags follow the fraud rules.  Line items are not unique by order and line, so a claim's number
holds a rank among equal ones too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evaluate

PREMIUM_TIMES = 0.9
#: what nodes, edges and flags read of claims
CLAIM = ["claim_id", "policy_id", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, c) -> F.Column:
    s = F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    return F.concat(F.lit(prefix), F.lpad(s, F.greatest(F.length(s), F.lit(5)), F.lit("0")))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with ``claim_id``; windows run within one order and line."""
    line = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    number = F.col("l_orderkey") * 10000 + F.col("l_linenumber") * 100 + F.row_number().over(order)
    return line.withColumn("claim_id", _id("CLM-", number)).withColumn("policy_id", _id("POL-", "l_orderkey"))


def flags(spark: SparkSession, sf_dir: str, cl: DataFrame | None = None) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    joined = (claims(spark, sf_dir) if cl is None else cl).join(o, F.col("l_orderkey") == o.o_orderkey)
    rows = joined.select("claim_id", F.col("o_orderdate").alias("start"), F.col("l_shipdate").alias("date"), F.col("l_extendedprice").alias("amount"), F.col("o_totalprice").alias("premium"))
    return evaluate.fraud_rules(rows, times=PREMIUM_TIMES)


def _node(df: DataFrame, label: str, id_, props: dict, nums: dict) -> DataFrame:
    p = F.create_map(*[x for k, v in props.items() for x in (F.lit(k), v)]) if props else F.create_map().cast("map<string,string>")
    n = F.create_map(*[x for k, v in nums.items() for x in (F.lit(k), v)]) if nums else F.create_map().cast("map<string,double>")
    return df.select(F.lit(label).alias("label"), id_.alias("id"), p.alias("props"), n.alias("nums"))


def nodes(spark: SparkSession, sf_dir: str, cl: DataFrame | None = None, fl: DataFrame | None = None) -> DataFrame:
    """All nodes; ``cl`` are the ``claims`` and ``fl`` the ``flags`` if they are stored already."""
    cl = claims(spark, sf_dir) if cl is None else cl
    fl = flags(spark, sf_dir, cl) if fl is None else fl
    t = lambda n: table(spark, sf_dir, n)
    c = F.col
    parts = [
        _node(t("customer"), "Policyholder", _id("PH-", "c_custkey"), {"name": c("c_name"), "segment": c("c_mktsegment")}, {"risk_score": c("c_acctbal")}),
        _node(t("orders"), "Policy", _id("POL-", "o_orderkey"), {"policy_number": _id("POL-", "o_orderkey"), "status": c("o_orderstatus"), "type": c("o_orderpriority"), "start_date": F.date_format("o_orderdate", "yyyy-MM-dd")}, {"premium": c("o_totalprice")}),
        _node(cl, "Claim", c("claim_id"), {"claim_number": c("claim_id"), "status": c("l_linestatus"), "cause": c("l_returnflag"), "date": F.date_format("l_shipdate", "yyyy-MM-dd")}, {"amount": c("l_extendedprice")}),
        _node(t("supplier"), "Investigator", _id("INV-", "s_suppkey"), {"name": c("s_name"), "role": F.lit("INVESTIGATOR")}, {}),
        _node(t("part"), "Coverage", _id("COV-", "p_partkey"), {"code": c("p_brand"), "category": c("p_type")}, {"limit": c("p_retailprice")}),
        _node(fl, "FraudFlag", F.concat(F.lit("FRD-"), F.substring("claim_id", 5, 40)), {"severity": c("severity")}, {"confidence": c("confidence")}),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def edges(spark: SparkSession, sf_dir: str, cl: DataFrame | None = None, fl: DataFrame | None = None, repeated: bool = False) -> DataFrame:
    """All edges; ``cl`` are the ``claims`` and ``fl`` the ``flags`` if they are stored already.

    ``repeated`` leaves in the coverages that several claims of a policy name, for readers that count equal edges once.
    """
    cl = claims(spark, sf_dir) if cl is None else cl
    fl = flags(spark, sf_dir, cl) if fl is None else fl
    covers = cl.select("policy_id", "l_partkey")
    covers = covers if repeated else covers.distinct()
    o = table(spark, sf_dir, "orders")
    e = lambda df, a, t, b: df.select(a.alias("src"), F.lit(t).alias("type"), b.alias("dst"))
    parts = [
        e(o, _id("PH-", "o_custkey"), "HAS_POLICY", _id("POL-", "o_orderkey")),
        e(cl, F.col("policy_id"), "HAS_CLAIM", F.col("claim_id")),
        e(cl, _id("INV-", "l_suppkey"), "INVESTIGATES_CLAIM", F.col("claim_id")),
        e(covers, F.col("policy_id"), "COVERS", _id("COV-", "l_partkey")),
        e(fl, F.col("claim_id"), "FRAUD_DETECTED", F.concat(F.lit("FRD-"), F.substring("claim_id", 5, 40))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
