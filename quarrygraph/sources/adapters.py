"""Record tables to graph rows, declared as layouts.

A layout says for each label which id its rows have, which columns become text (``t``) or number
(``n``) properties, and which edges a row makes.  Rows come with ``row`` (from 1) as ``csv_rows``
reads them.  Fixed values: the columns of the published data sets and the ids' prefixes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph


@dataclass
class Entity:
    label: str
    id: str
    text: dict[str, str] = field(default_factory=dict)
    numbers: dict[str, str] = field(default_factory=dict)
    when: str = "true"
    keep: str = "all"  # or first, last: of rows with equal ids


@dataclass
class Layout:
    ids: dict[str, Column]
    entities: list[Entity]
    edges: list[tuple[str, str, str, str]]  # source id, type, target id, condition


def _row_id(prefix: str) -> Column:
    return F.concat(F.lit(prefix), T.padded(F.col("row"), 5))


def _after(prefix: str, id_: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(id_, 5, 1 << 20))


def layouts() -> dict[str, Layout]:
    oracle_policy = T.policy_id(F.col("PolicyNumber"), F.col("row"))
    claims_policy = T.policy_id(F.col("policy_number"), F.col("row"))
    customer = T.policy_id(F.col("`Customer ID`"), F.col("row"), 5)
    claim, flag = _row_id("CLM-"), _row_id("FRD-")
    has = lambda e: [("holder", "HAS_POLICY", "policy", "true"), *e]
    return {
        "fraud_oracle": Layout(
            {"policy": oracle_policy, "holder": _after("PH-", oracle_policy), "claim": claim, "flag": flag},
            [
                Entity("Policyholder", "holder", {"name": "concat(coalesce(Sex, ''), ' driver')", "marital_status": "MaritalStatus"}, {"age": "Age", "risk_score": "DriverRating"}, keep="first"),
                Entity("Policy", "policy", {"policy_number": "policy", "type": "PolicyType", "status": "BasePolicy"}, {"deductible": "Deductible"}, keep="first"),
                Entity("Claim", "claim", {"claim_number": "claim", "policy_id": "policy", "cause": "Fault", "status": "AccidentArea", "date": "concat(MonthClaimed, ' ', DayOfWeekClaimed)", "make": "Make", "vehicle_category": "VehicleCategory", "police_report": "PoliceReportFiled"}, {"amount": "VehiclePrice"}),
                Entity("FraudFlag", "flag", {"claim_id": "claim", "reason": "concat(coalesce(Fault, ''), ' / ', coalesce(AccidentArea, ''))", "severity": "'CONFIRMED'"}, {"confidence": "'1.0'"}, when="trim(FraudFound_P) = '1'"),
            ],
            has([("policy", "HAS_CLAIM", "claim", "true"), ("claim", "FRAUD_DETECTED", "flag", "trim(FraudFound_P) = '1'")]),
        ),
        "insurance_claims": Layout(
            {"policy": claims_policy, "holder": _after("PH-", claims_policy), "claim": claim, "flag": flag},
            [
                Entity("Policyholder", "holder", {"name": "concat(coalesce(insured_sex, ''), ' customer')", "occupation": "insured_occupation", "education_level": "insured_education_level"}, {"age": "age", "months_as_customer": "months_as_customer"}, keep="first"),
                Entity("Policy", "policy", {"policy_number": "policy", "policyholder_id": "holder", "type": "policy_csl", "status": "policy_state", "start_date": "policy_bind_date"}, {"premium": "policy_annual_premium", "deductible": "policy_deductable"}, keep="first"),
                Entity("Claim", "claim", {"claim_number": "claim", "policy_id": "policy", "status": "incident_severity", "cause": "incident_type", "date": "incident_date", "collision_type": "collision_type", "auto_make": "auto_make", "city": "incident_city"}, {"amount": "total_claim_amount"}),
                Entity("FraudFlag", "flag", {"claim_id": "claim", "reason": "incident_type", "severity": "incident_severity"}, {"confidence": "'1.0'"}, when="upper(trim(fraud_reported)) = 'Y'"),
            ],
            has([("policy", "HAS_CLAIM", "claim", "true"), ("claim", "FRAUD_DETECTED", "flag", "upper(trim(fraud_reported)) = 'Y'")]),
        ),
        "insurance_dataset": Layout(
            {"policy": _row_id("POL-"), "holder": _row_id("PH-"), "claim": claim},
            [
                Entity("Policyholder", "holder", {"name": "concat(coalesce(Gender, ''), ' customer')", "occupation": "Occupation", "education_level": "Education", "marital_status": "Marital_Status"}, {"age": "Age", "income": "Income"}),
                Entity("Policy", "policy", {"policy_number": "policy", "policyholder_id": "holder", "status": "'ACTIVE'"}, {"premium": "Income"}),
                Entity("Claim", "claim", {"claim_number": "claim", "policy_id": "policy"}, {"amount": "Claim_Amount"}),
            ],
            has([("policy", "HAS_CLAIM", "claim", "true")]),
        ),
        "data_synthetic": Layout(
            {"policy": customer, "holder": _after("PH-", customer), "coverage": _after("COV-", customer)},
            [
                Entity("Policyholder", "holder", {"name": "concat('Customer ', `Customer ID`)", "occupation": "Occupation", "driving_record": "`Driving Record`"}, {"age": "Age", "risk_score": "`Risk Profile`", "credit_score": "`Credit Score`"}, keep="last"),
                Entity("Policy", "policy", {"policy_number": "policy", "policyholder_id": "holder", "type": "`Policy Type`", "status": "`Segmentation Group`"}, {"premium": "`Premium Amount`", "deductible": "Deductible"}, keep="last"),
                Entity("Coverage", "coverage", {"code": "coverage", "policy_id": "policy", "category": "`Policy Type`"}, {"limit": "`Coverage Amount`", "deductible": "Deductible"}, keep="last"),
            ],
            has([("policy", "COVERS", "coverage", "true")]),
        ),
    }


def _maps(text: dict[str, Column], numbers: dict[str, Column]) -> list[Column]:
    def as_map(d: dict[str, Column], kind: str) -> Column:
        if not d:
            return F.create_map().cast(f"map<string,{kind}>")
        pairs = [x for k, v in d.items() for x in (F.lit(k), v)]
        return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())

    return [as_map(text, "string").alias("props"), as_map(numbers, "double").alias("nums")]


def adapt(rows: DataFrame, layout: Layout, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of ``rows``."""
    if limit:
        rows = rows.filter(F.col("row") <= limit)
    rows = rows.withColumns(layout.ids)
    nodes = None
    for e in layout.entities:
        maps = _maps({k: F.expr(c).cast("string") for k, c in e.text.items()}, {k: T.number(F.expr(c).cast("string")) for k, c in e.numbers.items()})
        one = rows.filter(F.coalesce(F.expr(e.when), F.lit(False))).select(F.lit(e.label).alias("label"), F.col(e.id).alias("id"), *maps, "row")
        if e.keep != "all":
            one = (graph.first_wins if e.keep == "first" else graph.last_wins)(one, ["label", "id"], "row").select("label", "id", "props", "nums", "row")
        nodes = one if nodes is None else nodes.unionByName(one)
    edges = None
    for src, kind, dst, when in layout.edges:
        one = rows.filter(F.coalesce(F.expr(when), F.lit(False))).select(F.col(src).alias("src"), F.lit(kind).alias("type"), F.col(dst).alias("dst"))
        edges = one if edges is None else edges.union(one)
    return nodes.drop("row"), edges.dropDuplicates(graph.EDGE)


# What tells claim-like, fraud and id columns, and a flag that is set.
CLAIM_LIKE = re.compile(r"claim|fraud|amount|loss|incident|coverage")
FRAUD_LIKE = re.compile(r"fraud")
ID_LIKE = re.compile(r"(^|_)(id|number|no)$|_id$|^id$")
TRUE_VALUES = ["1", "y", "yes", "true", "fraud", "fraudulent", "flagged"]


def adapt_any(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a table with any header, by what its columns are called."""
    headers = [c for c in rows.columns if c != "row"]
    q = lambda c: F.col(f"`{c}`")
    id_col = next((h for h in headers if ID_LIKE.search(h.lower())), None)
    fraud = next((h for h in headers if FRAUD_LIKE.search(h.lower())), None)
    claims = any(CLAIM_LIKE.search(h.lower()) for h in headers)
    own = _row_id("CLM-" if claims else "REC-")
    id_ = F.coalesce(F.nullif(F.trim(q(id_col)), F.lit("")), own) if id_col else own
    numbers = {h: T.native_number(q(h)) for h in headers if h != id_col}
    text = {h: F.when(numbers[h].isNull(), F.nullif(F.trim(q(h)), F.lit(""))) for h in numbers}
    nodes = rows.select(F.lit("Claim" if claims else "Record").alias("label"), id_.alias("id"), *_maps(text, numbers))
    edges = rows.select(id_.alias("src"), F.lit("FRAUD_DETECTED").alias("type"), _row_id("FRD-").alias("dst"))
    if not (claims and fraud):
        return nodes, edges.limit(0)
    flagged = F.lower(F.trim(F.coalesce(q(fraud), F.lit("")))).isin(TRUE_VALUES)
    flags = rows.filter(flagged).select(F.lit("FraudFlag").alias("label"), _row_id("FRD-").alias("id"), *_maps({"claim_id": id_, "reason": F.lit("flagged in source CSV")}, {}))
    return nodes.union(flags), rows.filter(flagged).select(id_.alias("src"), F.lit("FRAUD_DETECTED").alias("type"), _row_id("FRD-").alias("dst"))
