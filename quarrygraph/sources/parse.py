"""Key-value lines of printed records to entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Keys of printed records, the titles that tell their types, row patterns.
KEYS = [
    "Policy ID", "Policy Number", "Type", "Term", "Status", "Annual Premium", "Deductible", "Policyholder ID", "Name", "Date of Birth", "Address", "Phone", "Email", "Risk Score",
    "Claim ID", "Claim Number", "Policy", "Date of Loss", "Amount", "Cause",
    "Flag ID", "Reason", "Confidence", "Severity", "Created By", "Investigator ID", "Role",
    "Endorsement ID", "Endorsement Number", "Effective Date", "Premium Adjustment",
]
COVERAGE_ROW = r"^(COV-\d+)\s*([A-Z]+-[A-Z])\s*(LIABILITY|PROPERTY|AUTO|EMPLOYEE_INJURY|ERRORS_OMISSIONS)\s*(\$[\d,]+)\s*(\$[\d,]+)\s*(.*)$"
ENDORSEMENT_ROW = r"^(END-\d+)\s*(\S+)\s*([A-Z_]+)\s*(\d{4}-\d{2}-\d{2})\s*(-?\$?-?\d[\d,]*)$"
TERM = r"^(\d{4}-\d{2}-\d{2})\s+to\s+(\d{4}-\d{2}-\d{2})$"


def lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, pos, line``: trimmed lines that hold something."""
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("pos", "line"))
    return rows.withColumn("line", F.trim("line")).filter("line <> ''")


def key_pattern(keys: list[str] = KEYS) -> str:
    """Group 1 is the longest key that begins a line, group 2 what follows it."""
    ordered = "|".join(sorted((k.replace(" ", "\\ ") for k in keys), key=len, reverse=True))
    return rf"^({ordered})(?: (.*))?$"


def key_values(rows: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """``id, key, value``: the longest key that begins a line; later lines win."""
    pattern = key_pattern(keys)
    hit = rows.filter(F.col("line").rlike(pattern) & ~F.col("line").rlike(COVERAGE_ROW) & ~F.col("line").rlike(ENDORSEMENT_ROW))
    kv = hit.select("id", "pos", F.regexp_extract("line", pattern, 1).alias("key"), F.trim(F.regexp_extract("line", pattern, 2)).alias("value"))
    return kv.groupBy("id", "key").agg(F.max_by("value", "pos").alias("value"))


def coverages(rows: DataFrame) -> DataFrame:
    g = lambda i: F.regexp_extract("line", COVERAGE_ROW, i)
    money = lambda i: F.regexp_replace(g(i), "[$,]", "").try_cast("double")
    parts = F.filter(F.transform(F.split(g(6), ";"), lambda s: F.trim(s)), lambda s: s != "")
    return rows.filter(F.col("line").rlike(COVERAGE_ROW)).select("id", g(1).alias("coverage_id"), g(2).alias("code"), g(3).alias("category"), money(4).alias("limit"), money(5).alias("deductible"), parts.alias("exclusions"))


def endorsements(rows: DataFrame) -> DataFrame:
    g = lambda i: F.regexp_extract("line", ENDORSEMENT_ROW, i)
    return rows.filter(F.col("line").rlike(ENDORSEMENT_ROW)).select("id", g(1).alias("endorsement_id"), g(2).alias("number"), g(3).alias("type"), g(4).alias("effective_date"), F.regexp_replace(g(5), "[$,]", "").try_cast("double").alias("premium_adjustment"))


def term(value: F.Column) -> F.Column:
    return F.struct(F.nullif(F.regexp_extract(value, TERM, 1), F.lit("")).alias("start_date"), F.nullif(F.regexp_extract(value, TERM, 2), F.lit("")).alias("end_date"))
