"""Printed records to graph entities, a whole table of documents at once.

A document's lines are an array within its row, so that types, keys and descriptions are found
without a shuffle; only the rows of its tables are exploded.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import parse

# Titles that tell a document's type, headings, the key of a document's own id, ids in file names.
TITLES = {"policy": "Commercial Insurance Policy", "claim": "Claim Report", "endorsement": "Policy Endorsement"}
SECTIONS = ["Policyholder", "Coverages", "Endorsements", "Fraud Flag", "Investigator"]
OWN_KEY = {"policy": "Policy ID", "claim": "Claim ID", "endorsement": "Endorsement ID"}
HINT = r"([A-Z]{2,6}-\d{3,})"
HEAD_LINES = 3


@dataclass
class Rule:
    """An entity of a document type; ``key`` holds its id, the document's own id if None."""

    kind: str
    label: str
    key: str | None
    text: dict[str, str] = field(default_factory=dict)
    numbers: dict[str, str] = field(default_factory=dict)
    to_document: str | None = None  # property that refers to the document's own id


# Properties and the keys that they are printed under.
RULES = [
    Rule("policy", "Policyholder", "Policyholder ID", {"name": "Name", "dob": "Date of Birth", "address": "Address", "phone": "Phone", "email": "Email"}, {"risk_score": "Risk Score"}),
    Rule("policy", "Policy", None, {"policy_number": "Policy Number", "type": "Type", "status": "Status", "policyholder_id": "Policyholder ID"}, {"premium": "Annual Premium", "deductible": "Deductible"}),
    Rule("claim", "Claim", None, {"claim_number": "Claim Number", "policy_id": "Policy ID", "date": "Date of Loss", "status": "Status", "cause": "Cause", "investigator_id": "Investigator ID"}, {"amount": "Amount"}),
    Rule("claim", "FraudFlag", "Flag ID", {"reason": "Reason", "severity": "Severity", "created_by": "Created By"}, {"confidence": "Confidence"}, "claim_id"),
    Rule("claim", "Investigator", "Investigator ID", {"name": "Name", "role": "Role", "email": "Email"}),
    Rule("endorsement", "Endorsement", None, {"endorsement_number": "Endorsement Number", "policy_id": "Policy", "type": "Type", "effective_date": "Effective Date"}, {"premium_adjustment": "Premium Adjustment"}),
]


def hint_id(name: Column) -> Column:
    """The first id in a file's name; null without one."""
    return F.nullif(F.regexp_extract(name, HINT, 1), F.lit(""))


def document_type(lines: Column) -> Column:
    """policy, claim or endorsement by the title among the first lines; null for other texts."""
    head = F.array_join(F.slice(lines, 1, HEAD_LINES), " ")
    out = F.when(F.lit(False), F.lit(""))
    for kind, title in TITLES.items():
        out = out.when(F.contains(head, F.lit(title)), kind)
    return out


def _is_row(line: Column) -> Column:
    return line.rlike(parse.COVERAGE_ROW) | line.rlike(parse.ENDORSEMENT_ROW)


def read_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", hint: str | None = None) -> DataFrame:
    """``source, kind, doc_id, lines, pairs, description`` of each document."""
    trimmed = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n|\r|\n"), lambda s: F.trim(s))
    df = docs.select(F.col(id_col).alias("source"), (hint_id(F.col(hint)) if hint else F.lit(None).cast("string")).alias("hinted"), F.filter(trimmed, lambda s: s != "").alias("lines"))
    pattern = parse.key_pattern()
    plain = lambda s: ~s.isin(SECTIONS) & ~_is_row(s)
    df = df.withColumn("kind", document_type(F.col("lines")))
    df = df.withColumn("pairs", F.transform("lines", lambda s: F.struct(F.when(plain(s), F.regexp_extract(s, pattern, 1)).otherwise("").alias("key"), F.trim(F.regexp_extract(s, pattern, 2)).alias("value"))))
    cause = F.array_position(F.transform("pairs", lambda p: p["key"]), "Cause").cast("int")
    after = F.filter(F.slice("lines", cause + 1, F.size("lines")), lambda s: plain(s) & ~s.rlike(pattern))
    df = df.withColumn("description", F.when((F.col("kind") == "claim") & (cause > 0), F.array_join(after, " ")))
    own = F.coalesce(*[F.when(F.col("kind") == k, F.nullif(cell(key), F.lit(""))) for k, key in OWN_KEY.items()], F.col("hinted"))
    return df.withColumn("doc_id", own).select("source", "kind", "doc_id", "lines", "pairs", "description")


def cell(key: str) -> Column:
    """The value printed last under a key; null without one."""
    return F.try_element_at(F.filter("pairs", lambda p: p["key"] == key), F.lit(-1))["value"]


def _props(text: dict[str, Column], numbers: dict[str, Column]) -> list[Column]:
    """Text and number maps; what should be a number but isn't stays as text."""
    words = {**text, **{k: F.when(T.native_number(v).isNull(), v) for k, v in numbers.items()}}
    pairs = [x for k, v in words.items() for x in (F.lit(k), v)]
    counts = [x for k, v in numbers.items() for x in (F.lit(k), T.native_number(v))]
    nums = F.map_filter(F.create_map(*counts), lambda k, v: v.isNotNull()) if counts else F.create_map().cast("map<string,double>")
    return [F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull() & (v != "")).alias("props"), nums.alias("nums")]


def entities(docs: DataFrame, id_col: str = "doc_id", text: str = "text", hint: str | None = None) -> DataFrame:
    """``source, doc_id, label, id, props, nums``: what each document says.

    ``source`` is the row's own id, ``doc_id`` the record's.  Texts of no known type and null texts
    give nothing; an entity without an id is left out, an empty property too.
    """
    read = read_lines(docs, id_col, text, hint).filter("kind is not null")
    made = []
    for r in RULES:
        words = {p: cell(k) for p, k in r.text.items()}
        if r.label == "Policy":
            words |= {p: parse.term(cell("Term"))[p] for p in ("start_date", "end_date")}
        if r.label == "Claim":
            words["description"] = F.col("description")
        if r.to_document:
            words[r.to_document] = F.col("doc_id")
        entity = F.struct(F.lit(r.label).alias("label"), (cell(r.key) if r.key else F.col("doc_id")).alias("id"), *_props(words, {p: cell(k) for p, k in r.numbers.items()}))
        made.append(F.when(F.col("kind") == r.kind, entity))
    # all entities of a document in one pass over it
    out = read.select("source", "doc_id", F.explode(F.array_compact(F.array(*made))).alias("e")).select("source", "doc_id", "e.*")
    rows = read.filter("kind = 'policy'").select(F.struct("source", "doc_id").alias("id"), F.explode(F.filter("lines", _is_row)).alias("line"))
    c, e = parse.coverages(rows), parse.endorsements(rows)
    text_of = lambda *names: {n: F.col(n) for n in names}
    covers = c.select("id.source", "id.doc_id", F.lit("Coverage").alias("label"), F.col("coverage_id").alias("eid"), F.col("id.doc_id").alias("policy_id"), "code", "category", F.array_join("exclusions", "; ").alias("exclusions"), F.col("limit").cast("decimal(20,2)").cast("string").alias("limit"), F.col("deductible").cast("decimal(20,2)").cast("string").alias("deductible"))
    covers = covers.select("source", "doc_id", "label", F.col("eid").alias("id"), *_props(text_of("policy_id", "code", "category", "exclusions"), text_of("limit", "deductible")))
    ends = e.select("id.source", "id.doc_id", F.lit("Endorsement").alias("label"), F.col("endorsement_id").alias("eid"), F.col("id.doc_id").alias("policy_id"), F.col("number").alias("endorsement_number"), "type", "effective_date", F.col("premium_adjustment").cast("decimal(20,2)").cast("string").alias("premium_adjustment"))
    ends = ends.select("source", "doc_id", "label", F.col("eid").alias("id"), *_props(text_of("policy_id", "endorsement_number", "type", "effective_date"), text_of("premium_adjustment")))
    return out.union(covers).union(ends).filter(F.col("id").isNotNull() & (F.col("id") != ""))


def by_model(docs: DataFrame, extractor, id_col: str = "doc_id", text: str = "text", hint: str | None = None, strict: bool = False) -> DataFrame:
    """Like ``entities``, read by a model, with ``mode``: ``model``, or ``heuristic`` where rules had to read.

    ``extractor`` takes a list of texts and returns for each ``{label: {id: {property: value}}}``, or None
    if it failed; it is called once per Arrow batch, an exception counts as failure of the whole batch.
    Rules read what it failed on; ``strict`` ends the job instead.  Numbers go to ``nums``, null and empty values
    are left out, lists and objects become JSON.  A record's id is the hinted one, else the first that names a policy,
    claim or endorsement.  The answers are stored, so that no text is sent twice.  ``id_col`` must be distinct;
    null and empty texts are never sent and give nothing.  An entity with an empty id is left out.
    """
    import json

    import pyarrow as pa

    from ..operators.graph import _cut

    own = re.compile(r"(POL|CLM|END)-\d+", re.ASCII)
    asked = docs.select(F.col(id_col).alias("source"), (hint_id(F.col(hint)) if hint else F.lit(None).cast("string")).alias("hinted"), F.col(text).cast("string").alias("text")).filter("length(text) > 0")
    kind = dict(asked.dtypes)["source"]
    schema = f"source {kind}, doc_id string, label string, id string, props map<string,string>, nums map<string,double>"

    def told(props: dict) -> tuple[list, list]:
        numbers = [(k, float(v)) for k, v in props.items() if isinstance(v, (int, float)) and not isinstance(v, bool)]
        words = [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in props.items() if v not in (None, "") and k not in dict(numbers)]
        return words, numbers

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            try:
                got = list(extractor(texts))
                if len(got) != len(texts):
                    raise ValueError(f"{len(got)} answers to {len(texts)} texts")
            except Exception:
                if strict:
                    raise
                got = [None] * len(texts)
            if strict and None in got:
                raise ValueError("the extractor failed on a text")
            at, rows = [], []
            for i, (hinted, found) in enumerate(zip(b.column("hinted").to_pylist(), got)):
                if found is None:
                    at.append(i)
                    rows.append((None, None, None, [], []))
                    continue
                listed = [(label, str(e), props or {}) for label, es in found.items() for e, props in es.items() if e]
                record = hinted or next((e for _, e, _ in listed if own.fullmatch(e)), None)
                at += [i] * len(listed)
                rows += [(record, label, e, *told(props)) for label, e, props in listed]
            cols = list(zip(*rows)) or [()] * 5
            pairs = [pa.map_(pa.string(), pa.string()), pa.map_(pa.string(), pa.float64())]
            arrays = [pa.array(c, t) for c, t in zip(cols, [pa.string()] * 3 + pairs)]
            yield pa.RecordBatch.from_arrays([b.column("source").take(pa.array(at, pa.int64())), *arrays], names=["source", "doc_id", "label", "id", "props", "nums"])

    said = _cut(asked.mapInArrow(run, schema))
    failed = said.filter("label is null").select(F.col("source").alias(id_col))
    rules = entities(docs.join(failed, id_col, "left_semi"), id_col, text, hint)
    return said.filter("label is not null").withColumn("mode", F.lit("model")).union(rules.withColumn("mode", F.lit("heuristic")))
