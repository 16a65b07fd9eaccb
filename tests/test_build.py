import pytest

from quarrygraph.plans import build
from quarrygraph.sources import extract
from tests.test_operators import CLAIM, NODE, POLICY

DOCS = [(1, POLICY, "a.pdf"), (2, CLAIM, "b.pdf"), (3, "model", "POL-0077.pdf"), (4, "none", None), (5, None, None), (6, "", None), (7, "no record", None)]


SAID = {
    "model": {"Policy": {"POL-9": {"status": "OPEN", "premium": 5, "note": None, "tags": ["a", 1], "live": True}, "": {"x": "y"}}, "Claim": {"CLM-9": {"policy_id": "POL-9"}}},
    "none": {},
}


def toy():
    """Made here, so that workers need not import the tests."""
    said = SAID
    return lambda texts: [said.get(s) for s in texts]


def test_models_extract_and_rules_stand_in(spark):
    docs = spark.createDataFrame(DOCS, "n int, body string, file string")
    rows = extract.by_model(docs, toy(), "n", "body", "file").collect()
    got = {(r.source, r.id): r for r in rows}
    rules = {(r.source, r.id): r for r in extract.entities(docs, "n", "body", "file").collect()}
    assert len(rows) == len(got) and {k for k, r in got.items() if r.mode == "model"} == {(3, "POL-9"), (3, "CLM-9")}
    assert got[3, "POL-9"].doc_id == "POL-0077" and got[3, "POL-9"].nums == {"premium": 5.0}
    assert got[3, "POL-9"].props == {"status": "OPEN", "tags": '["a", 1]', "live": "true"}
    assert {k: (r.doc_id, r.props, r.nums) for k, r in got.items() if r.mode == "heuristic"} == {k: (r.doc_id, r.props, r.nums) for k, r in rules.items()}

    def down(texts):
        raise OSError("down")

    assert {(r.source, r.id, r.mode) for r in extract.by_model(docs, down, "n", "body", "file").collect()} == {(*k, "heuristic") for k in rules}
    with pytest.raises(Exception, match="down"):
        extract.by_model(docs, down, "n", "body", "file", strict=True).count()
    with pytest.raises(Exception, match="failed on a text"):
        extract.by_model(docs, toy(), "n", "body", "file", strict=True).count()
    assert extract.by_model(docs.limit(0), toy, "n", "body", "file").count() == 0


def test_documents_become_a_graph(spark):
    docs = spark.createDataFrame(DOCS + [(8, CLAIM.replace("HIGH", "LOW"), "b.pdf")], "n int, body string, file string")
    nodes = spark.createDataFrame([], NODE)
    edges = spark.createDataFrame([], "src string, type string, dst string")
    snapshots = spark.createDataFrame([], "doc_id string, " + NODE)
    n, e, s, counts = build.from_documents(nodes, edges, snapshots, docs, "n", "body", "file", toy())
    by = {r.id: r for r in n.collect()}
    # of the two rows of one claim the later one counts
    assert by["FRD-001"].props["severity"] == "LOW" and by["POL-9"].nums == {"premium": 5.0} and "policy_id" not in by["CLM-9"].props
    links = {tuple(r) for r in e.collect()}
    assert {("POL-9", "HAS_CLAIM", "CLM-9"), ("POL-001", "HAS_CLAIM", "CLM-001"), ("CLM-001", "FRAUD_DETECTED", "FRD-001"), ("INV-001", "INVESTIGATES_CLAIM", "CLM-001")} <= links
    added = {r.doc_id: r.added for r in counts.collect()}
    assert added["POL-0077"] == 2 and added["CLM-001"] == 3
    again = build.from_documents(n, e, s, docs, "n", "body", "file", toy())
    assert again[3].count() == 0 and {tuple(r) for r in again[1].collect()} == links and again[0].count() == len(by)
