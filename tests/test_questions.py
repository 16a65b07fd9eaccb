"""Whole questions with their audit log, node texts, and probes beyond the usual questions."""

from pyspark.sql import functions as F

from quarrygraph.operators import records, retrieve, workload
from quarrygraph.plans import questions

NODE = "label string, id string, props map<string,string>, nums map<string,double>"


def nodes(spark):
    rows = [
        ("Policy", "POL-00001", {"type": "auto"}, {"premium": 120.5}),
        ("Claim", "CLM-00001", {"status": "OPEN", "cause": "hail"}, {"amount": 900.0}),
        ("Claim", "CLM-00002", {"status": "SHUT", "cause": None}, {"amount": None}),
    ]
    return spark.createDataFrame(rows, NODE)


def edges(spark):
    return spark.createDataFrame([("POL-00001", "HAS_CLAIM", "CLM-00001"), ("POL-00001", "HAS_CLAIM", "CLM-00002")], "src string, type string, dst string")


def test_absent_and_null_values_leave_no_trace_in_texts(spark):
    text = retrieve.node_text(F.col("label"), F.col("id"), F.col("props"), F.col("nums"))
    got = [r[0] for r in nodes(spark).select(text).collect()]
    assert got == ["[Policy] POL-00001 insurance policy; type=auto; premium=120.5", "[Claim] CLM-00001 insurance claim; status=OPEN; amount=900.0; cause=hail", "[Claim] CLM-00002 insurance claim; status=SHUT"]


def test_ask_leaves_one_record_for_each_question(spark, tmp_path):
    log = f"{tmp_path}/log"
    asked = spark.createDataFrame([(1, "What is the status of policy POL-00001?"), (2, "What about POL-99999?")], "qid int, query string")
    answers = {r.qid: r for r in questions.ask(asked, nodes(spark), edges(spark), log, "2026-02-03T00:00:00Z").collect()}
    found = {r.query: r for r in records.read(spark, log).collect()}
    assert len(found) == 2 and answers[1].kept and not answers[2].kept
    for a in answers.values():
        r = found[a.query]
        assert (r.answer, r.timestamp, r.pruned.kept, r.pruned.dropped, r.retrieval.seeds) == (a.answer, "2026-02-03T00:00:00Z", a.kept, a.dropped, a.seeds)
        assert (r.tokens.before, r.tokens.after) == (a.tokens_before, a.tokens_after)
    # a second batch is appended
    questions.ask(asked.filter("qid = 1"), nodes(spark), edges(spark), log, "2026-02-04T00:00:00Z")
    assert records.read(spark, log).count() == 3


def test_probes_of_a_table_and_of_none(spark):
    rows = [(i, f"POL-{i % 4:05d}", f"CLM-{i:05d}", False, float(i), "Hail " if i % 3 else None) for i in range(1, 41)]
    schema = "row long, policy string, claim string, fraud boolean, amount double, word string"
    got = workload.probes(spark.createDataFrame(rows, schema), 777, n=5).collect()
    by = {}
    for r in got:
        by.setdefault(r.variant, []).append(r)
    assert sorted(len(r.expected) for r in by["policy"]) == [10] * len(by["policy"]) and all(r.mode == "exact" for r in by["policy"])
    assert by["word"][0].query.endswith("hail") and len(by["word"][0].expected) == 27
    assert by["fraud-words"][0].expected == ["CLM-00001"]
    over = by["dollar-words"][0]
    assert over.query == "Which claims come to more than $21.5?" and over.expected == [f"CLM-{i:05d}" for i in range(22, 41)]
    assert {r.variant for r in got if r.mode == "refuse"} == {"nonexistent-id", "unknown-words", "nonexistent-policy", "nonexistent-fraud-id", "occupation-words"}
    assert [r.qid for r in got] == list(range(1, len(got) + 1)) and "CLM-00777" in by["nonexistent-id"][0].query
    none = workload.probes(spark.createDataFrame([], schema), 777).collect()
    assert {r.mode for r in none} == {"refuse"} and len(none) == 5


def test_probes_are_judged_by_their_mode(spark):
    asked = [
        (1, "p", "policy", "claims of POL-00001", ["CLM-00001", "CLM-00002"], "exact"),
        (2, "p", "policy", "claims of POL-00001", ["CLM-00001", "CLM-00002"], "exact"),
        (3, "p", "word", "claims to do with hail", ["CLM-00001", "CLM-00002"], "top-k"),
        (4, "p", "word", "claims to do with hail", ["CLM-00001"], "top-k"),
        (5, "n", "nothing", "how is CLM-00777", [], "refuse"),
        (6, "n", "nothing", "how is CLM-00777", [], "refuse"),
        (7, "n", "lost", "how is CLM-00001", ["CLM-00001"], "exact"),
    ]
    said = [
        (1, "CLM-00001 and more", ["CLM-00001", "CLM-00002", "POL-00001"], ["CLM-00001"], ["POL-00001"]),
        (2, "PH-00009 it is", ["CLM-00001", "CLM-00002"], ["CLM-00001", "CLM-00002"], ["CLM-00009"]),
        (3, "see CLM-00002", ["CLM-00002"], ["CLM-00002"], ["CLM-00002", "INV-00001"]),
        (4, "see CLM-00001", ["CLM-00001"], ["CLM-00001"], ["POL-00004"]),
        (5, "No relevant context", [], [], []),
        (6, "it is CLM-00001, CLM-00001", [], [], ["CLM-00777"]),
    ]
    asked = spark.createDataFrame(asked, "qid int, kind string, variant string, query string, expected array<string>, mode string")
    said = spark.createDataFrame(said, "qid int, answer string, retrieved array<string>, kept array<string>, seeds array<string>")
    judged = workload.judge_probes(asked, said)
    got = {r.qid: (r.retrieval_hit, r.prune_hit, r.answer_ok, r.bad_seeds, r.fabricated) for r in judged.collect()}
    assert got == {
        1: (True, False, True, [], []),
        2: (False, True, False, ["CLM-00009"], []),
        3: (True, True, True, [], []),
        4: (False, False, True, ["POL-00004"], []),
        5: (True, True, True, [], []),
        6: (False, False, False, [], ["CLM-00001"]),
        7: (False, False, False, [], []),
    }
    kinds = {r.kind: (r.passed, r.total, r.answered, r.accuracy) for r in workload.probes_by_kind(judged).collect()}
    assert kinds == {"p": (1, 4, 3, 25.0), "n": (1, 3, 1, 33.33)}
