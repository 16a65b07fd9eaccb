"""Small fixtures with known results."""

import json
import math
from datetime import date

import pytest

from pyspark.sql import functions as F

from quarrygraph.functions import sql
from quarrygraph.functions import text as T
from quarrygraph.operators import answer, cdc, evaluate, graph, proof, prune, rank, records, retrieve, workload
from quarrygraph.plans import questions as plans
from quarrygraph.plans import sessions
from quarrygraph.sources import adapters, catalog, extract, generate, parse, pdf, readers, samples
from quarrygraph.streaming import limiter, watch

NODE = "label string, id string, props map<string,string>, nums map<string,double>"


def values(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_scalars(spark):
    one = lambda f, *xs: values(spark, [(x,) for x in xs], "x string", f(F.col("x")))
    assert one(T.singular, "doctors", "losses", "policies", "address", "gas") == ["doctor", "loss", "policy", "address", "gas"]
    assert one(T.seed_ids, "POL-001 and CLM-0002, POL-001, COV-0001, FRD-CLM-0003") == [["POL-001", "CLM-0002", "CLM-0003"]]
    assert one(T.direction, "coverage of it", "over 5", "less than", "unless") == [0, 1, -1, 0]
    assert one(lambda c: T.direction(c, True), "coverage", "unless") == [1, -1]
    assert one(T.numeric_tokens, "over $1,000 or 33.5") == [[1000, 33, 5]]
    assert one(T.verdict, "Yes, fraud.", "It is not flagged as fraud", "no information", "fine", None) == ["YES", "NO", "UNKNOWN", "UNKNOWN", "UNKNOWN"]
    assert one(T.token_count, "", "abc", "a" * 9, None) == [0, 1, 2, 0]
    assert one(T.number, "$1,200", "5%", "nan", "?", "x", "") == [1200.0, 5.0, None, None, None, None]
    assert one(T.native_number, "1,200.5", "1e5", "-3", "5%") == [1200.5, None, -3.0, None]
    assert one(lambda c: T.plain_number(c.cast("double")), "54036", "0.92", "10000000") == ["54036.0", "0.92", "10000000.0"]
    assert one(lambda c: T.policy_id(c, F.lit(7)), "12", "123456", "AB") == ["POL-0012", "POL-123456", "POL-0007"]


def test_verdict_of_one_claim(spark):
    text = "CLM-001 shows fraud. CLM-002 is not flagged."
    df = spark.createDataFrame([(text, c) for c in ("CLM-001", "CLM-002", "CLM-003")], "t string, c string")
    assert [r[0] for r in df.select(T.verdict_for(F.col("t"), F.col("c"))).collect()] == ["YES", "NO", "UNKNOWN"]


def entity(label, id_, props=None, nums=None):
    return (label, id_, props or {}, nums or {})


def test_diff_tells_missing_from_null_and_finds_changes(spark):
    old = spark.createDataFrame([entity("A", "1", {"x": "1", "y": None}), entity("A", "2", {"x": "1"}), entity("A", "3"), entity("A", "5", {"x": None, "y": "2"}), ("A", "6", None, None), ("A", "7", None, None)], NODE)
    new = spark.createDataFrame([entity("A", "1", {"x": "1"}), entity("A", "2", {"x": "2"}), entity("A", "4"), entity("B", "3"), entity("A", "5", {"y": "2", "x": None}), ("A", "6", None, None), ("A", "7", {}, None)], NODE)
    got = {(r.label, r.id): r.change for r in cdc.diff(old, new).collect()}
    assert got == {("A", "1"): "modified", ("A", "2"): "modified", ("A", "3"): "deleted", ("A", "4"): "added", ("B", "3"): "added", ("A", "7"): "modified"}


def test_apply_drops_a_stale_edge_while_its_old_source_lives(spark):
    nodes = spark.createDataFrame([entity("Policy", "POL-1"), entity("Investigator", "INV-1"), entity("Claim", "CLM-1", {"a": "1", "b": "2"}), entity("Claim", "CLM-9")], NODE)
    edges = spark.createDataFrame([("INV-1", "INVESTIGATES_CLAIM", "CLM-1"), ("POL-1", "HAS_CLAIM", "CLM-1")], "src string, type string, dst string")
    snap = spark.createDataFrame([("d", *entity("Claim", "CLM-1", {"a": "1", "policy_id": "POL-1", "investigator_id": "INV-1"})), ("d", *entity("Claim", "CLM-9")), ("e", *entity("Claim", "CLM-9"))], "doc_id string, " + NODE)
    new = spark.createDataFrame([entity("Claim", "CLM-1", {"a": "3", "policy_id": "POL-1", "investigator_id": "INV-2"})], NODE)
    n, e, s, counts = cdc.apply(nodes, edges, snap, "d", new)
    assert {tuple(r) for r in e.collect()} == {("INV-2", "INVESTIGATES_CLAIM", "CLM-1"), ("POL-1", "HAS_CLAIM", "CLM-1")}
    by = {r.id: r for r in n.collect()}
    assert by["CLM-1"].props == {"a": "3", "b": "2"} and "INV-2" in by and "CLM-9" in by
    assert counts.first().asDict() == {"added": 0, "modified": 1, "deleted": 1, "deleted_skipped": 1}
    assert s.count() == 2


def test_expand_and_paths(spark):
    edges = spark.createDataFrame([(a, "T", b) for a, b in zip("ABCDEF", "BCDEFG")], "src string, type string, dst string")
    seeds = spark.createDataFrame([(1, "A"), (2, "D")], "qid int, id string")
    visited, met = graph.expand(edges, seeds, 2)
    assert {(r.qid, r.id, r.depth) for r in visited.collect()} == {(1, "A", 0), (1, "B", 1), (1, "C", 2), (2, "D", 0), (2, "C", 1), (2, "E", 1), (2, "B", 2), (2, "F", 2)}
    assert {(r.src, r.dst) for r in met.filter("qid = 1").collect()} == {("A", "B"), ("B", "C")}
    paths = graph.simple_paths(edges, seeds.filter("qid = 1"), 3)
    assert sorted("".join(r.path) for r in paths.collect()) == ["AB", "ABC", "ABCD"]
    assert [r.id for r in graph.visited_in_order(paths).orderBy("position").collect()] == list("ABCD")


def test_bm25_saturation_length_and_bonus(spark):
    q = spark.createDataFrame([(1, "which are paid"), (2, "pol-001")], "qid int, query string")
    docs = spark.createDataFrame([("POL-001", "other words"), ("a", "paid claim"), ("b", "paid paid claim"), ("c", "paid " + "filler " * 200)], "id string, text string")
    got = {(r.qid, r.id): r for r in rank.bm25(q, docs).collect()}
    assert 1 < got[1, "b"].score / got[1, "a"].score < 2
    assert got[1, "c"].score < got[1, "a"].score
    assert got[2, "POL-001"].score == 5.0 and got[2, "POL-001"].rank == 1


def test_fold_passes_over_and_goes_on(spark):
    rows = [(1, "a", 1, 6, False), (1, "b", 2, 6, False), (1, "c", 3, 4, False), (1, "p", 4, 1, True), (2, "x", 1, 99, False)]
    got = {r.qid: r for r in prune.fold(spark.createDataFrame(rows, "qid int, id string, rank int, cost int, protected boolean"), 11).collect()}
    assert got[1].kept == ["p", "a", "c"] and got[1].dropped == ["b"]
    assert got[2].kept == ["x"]


def test_missing_ids_give_no_seeds(spark):
    nodes = spark.createDataFrame([entity("Claim", "CLM-001", {"cause": "fire"}, {"amount": 200000.0})], NODE)
    q = spark.createDataFrame([(1, "status of CLM-99999"), (2, "claims over $100,000"), (3, "fires")], "qid int, query string")
    assert {(r.qid, r.id, r.kind) for r in retrieve.seeds(q, nodes).collect()} == {(2, "CLM-001", "numeric"), (3, "CLM-001", "keyword")}
    assert 1 in {r.qid for r in retrieve.seeds(q, nodes, fallthrough=True).collect()}


def test_metrics(spark):
    c = spark.createDataFrame([(80, 5, 900, 20), (0, 0, 0, 0)], "tp int, fp int, tn int, fn int")
    a, b = evaluate.rates(c).collect()
    assert (a.precision, a.recall) == (0.9412, 0.8) and (b.precision, b.recall, b.f1, b.accuracy) == (0, 0, 0, 0)
    w = spark.createDataFrame([(10200, 10200), (83, 83), (0, 0)], "ok int, n int").select(evaluate.wilson(F.col("ok"), F.col("n")).alias("w")).select("w.*").collect()
    assert [tuple(r) for r in w] == [(99.96, 100.0), (95.58, 100.0), (0.0, 1.0)]
    assert evaluate.positions(3, 10) == [1, 2, 3] and evaluate.positions(100, 5)[0] == 1 and evaluate.positions(100, 5)[-1] == 100 and evaluate.positions(10, 1) == [5]


def test_sliding_window(spark):
    rows = [(i, "u", i) for i in range(6)] + [(6, "u", 61)]
    df = spark.createDataFrame(rows, "event_id int, user string, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = [r.accepted for r in limiter.admit(df, "user", "ts", "event_id", 5, 60).orderBy("event_id").collect()]
    assert got == [True] * 5 + [False, True]


def test_adapters(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text("claim_id, amount,fraud\nC1,12000,yes\n,300,no\nC3,8000,1\n")
    nodes, edges = adapters.adapt_any(readers.csv_rows(spark, str(p)))
    got = sorted((r.label, r.id) for r in nodes.collect())
    assert got == [("Claim", "C1"), ("Claim", "C3"), ("Claim", "CLM-00002"), ("FraudFlag", "FRD-00001"), ("FraudFlag", "FRD-00003")]
    assert edges.count() == 2
    p.write_text("name,age,city\nA,1,x\nB,2,\n")
    assert sorted(r.id for r in adapters.adapt_any(readers.csv_rows(spark, str(p)))[0].collect()) == ["REC-00001", "REC-00002"]
    p.write_text("PolicyNumber,Sex,Age,MaritalStatus,DriverRating,PolicyType,Deductible,BasePolicy,Fault,AccidentArea,VehiclePrice,MonthClaimed,DayOfWeekClaimed,Make,VehicleCategory,PoliceReportFiled,FraudFound_P\n7,M,30,S,2,T,400,All,Own,Urban,more than 69000,Jan,Monday,Kia,Sedan,No,1\n7,F,31,S,2,T,400,All,Own,Rural,20000,Feb,Monday,Kia,Sedan,No,0\n")
    nodes, edges = adapters.adapt(readers.csv_rows(spark, str(p)), adapters.layouts()["fraud_oracle"])
    by = {(r.label, r.id): r for r in nodes.collect()}
    assert by["Policyholder", "PH-0007"].nums["age"] == 30.0 and ("FraudFlag", "FRD-00001") in by and len(by) == 5
    assert edges.count() == 4


def test_parse(spark):
    text = "Policy ID POL-1\n Status  OLD\nStatus NEW\nCOV-12AUTO-AAUTO$1,000$50a; b;\nEND-1 E-7 RIDER 2020-01-02 -$5"
    rows = parse.lines(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    assert {r.key: r.value for r in parse.key_values(rows).collect()} == {"Policy ID": "POL-1", "Status": "NEW"}
    c = parse.coverages(rows).first()
    assert (c.coverage_id, c.limit, c.exclusions) == ("COV-12", 1000.0, ["a", "b"])
    assert parse.endorsements(rows).first().premium_adjustment == -5.0


def test_records(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text("".join(json.dumps({"audit_id": str(i), "timestamp": f"2020-01-{i:02d}"}) + "\n" for i in range(1, 13)) + '{"audit_id": "to')
    kept = records.recent(records.read(spark, str(p)), 5).collect()
    assert [r.audit_id for r in kept] == ["12", "11", "10", "9", "8"]
    assert "&lt;b&gt;" in records.report({"q": "<b>"})
    log = str(tmp_path / "log")
    rows = [(i, f"q{i}", "a", ["s"], ["k"], ["d"], 10, 5, 50.0) for i in range(6)]
    answers = spark.createDataFrame(rows, "qid int, query string, answer string, seeds array<string>, kept array<string>, dropped array<string>, tokens_before long, tokens_after long, savings_percent double")
    for day in (1, 2):
        records.append(records.of_answers(answers, f"2020-01-0{day}", timings_ms={"retrieve": 1.5}), log)
    read = records.read(spark, log).collect()
    assert len({r.audit_id for r in read}) == 12 and read[0].pruned.kept_count == 1 and read[0].timings_ms == {"retrieve": 1.5}
    assert {r.status for r in records.node_status(records.read(spark, log)).collect()} == {"kept", "dropped"}
    assert records.trim(spark, log, 6) == 6 and records.trim(spark, log, 6) == 0
    assert {r.timestamp for r in records.read(spark, log).collect()} == {"2020-01-02"}
    assert records.clear(spark, log) == 6 and not (tmp_path / "log").exists()


def test_answers(spark):
    nodes = spark.createDataFrame([entity("Policy", "POL-001", {"status": "A"}), entity("Claim", "CLM-001", {"cause": "fire"}), entity("FraudFlag", "FRD-001", {"severity": "HIGH", "reason": "r"}), entity("Coverage", "COV-001", {"category": "AUTO"}, {"limit": 1000.0})], NODE)
    edges = spark.createDataFrame([("POL-001", "HAS_CLAIM", "CLM-001"), ("CLM-001", "FRAUD_DETECTED", "FRD-001"), ("POL-001", "COVERS", "COV-001")], "src string, type string, dst string")
    q = spark.createDataFrame([(1, "Is there fraud on POL-001?"), (2, "What covers POL-001?"), (3, "Who is PH-999?")], "qid int, query string")
    got = {r.qid: r for r in plans.answer_batch(q, nodes, edges).collect()}
    assert got[1].answer == "Yes — 1 fraud flag(s) found for claims CLM-001: FRD-001 (severity=HIGH, reason=r)"
    assert got[2].answer == "COV-001 (AUTO, limit=$1,000)"
    assert got[3].answer == "No relevant context found for this query." and got[3].kept == []


def test_a_batch_answers_like_each_question_alone(spark):
    nodes = spark.createDataFrame([entity("Policyholder", "PH-001", {"name": "Ann"})] + [entity("Policy", f"POL-00{i}", {"status": "A"}) for i in (1, 2)] + [entity("Claim", f"CLM-00{i}", {"cause": "fire"}) for i in (1, 2)] + [entity("FraudFlag", f"FRD-00{i}", {"severity": "HIGH"}) for i in (1, 2)], NODE)
    links = [("PH-001", "HAS_POLICY", "POL-001"), ("PH-001", "HAS_POLICY", "POL-002"), ("POL-001", "HAS_CLAIM", "CLM-001"), ("POL-002", "HAS_CLAIM", "CLM-002"), ("CLM-001", "FRAUD_DETECTED", "FRD-001"), ("CLM-002", "FRAUD_DETECTED", "FRD-002")]
    edges = spark.createDataFrame(links, "src string, type string, dst string")
    asked = [(1, "Is there fraud on POL-001?"), (2, "Is there fraud on POL-002 of PH-001?"), (3, "Which fraud flags has CLM-002?"), (4, "What is the status of POL-001?")]
    form = "qid int, query string"
    batch = sorted(plans.answer_batch(spark.createDataFrame(asked, form), nodes, edges, hops=1, budget=30).collect())
    alone = [plans.answer_batch(spark.createDataFrame([q], form), nodes, edges, hops=1, budget=30).first() for q in asked]
    assert batch == alone
    seen = plans.graph.protected(spark.createDataFrame([(*e, q) for e, q in zip(links, (1, 2, 2, 2, 2, 2))], "src string, type string, dst string, qid int"), nodes.select("id", "label"), spark.createDataFrame([(1, "PH-001")], "qid int, id string"), spark.createDataFrame([(1, "Policy")], "qid int, label string"))
    assert {r.id for r in seen.collect()} == {"PH-001", "POL-001"}


POLICY = """Commercial Insurance Policy
Policy ID POL-001
Policy Number P-7
Status ACTIVE
Term 2024-01-01 to 2025-01-01
Annual Premium $1,200
Policyholder
Policyholder ID PH-001
Name Ann Lee
Risk Score 0.4
Coverages
COV-12AUTO-AAUTO$1,000$50fire; flood;
Endorsements
END-1 E-7 RIDER 2020-01-02 -$5"""
CLAIM = "Claim Report\nClaim ID CLM-001\nPolicy ID POL-001\nAmount unknown\nCause FIRE\nThe barn burnt\ndown.\nFraud Flag\nFlag ID FRD-001\nSeverity HIGH\nConfidence 0.9\nInvestigator\nInvestigator ID INV-001\nName Bo"


def test_extract(spark):
    docs = [(1, POLICY, "a.pdf"), (2, CLAIM, "b.pdf"), (3, "Policy Endorsement\nPolicy POL-001\nType RIDER", "END-0042.pdf"), (4, "nothing", "x"), (5, None, None), (6, "", "y")]
    rows = extract.entities(spark.createDataFrame(docs, "n int, body string, file string"), "n", "body", "file").collect()
    by = {(r.source, r.label): r for r in rows}
    assert len(rows) == len(by) == 8
    assert by[1, "Policy"].props == {"policy_number": "P-7", "status": "ACTIVE", "policyholder_id": "PH-001", "start_date": "2024-01-01", "end_date": "2025-01-01"}
    assert by[1, "Policy"].nums == {"premium": 1200.0} and by[1, "Policyholder"].nums == {"risk_score": 0.4}
    assert by[1, "Coverage"].props == {"policy_id": "POL-001", "code": "AUTO-A", "category": "AUTO", "exclusions": "fire; flood"} and by[1, "Coverage"].nums == {"limit": 1000.0, "deductible": 50.0}
    assert by[1, "Endorsement"].props["policy_id"] == "POL-001" and by[1, "Endorsement"].nums == {"premium_adjustment": -5.0}
    claim = by[2, "Claim"]
    assert claim.props["description"] == "The barn burnt down." and claim.props["amount"] == "unknown" and claim.props["investigator_id"] == "INV-001" and claim.nums == {}
    assert by[2, "FraudFlag"].props["claim_id"] == "CLM-001" and by[2, "Investigator"].id == "INV-001"
    assert by[3, "Endorsement"].id == "END-0042"


def test_apply_batch(spark):
    kinds = "doc_id string, " + NODE
    nodes = spark.createDataFrame([entity("Policy", "POL-1"), entity("Claim", "CLM-1", {"a": "1"}), entity("Claim", "CLM-9"), entity("Claim", "CLM-8")], NODE)
    edges = spark.createDataFrame([("POL-1", "HAS_CLAIM", "CLM-1"), ("POL-1", "HAS_CLAIM", "CLM-9")], "src string, type string, dst string")
    snap = spark.createDataFrame([("d", *entity("Claim", "CLM-1", {"a": "1", "policy_id": "POL-1"})), ("d", *entity("Claim", "CLM-9")), ("e", *entity("Claim", "CLM-9")), ("e", *entity("Claim", "CLM-8")), ("f", *entity("Claim", "CLM-8"))], kinds)
    new = spark.createDataFrame([("d", *entity("Claim", "CLM-1", {"a": "2", "policy_id": "POL-2"})), ("g", *entity("Claim", "CLM-1", {"a": "3", "b": None}, {"amount": 5.0}))], kinds)
    docs = spark.createDataFrame([("d",), ("e",), ("g",)], "doc_id string")
    n, e, s, counts = cdc.apply_batch(nodes, edges, snap, new, docs)
    by = {r.id: r for r in n.collect()}
    assert set(by) == {"POL-1", "POL-2", "CLM-1", "CLM-8"}  # both documents dropped CLM-9, one still holds CLM-8
    assert by["CLM-1"].props == {"a": "3", "b": None} and by["CLM-1"].nums == {"amount": 5.0}
    assert {tuple(r) for r in e.collect()} == {("POL-2", "HAS_CLAIM", "CLM-1")}
    assert {r.doc_id: (r.added, r.modified, r.deleted, r.deleted_skipped) for r in counts.collect()} == {"d": (0, 1, 1, 0), "e": (0, 0, 2, 1), "g": (1, 0, 0, 0)}
    assert s.count() == 3


def test_apply_changes_stream(spark, tmp_path):
    kinds = "doc_id string, " + NODE
    state = {"v": (spark.createDataFrame([], NODE), spark.createDataFrame([], "src string, type string, dst string"), spark.createDataFrame([], kinds))}

    def save(nodes, edges, snapshots, number):
        for name, df in zip(("n", "e", "s"), (nodes, edges, snapshots)):
            df.write.mode("overwrite").parquet(f"{tmp_path}/{number}/{name}")
        state["v"] = tuple(spark.read.parquet(f"{tmp_path}/{number}/{x}") for x in "nes")

    for version in ("1", "2"):
        spark.createDataFrame([("d", *entity("Claim", "CLM-1", {"a": version, "policy_id": f"POL-{version}"}))], kinds).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(kinds).parquet(f"{tmp_path}/in")
        limiter.apply_changes(stream, lambda: state["v"], save, f"{tmp_path}/checkpoint").awaitTermination(60)
    assert {tuple(r) for r in state["v"][1].collect()} == {("POL-2", "HAS_CLAIM", "CLM-1")}
    assert {r.id: r.props for r in state["v"][0].collect()} == {"CLM-1": {"a": "2"}, "POL-1": {}, "POL-2": {}}


def test_admit_stream_equals_admit(spark, tmp_path):
    rows = [(i, f"u{i % 3}", i * 7 % 200) for i in range(90)]
    df = spark.createDataFrame(rows, "event_id int, user string, s int").withColumn("ts", F.timestamp_seconds("s"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    got = limiter.admit_stream(stream, "user", "ts", 3, 30)
    query = got.writeStream.format("memory").queryName("admitted").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    streamed = spark.table("admitted").groupBy("key").agg(F.count_if("accepted").alias("n"), F.count(F.lit(1)).alias("all"))
    batch = limiter.admit(df, "user", "ts", "event_id", 3, 30).groupBy(F.col("user").alias("key")).agg(F.count_if("accepted").alias("n"), F.count(F.lit(1)).alias("all"))
    assert {tuple(r) for r in streamed.collect()} == {tuple(r) for r in batch.collect()}


def test_neighbourhood_seeds(spark):
    nodes = [entity("Policy", "POL-001", {"status": "paid"}), entity("Claim", "CLM-001", {"cause": "fire"}, {"amount": 200000.0}), entity("Claim", "CLM-002", {"cause": "flood"}, {"amount": 5.0})]
    found = spark.createDataFrame([(1, *n) for n in nodes], "qid int, " + NODE)
    q = spark.createDataFrame([(1, "fires over $100,000 on POL-001")], "qid int, query string")
    got = retrieve.neighbourhood_seeds(q, spark.createDataFrame([(1, "POL-001")], "qid int, id string"), found)
    assert [(r.id, r.kind) for r in got.collect()] == [("CLM-001", "keyword")]


def test_comparison_and_flags(spark):
    q = spark.createDataFrame([(1, "Is CLM-002 fraud?")], "qid int, query string")
    pruned = spark.createDataFrame([(1, ["CLM-001", "POL-1"], ["CLM-003", "CLM-002"])], "qid int, kept array<string>, dropped array<string>")
    answers = spark.createDataFrame([(1, "CLM-002 shows fraud. CLM-001 is not flagged.")], "qid int, answer string")
    truth = spark.createDataFrame([("CLM-001", True), ("CLM-002", True), ("CLM-003", False)], "claim string, fraud boolean")
    got = [tuple(r)[2:] for r in evaluate.comparison(q, pruned, answers, truth).orderBy("position").collect()]
    assert got == [("CLM-002", "YES", "Fraud", "correct"), ("CLM-001", "NO", "Fraud", "wrong"), ("CLM-003", "UNKNOWN", "Not fraud", "no-verdict")]
    rows = spark.createDataFrame([("a", True, "YES", ["FRD-1"], []), ("b", True, "NO", ["FRD-2"], ["FRD-2"]), ("c", False, "NO", [], [])], "claim_id string, truth boolean, verdict string, visited array<string>, kept array<string>")
    assert tuple(evaluate.flag_survival(evaluate.claim_rows(rows)).first()) == (100.0, 50.0)
    ids = spark.range(100)
    assert evaluate.sample(ids, 0, "id").count() == 0 and evaluate.sample(ids, 500, "id").count() == 100
    assert evaluate.sample(ids, 7, "id", 3).collect() == evaluate.sample(ids.repartition(5), 7, "id", 3).collect()


def test_node_status(spark, tmp_path):
    rec = {"audit_id": "x", "ranking": [{"id": "A", "label": "Claim", "score": 1.0}], "pruned": {"kept": ["A"], "dropped": ["B"]}, "traversal": {"nodes_visited": ["A", "B", "C"]}}
    (tmp_path / "a.jsonl").write_text(json.dumps(rec) + "\n" + json.dumps({"audit_id": "y"}) + "\n")
    audit = records.read(spark, f"{tmp_path}/a.jsonl")
    got = [r.asDict() for r in records.node_status(audit).orderBy("id").collect()]
    assert [(r["id"], r["label"], r["status"]) for r in got] == [("A", "Claim", "kept"), ("B", "Node", "dropped"), ("C", "Node", "visited")]
    assert "&lt;b&gt;" in records.lineage([{"id": "<b>", "label": "L", "status": "kept"}], [["A", "T", "B"]])
    assert records.get(audit, "y").count() == 1


def test_workload(spark):
    rows = [(i, f"POL-{i % 4:03d}", f"CLM-{i:03d}", i % 5 == 0, float(i), "Fire " if i % 2 else "flood") for i in range(1, 21)]
    df = spark.createDataFrame(rows, "row long, policy string, claim string, fraud boolean, amount double, word string")
    got = {r.query: r for r in workload.build(df, 12).collect()}
    assert len(got) == 12 and len({r.qid for r in got.values()}) == 12
    assert got["What is the status of claim CLM-001?"].expected == ["CLM-001"] and "What is the status of claim CLM-020?" in got
    assert got["Show me all fraud claims under policy POL-001"].expected == ["CLM-005"]
    cuts = {r.query: r.expected for r in workload.thresholds(df, (0.5, 0.95)).collect()}
    assert cuts["Show me all claims with Amount over 11.5"] == [f"CLM-{i:03d}" for i in range(12, 21)] and cuts["Show me all claims with Amount over 19.5"] == ["CLM-020"]
    assert {r.query.split()[-1]: len(r.expected) for r in workload.keywords(df).collect()} == {"fire": 10, "flood": 10}
    assert workload.thresholds(df.limit(0)).count() == 0 and workload.thresholds(df.filter("row = 1")).count() == 0
    asked = spark.createDataFrame([(1, "id-lookup", "q", ["A"], "exact"), (2, "keyword", "k", ["A", "B"], "top-k"), (3, "keyword", "z", ["A"], "top-k")], "qid int, category string, query string, expected array<string>, mode string")
    results = spark.createDataFrame([(1, ["A", "X"], ["X"], [], 9, 5, 44.4), (2, ["B"], ["B"], ["CLM-9"], 1, 1, 0.0)], "qid int, retrieved array<string>, kept array<string>, seeds array<string>, tokens_before int, tokens_after int, savings_percent double")
    judged = {r.qid: r for r in workload.judge(asked, results).collect()}
    assert (judged[1].retrieval_hit, judged[1].prune_hit, judged[1].missing_after_prune) == (True, False, ["A"])
    assert (judged[2].retrieval_hit, judged[2].expected_found, judged[3].retrieval_hit) == (False, 1, False)


def test_proof(spark, tmp_path):
    run = {"dataset": "d", "queries": 10, "retrieval_accuracy": 100.0, "pruning_accuracy": 90.0, "avg_savings_pct": 5.0, "avg_latency_ms": 1.0, "results": [{"category": "id-lookup", "tokens_before": 100, "tokens_after": 60}]}
    for i, more in enumerate(({}, {"queries": 30, "pruning_accuracy": 50.0})):
        (tmp_path / f"real_{i}.json").write_text(json.dumps(run | more, indent=1))
        (tmp_path / f"fraud_detection_{i}.json").write_text(json.dumps({"confusion": {"tp": 40, "fp": i, "tn": 9, "fn": 0}}))
        (tmp_path / f"generalization_{i}.json").write_text(json.dumps({"probes_total": 4, "retrieval_prune_passed": 3, "answer_level_passed": 2, "by_kind": {"negative": {"passed": 1, "total": 2}}}))
    runs = proof.read(spark, f"{tmp_path}/real_*.json", proof.RUN)
    r = proof.overall(proof.per_run(runs)).first()
    assert (r.queries, r.raw_tokens, r.optimized_tokens, r.pruning_accuracy, r.saved_tokens_per_query, r.annual_savings_usd) == (40, 200, 120, 60.0, 2.0, 18.25)
    assert proof.overall(proof.per_run(runs.limit(0))).first().queries == 0
    f = proof.fraud(proof.read(spark, f"{tmp_path}/fraud_detection_*.json", proof.FRAUD)).first()
    assert (f.tp, f.fp, f.recall, f.precision) == (80, 1, 1.0, 0.9877)
    assert {p.kind: (p.passed, p.total) for p in proof.probes(proof.read(spark, f"{tmp_path}/generalization_*.json", proof.PROBES)).collect()} == {"negative": (2, 4), "all": (6, 8)}
    assert proof.mix(runs).first().share == 100.0


def test_samples(spark):
    pol = 'id string, policy_number string, premium double, policyholder struct<id:string,name:string,risk_score:double>, coverages array<struct<id:string,code:string,limit:double,exclusions:array<string>>>, endorsements array<struct<id:string,policy_id:string,type:string>>'
    policies = spark.createDataFrame([("POL-1", "P", 9.0, ("PH-1", "Ann", 0.5), [("COV-1", "A", 1.0, ["x"])], [("END-1", "POL-1", "RIDER")])], pol)
    claims = spark.createDataFrame([("D1", ("CLM-1", "POL-1", 5.0), ("FRD-1", "CLM-1"), None), ("D2", ("CLM-2", "POL-1", None), None, ("INV-1", "Bo"))], "doc_id string, claim struct<id:string,policy_id:string,amount:double>, fraud_flag struct<id:string,claim_id:string>, investigator struct<id:string,name:string>")
    ends = spark.createDataFrame([("END-1", "POL-1", "LIMIT", 3.0)], "id string, policy_id string, type string, premium_adjustment double")
    nodes, edges = samples.flatten(policies, claims, ends)
    by = {r.id: r for r in nodes.collect()}
    assert set(by) == {"POL-1", "PH-1", "COV-1", "END-1", "CLM-1", "CLM-2", "FRD-1", "INV-1"}
    assert by["COV-1"].props == {"code": "A"} and by["COV-1"].nums == {"limit": 1.0} and by["END-1"].props == {"type": "LIMIT"} and by["CLM-2"].nums == {}
    assert {tuple(r) for r in edges.collect()} == {("PH-1", "HAS_POLICY", "POL-1"), ("POL-1", "COVERS", "COV-1"), ("POL-1", "ENDORSED_BY", "END-1"), ("POL-1", "HAS_CLAIM", "CLM-1"), ("POL-1", "HAS_CLAIM", "CLM-2"), ("CLM-1", "FRAUD_DETECTED", "FRD-1"), ("INV-1", "INVESTIGATES_CLAIM", "CLM-2")}
    assert tuple(catalog.post_state(nodes, edges, "POL-1").first()) == (9.0, 1, 1, 1)


def test_samples_merge_rows_of_one_node(spark):
    pol = "id string, policyholder struct<id:string,name:string,city:string>, coverages array<struct<id:string,code:string>>, endorsements array<struct<id:string,policy_id:string>>"
    policies = spark.createDataFrame([("POL-1", ("PH-1", "Ann", None), [], []), ("POL-2", ("PH-1", None, "Rome"), [], [])], pol)
    claims = spark.createDataFrame([], "doc_id string, claim struct<id:string,policy_id:string>, fraud_flag struct<id:string>, investigator struct<id:string>")
    nodes, _ = samples.flatten(policies, claims, spark.createDataFrame([], "id string, policy_id string"))
    assert {r.id: r.props for r in nodes.collect()} == {"PH-1": {"name": "Ann", "city": "Rome"}, "POL-1": {}, "POL-2": {}}


def test_csv_rows_number_files_in_order(spark, tmp_path):
    (tmp_path / "b.csv").write_text("x,y\n" + "".join(f'b{i},"1\n2"\n' for i in range(300)))
    (tmp_path / "a.csv").write_text("x,y\n" + "".join(f"a{i},\n" for i in range(5)))
    rows = sorted(readers.csv_rows(spark, str(tmp_path)).collect(), key=lambda r: r.row)
    assert [(r.x, r.row) for r in rows] == [(x, n + 1) for n, x in enumerate([f"a{i}" for i in range(5)] + [f"b{i}" for i in range(300)])]
    assert rows[0].y is None and rows[-1].y == "1\n2"
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        rows = readers.csv_rows(spark, f"{tmp_path}/a.csv", multi_line=False).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.row, r.x) for r in rows) == [(i + 1, f"a{i}") for i in range(5)]
    assert readers.newest(spark, f"{tmp_path}/*.csv").count() == 1


def test_thresholds_find_the_smallest_ids(spark):
    import random

    rng = random.Random(1)
    draw = [lambda: rng.uniform(-5, 5), lambda: rng.uniform(0, 1e4), lambda: float(rng.randint(0, 50)), lambda: 1e15 * rng.random(), lambda: -1e14 * rng.random(), lambda: rng.choice([math.inf, -math.inf, 3.000001, 3.0])]
    values = [("L", rng.choice("ab"), f"{rng.randint(0, 900):04d}", rng.choice(draw)()) for _ in range(1500)] + [("L", "a", "0000", None)]
    wanted = {("L", rng.choice("abc"), rng.choice([-1, 0, 1]), rng.choice([rng.randint(0, 50), rng.randint(0, 10000), 3, 10**15])) for _ in range(60)}
    found = retrieve.smallest_past(spark.createDataFrame(values, "label string, k string, id string, v double"), spark.createDataFrame(sorted(wanted), "label string, k string, dir int, t bigint"), 5)
    meets = {1: lambda v, t: v >= t, -1: lambda v, t: v <= t, 0: lambda v, t: v == t}
    want = {(*w, i) for w in wanted for i in sorted({i for _, k, i, v in values if k == w[1] and v is not None and meets[w[2]](v, w[3])})[:5]}
    assert {tuple(r) for r in found.collect()} == want


def test_keywords_lie_in_runs_of_letters(spark):
    nodes = spark.createDataFrame([("A", "1", {"name": "Fire-damaged CAR7cars", "cause": "fire"}, {}), ("B", "2", {"reason": "wildfires", "email": None}, {}), ("B", "3", {"zip": "fire", "name": ""}, {})], "label string, id string, props map<string,string>, nums map<string,double>")
    q = spark.createDataFrame([(1, "fires and cars"), (2, "x"), (3, None)], "qid int, query string")
    assert {tuple(r) for r in retrieve.keyword_hits(q, nodes).collect()} == _contained(q, nodes)


def _contained(q, nodes):
    out = {}
    for r in q.select("qid", F.explode(F.transform(T.value_tokens(F.col("query")), T.singular)).alias("tok")).collect():
        for n in nodes.collect():
            hits = sum(r.tok in (v or "").lower() for k, v in n.props.items() if k in retrieve.KEYWORD_PROPS)
            if hits:
                out[r.qid, n.id] = out.get((r.qid, n.id), 0) + hits
    return {(*k, v) for k, v in out.items()}


def test_rank_by_model_falls_back(spark):
    q = spark.createDataFrame([(1, "who is the investigator?"), (2, "bad")], "qid int, query string")
    texts = spark.createDataFrame([(1, "a", "Claim", "xx"), (1, "b", "Investigator", "x"), (2, "c", "Claim", "x"), (2, "d", "Claim", "y")], "qid int, id string, label string, text string")
    words = spark.createDataFrame([(1, "a", 9.0), (2, "d", 1.0)], "qid int, id string, score double")
    by = lambda scorer: {(r.qid, r.id): (r.score, r["rank"], r["mode"]) for r in rank.by_model(q, texts, words, scorer).collect()}
    got = by(lambda pairs: [len(t) if query != "bad" or t == "x" else None for query, t in pairs])
    assert got == {(1, "b"): (3.5, 1, "model"), (1, "a"): (2.0, 2, "model"), (2, "d"): (1.0, 1, "lexical"), (2, "c"): (0.0, 2, "lexical")}

    def broken(pairs):
        raise OSError("down")

    assert {m for *_, m in by(broken).values()} == {"lexical"} and {m for *_, m in by(lambda pairs: []).values()} == {"lexical"}


def test_validation_rows(spark):
    entries = spark.createDataFrame([("one", ["a", "b"], "a", True), ("two", ["c"], "c", False), ("three", ["d"], "d", True)], "label string, files array<string>, fraud_name string, labelled boolean")
    runs = spark.createDataFrame([("a", 1, 100.0, 100.0, 10.0, 5.0), ("b", 3, 60.0, 20.0, 30.0, 9.0), ("c", 2, 50.0, 50.0, 1.0, 1.0)], "dataset string, queries long, retrieval_accuracy double, pruning_accuracy double, avg_savings_pct double, avg_latency_ms double")
    frauds = spark.createDataFrame([("a", 8, 2, 5, 0)], "dataset string, tp long, fp long, tn long, fn long")
    got = {r.label: tuple(r)[1:] for r in proof.validation(entries, runs, frauds).collect()}
    assert got == {"one": (4, 70.0, 40.0, 25.0, 8.0, "80% / 100% / 89%", "measured"), "two": (2, 50.0, 50.0, 1.0, 1.0, "no labels", "measured"), "three": (0, None, None, None, None, "—", "no bench")}


def test_torn_lines_are_shown(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"audit_id": "a"}\n{"audit_id": "b\n\n[1]\n{"audit_id": "c"}\n')
    assert sorted(r.line for r in records.torn(spark, f"{tmp_path}/log.json").collect()) == ["[1]", '{"audit_id": "b']


def test_catalog(spark, tmp_path):
    c = catalog.Catalog(spark, f"{tmp_path}/catalog")
    assert c.current() == "pdf_demo" and c.loaded() is None
    assert c.add(" my   claims", "csv", ["a.csv"]) == "my claims"
    for bad in ("", "a/b", "x" * 49, "pdf_demo", "my claims"):
        with pytest.raises(ValueError):
            c.add(bad, "csv", [])
    c.stamp("my claims")
    assert c.current() == "my claims"
    c.stamp("synthetic", reset=False)
    assert c.loaded() == "my claims"
    assert c.rename("my claims", "other") == "other" and c.current() == "pdf_demo"
    c.stamp("data_synthetic")
    assert c.current() == "insurance_dataset" and c.sessions().filter("kind = 'custom'").count() == 1
    c.remove("other")
    assert c.entries().count() == 0


def test_follow(spark, tmp_path):
    seen = []
    (tmp_path / "in").mkdir()
    for name in ("a.csv", "b.txt", "c.csv"):
        (tmp_path / "in" / name).write_text("x\n1\n")
        watch.follow(spark, f"{tmp_path}/in", lambda df, n: seen.extend(r.path.rsplit("/", 1)[1] for r in df.collect()), f"{tmp_path}/checkpoint").awaitTermination(60)
    assert seen == ["a.csv", "c.csv"]


def test_generated_answers_fall_back(spark):
    q = spark.createDataFrame([(1, "a {context}?"), (2, "b"), (3, "c")], "qid int, query string")
    ctx = spark.createDataFrame([(1, "x {query} y"), (2, "z")], "qid int, text string")
    rules = spark.createDataFrame([(1, "r1"), (2, "r2"), (3, "r3")], "qid int, answer string")
    echo = lambda prompts: [p if "x" in p else None for p in prompts]
    got = {r.qid: tuple(r)[1:] for r in answer.generated(q, ctx, rules, echo, "Q: {query} C: {context}").collect()}
    assert got == {1: ("Q: a {context}? C: x {query} y", "model", None), 2: ("r2", "extractive", "no answer"), 3: ("r3", "extractive", "no context")}

    def broken(prompts):
        raise OSError("down")

    assert {r.qid: (r.answer, r.reason) for r in answer.generated(q, ctx, rules, broken).collect()} == {1: ("r1", "OSError: down"), 2: ("r2", "OSError: down"), 3: ("r3", "no context")}
    assert {r.mode for r in answer.generated(q, ctx, rules).collect()} == {"extractive"}


def test_pdf_round_trip_and_other_files(spark, tmp_path):
    lines = ["Policy ID POL-1", "(a \\ (b))", "é", *[f"line {i}" for i in range(pdf.PAGE_LINES)]]
    made = pdf.render(lines)
    pages = pdf.text_of(made).split("\n\n")
    assert len(pages) == 2 and "\n".join(pages).split("\n") == lines
    assert pdf.text_of(pdf.render(["x" * (pdf.LINE_CHARS + 1)])) == "x" * pdf.LINE_CHARS + "\nx"
    assert [pdf.text_of(b) for b in (None, b"", b"no file", made.replace(b"trailer\n<<", b"trailer\n<< /Encrypt 9 0 R"))] == [""] * 4
    for cut in range(0, len(made), 97):  # torn files end somewhere
        pdf.text_of(made[:cut])
    (tmp_path / "a.pdf").write_bytes(made)
    assert pdf.documents(spark, str(tmp_path)).first().text == "\n\n".join(pages)
    assert readers.fingerprints(spark, str(tmp_path)).first().modified is not None


def test_pdf_fonts_positions_and_object_streams():
    cmap = b"2 beginbfchar <0001> <0041> <0002> <00420063> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange"
    page = b"BT /F1 9 Tf 1 0 0 1 10 700 Tm <00010002> Tj 5 0 Td <0010> Tj 1 0 0 1 10 680 Tm [(\0\\021) -300 <0012>] TJ ET BT /F2 9 Tf (pl\\\nain) ' ET BI /W 1 ID \x00(\xff EI"
    packed = b"3 0 4 60 << /Type /Page /Contents [6 0 R] /Parent 2 0 R >>".ljust(68) + b"<< /Type /Font /Subtype /Type0 /ToUnicode 7 0 R >>"
    stream = lambda n, head, body: b"%d 0 obj << %s /Length %d >> stream\n%s\nendstream endobj\n" % (n, head, len(body), body)
    file = b"%PDF-1.5\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R 2 0 R] /Resources << /Font << /F1 4 0 R >> >> >> endobj\n"
    file += stream(5, b"/Type /ObjStm /N 2 /First 8", packed) + stream(6, b"", page) + stream(7, b"", cmap)
    assert pdf.text_of(file) == "ABc a\nb c\nplain"


def test_uploads_are_checked():
    pdf.checked_upload("my file-1.PDF", b"%PDF-1.4")
    for name, content in ((None, b"%PDF"), ("a.txt", b"%PDF"), ("a/b.pdf", b"%PDF"), ("a.pdf", b""), ("a.pdf", b"PK"), ("a.pdf", b"%PDF" + b"x" * 9)):
        with pytest.raises(ValueError):
            pdf.checked_upload(name, content, most=8)


def test_sql_functions_equal_columns(spark):
    names = sql.register(spark)
    texts = ["Which claims over $40,000 are on POL-00001's policies, not CLM-0002 or 33.5?", "unless the doctors' losses exceed under", "policies", "gas", "classes", "Yes fraud", "isn't fraud", "no information on fraud", "", None]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    same = {"query_tokens": T.query_tokens, "seed_ids": T.seed_ids, "claim_ids": T.claim_ids, "value_tokens": T.value_tokens, "numeric_tokens": T.numeric_tokens, "threshold_direction": T.direction, "singular": T.singular, "count_tokens": T.token_count, "verdict": T.verdict}
    for name, f in same.items():
        assert all(a == b for a, b in df.select(F.expr(f"{name}(x)").alias("a"), f(F.col("x")).alias("b")).collect()), name
    assert set(names) == set(same) | {"savings_percent", "key_values"}
    assert spark.range(1).selectExpr("savings_percent(0, 3)", "savings_percent(10, 3)", "savings_percent(3, 10)").first()[:] == (0.0, 70.0, 0.0)
    spark.createDataFrame([(1, "Policy ID POL-1\nStatus A\r\n Status B\nother")], "id int, text string").createOrReplaceTempView("printed")
    assert {tuple(r) for r in spark.sql("select id, k.* from printed, lateral key_values(text) k").collect()} == {(1, "Policy ID", "POL-1"), (1, "Status", "B")}


def test_generated_records_make_a_graph(spark, tmp_path):
    ends = generate.endorsements(spark, 7, 20, 10)
    p, c = generate.policies(spark, 7, 10, ends), generate.claims(spark, 7, 200, 10, 10)
    nodes, edges = samples.flatten(p, c, ends)
    n = {r.label: r["count"] for r in nodes.groupBy("label").count().collect()}
    e = {r.type: r["count"] for r in edges.groupBy("type").count().collect()}
    flags = c.filter("fraud_flag is not null").count()
    assert (n["Policy"], n["Policyholder"], n["Claim"], n["Endorsement"], n["FraudFlag"]) == (10, 10, 200, 20, flags) and n["Investigator"] <= 6
    assert (e["HAS_POLICY"], e["HAS_CLAIM"], e["ENDORSED_BY"], e["FRAUD_DETECTED"], e["COVERS"]) == (10, 200, 20, flags, n["Coverage"])
    joined = c.select("claim.*", "fraud_flag.severity").join(p.select(F.col("id").alias("policy_id"), "premium", "start_date", "end_date"), "policy_id").collect()
    assert {r.severity for r in joined} == {"HIGH", "MEDIUM", "LOW", None}
    for r in joined:
        age = (date.fromisoformat(r.date) - date.fromisoformat(r.start_date)).days
        assert 0 <= age <= 540 and (r.severity == "HIGH") == (age <= 7)
        assert (r.severity == "MEDIUM") == (age > 7 and r.amount > 10 * r.premium)
    again = generate.claims(spark, 7, 200, 10, 10).repartition(3)
    assert sorted(again.collect(), key=str) == sorted(c.collect(), key=str)
    assert generate.claims(spark, 8, 200, 10, 10).exceptAll(c).count() > 0
    generate.export(p, c, ends, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/claims").count() == 200


def test_reports_stamps_and_stage_times(tmp_path):
    record = {"audit_id": "a/1", "query": "<q>\nsecond", "tokens": {"before": 3}}
    paths = records.export_report(record, str(tmp_path / "out"))
    assert [p.rsplit("/", 1)[1] for p in paths] == ["audit_a_1.json", "audit_a_1.html", "audit_a_1.pdf"]
    with open(paths[0], encoding="utf-8") as f:
        assert json.load(f) == record
    with open(paths[2], "rb") as f:
        assert pdf.text_of(f.read()).split("\n") == ["audit_id: a/1", "query: <q>", "second", 'tokens: {"before": 3}']
    once = records.stamped("# R\n\ntext\n", "day 1", ["a"], 2.5)
    twice = records.stamped(once, "day 2", ["a", "b"], 3.0)
    assert twice == "# R\n\ntext\n\n*Last run day 2 (3.0s): a, b*\n" and records.stamped("", "d", ["a"], 1.0).startswith(records.STAMP)
    assert records.stage_times([("", 1.0), ("a", 1.5), ("b", 3.5)]) == {"a": 500.0, "b": 2000.0, "total": 2500.0} and records.stage_times([]) == {}


def test_schema_scripts(spark):
    script = "/* a; b */ create or replace temporary view one as select 1 as x;\n-- no; \n// none\ncreate or replace temporary view two as select x + 1 as x from one;\n;"
    assert catalog.apply_script(spark, script.replace("-- no; ", "-- no")) == 2 and spark.table("two").first().x == 2


def test_sessions_switch_once_and_measure_uploads_once(spark, tmp_path):
    c = catalog.Catalog(spark, f"{tmp_path}/catalog")
    c.add("mine", "csv", ["a.csv"])
    loads, measures = [], []

    def load(session, say):
        loads.append(session)
        say(f"loading {session}")
        if session == "fraud_oracle":
            raise OSError("no file")

    s = sessions.Sessions(c, load, measures.append, lambda session: session in measures)
    assert s.switch("mine") == "loaded" and s.switch("mine") == "already_loaded" and s.switch("mine", force=True) == "loaded"
    s.wait()
    assert loads == ["mine", "mine"] and measures == ["mine"] and not s.measuring("mine")
    with pytest.raises(ValueError):
        s.start("o'ther")
    failed = s.start("fraud_oracle")
    assert failed.wait(60) and not failed.ok and failed.error == "OSError: no file" and c.current() == "mine"
    good = s.start("pdf_demo")
    assert good.wait(60) and good.ok and good.log == ["loading pdf_demo", "loaded"] and c.current() == "pdf_demo" and measures == ["mine"]


def test_failed_probes_are_believed_for_a_while():
    now, asked, answers = [0.0], [], [False, True, True]

    def ask(address):
        asked.append(address)
        return answers.pop(0)

    probe = sessions.Probe(ask, 15, lambda: now[0])
    assert not probe("a") and not probe("a") and len(asked) == 1
    now[0] = 15.0
    assert probe("a") and probe("a") and len(asked) == 3
    assert not probe("a") and len(asked) == 4  # nothing left to answer: an error counts as failure
