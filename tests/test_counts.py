"""Counts moved by changes equal counts of all snapshots."""

import random

import pytest
from pyspark.sql import functions as F

from quarrygraph.operators import cdc, counts, graph

NODE = "label string, id string, props map<string,string>, nums map<string,double>"
SNAP = "doc_id int, " + NODE


def version(rng, doc):
    out = {}
    for _ in range(rng.randrange(6)):
        out["Policyholder", f"PH-{rng.randrange(5)}"] = {"name": rng.choice("ab")}
    for _ in range(rng.randrange(8)):
        out["Policy", f"POL-{rng.randrange(12)}"] = {"policyholder_id": f"PH-{rng.randrange(5)}"} if rng.random() < 0.8 else {}
    for _ in range(rng.randrange(4)):
        out["Claim", f"CLM-{rng.randrange(9)}"] = {"policy_id": f"POL-{rng.randrange(12)}", "investigator_id": None}
    return [(doc, label, i, props, {}) for (label, i), props in out.items()]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_counts_equal_recounts_after_batches(spark, tmp_path):
    rng = random.Random(8)
    c = counts.Counts(spark, f"{tmp_path}/c")
    now = {d: [] for d in range(6)}
    snap = lambda docs: spark.createDataFrame([r for d in docs for r in now[d]], SNAP)
    for batch in range(1, 5):
        docs = list(range(6)) if batch == 1 else rng.sample(range(6), 3)
        old, everything = snap(docs), snap(now)
        for d in docs:
            now[d] = version(rng, d)
        new = snap(docs)
        got = c.apply(old, new, batch)
        empty = spark.createDataFrame([], NODE), spark.createDataFrame([], "src string, type string, dst string")
        want = cdc.apply_batch(*empty, everything, new, spark.createDataFrame([(d,) for d in docs], "doc_id int"))[3]
        assert rows_of(got.select(*want.columns)) == rows_of(want)
        labels, types, around = counts.recount(snap(now))
        assert rows_of(c.labels.read()) == rows_of(labels) and rows_of(c.types.read()) == rows_of(types) and rows_of(c.around.read()) == rows_of(around)
        if batch == 2:
            # a batch that is run again changes nothing, and folding keeps all counts
            assert rows_of(c.apply(old, new, batch)) == rows_of(got)
            assert rows_of(c.types.read()) == rows_of(types)
            c.compact()
            assert rows_of(c.around.read()) == rows_of(around) and len(c.refs._folders()) == 1
            with pytest.raises(ValueError):
                c.refs.add(c.refs.read(), 2)
        asked = spark.createDataFrame([("PH-1",), ("PH-2",), ("PH-2",), ("none",)], "id string")
        edges = counts._derived(snap(now), 1).select(*graph.EDGE).distinct()
        assert c.touching(asked.distinct()).first()[0] == graph.touching(edges, asked).first()[0]
        held = snap(now).join(asked.distinct(), "id", "left_semi").select("id").distinct()
        assert rows_of(c.still_referenced(asked)) == rows_of(held)


def test_small_batches_read_their_parts_alone(spark, tmp_path):
    ledger = counts.Ledger(spark, f"{tmp_path}/l", "id string", 32)
    assert ledger.read().count() == 0
    ledger.add(spark.range(5000).select(F.concat(F.lit("n"), "id").alias("id"), F.lit(2).alias("n")), 1)
    ledger.add(spark.createDataFrame([("n7", -2), ("n8", 1), ("n8", -1), ("m", 5)], "id string, n int"), 2)
    asked = ledger.read(spark.createDataFrame([("n7",), ("n9",)], "id string"))
    assert rows_of(asked) == [("n9", 2)]
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert all("part#" in x.split("]")[0] for x in plan.split("PartitionFilters: [")[1:3])
    assert ledger.read().count() == 5000
    moved = ledger.moved(spark.createDataFrame([("n9", -2), ("new", 1)], "id string, n int"))
    assert sorted((r.id, r.before, r.after) for r in moved.collect()) == [("n9", 2, 0), ("new", 0, 1)]
