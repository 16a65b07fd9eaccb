"""What few questions reach is told from the rest of the graph before anything is shuffled."""

import pytest
from pyspark.sql import functions as F

from quarrygraph.operators import graph, retrieve
from quarrygraph.plans import questions as plans


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("chain"))
    name = lambda c: F.concat(F.lit("POL-"), F.lpad(c.cast("string"), 7, "0"))
    at = spark.range(200_000)
    at.select(name(F.col("id")).alias("src"), F.lit("NEXT").alias("type"), name(F.col("id") + 1).alias("dst")).write.parquet(f"{path}/edges")
    at.select(F.lit("Policy").alias("label"), name(F.col("id")).alias("id")).write.parquet(f"{path}/nodes")
    edges = spark.read.parquet(f"{path}/edges")
    return spark.read.parquet(f"{path}/nodes"), edges.union(edges)


def shuffled(spark, run):
    """What ``run`` collects, and the bytes that its shuffles wrote."""
    total = lambda: sum(e.totalShuffleWrite() for e in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(False)))
    before = total()
    rows = sorted(map(tuple, run().collect()))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return rows, total() - before


def test_few_questions_shuffle_little(spark, chain):
    nodes, edges = chain
    q = spark.createDataFrame([(1, "What of POL-0000007?"), (2, "And POL-9999999?")], "qid int, query string")
    hints = spark.createDataFrame([(1, "Policyholder")], "qid int, label string")
    n = lambda i: f"POL-{i:07}"
    seeds, size = shuffled(spark, lambda: retrieve.id_seeds(q, nodes))
    assert seeds == [(1, n(7))] and size < 100_000
    start = spark.createDataFrame(seeds, "qid int, id string")
    paths, size = shuffled(spark, lambda: graph.simple_paths(edges, start, 2))
    assert paths == sorted([(1, [n(7), n(6)]), (1, [n(7), n(8)]), (1, [n(7), n(6), n(5)]), (1, [n(7), n(8), n(9)])]) and size < 100_000
    near, size = shuffled(spark, lambda: graph.protected(edges, nodes.select("id", "label"), start, hints))
    assert near == [(1, n(6)), (1, n(7)), (1, n(8))] and size < 100_000
    hop, size = shuffled(spark, lambda: graph.neighbours(edges, start.select("id"), out=True))
    assert hop == [(n(7), "NEXT", n(8), True)] and size < 100_000
    walk, size = shuffled(spark, lambda: plans.recursive_walk(start, edges, 2))
    assert walk == [(1, n(5), 2), (1, n(6), 1), (1, n(7), 0), (1, n(8), 1), (1, n(9), 2)] and size < 100_000


def test_smallest_of_many_are_told_from_the_rest_before_a_sort(spark):
    """More rows than the probe of a key, equal ids and short keys: the answer is that of the whole sort."""
    rows = spark.range(40_000).select((F.col("id") % 3).alias("k"), F.lpad((F.col("id") * 7919 % 20_011).cast("string"), 6, "0").alias("id"))
    rows = rows.union(spark.createDataFrame([(9, "b"), (9, "a"), (9, "a")], "k long, id string"))
    want = {}
    for k, i in rows.collect():
        want.setdefault(k, set()).add(i)
    got = {}
    for k, i in retrieve._first(rows, ["k"], [F.col("id")], 5).collect():
        got.setdefault(k, []).append(i)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:5] for k, v in want.items()}


def test_thresholds_and_words_shuffle_little(spark, tmp_path):
    at = F.col("id")
    props = F.create_map(F.lit("name"), F.concat(F.lit("Customer "), at))
    spark.range(200_000).select(F.lit("Claim").alias("label"), F.concat(F.lit("CLM-"), F.lpad(at.cast("string"), 7, "0")).alias("id"), props.alias("props"), F.create_map(F.lit("amount"), (at % 1000).cast("double")).alias("nums")).write.parquet(f"{tmp_path}/nodes")
    nodes = spark.read.parquet(f"{tmp_path}/nodes")
    q = spark.createDataFrame([(i, f"List claims above ${400 + i % 2}") for i in range(10)], "qid int, query string")
    found, size = shuffled(spark, lambda: retrieve.numeric_seeds(q, nodes))
    assert found == [(i, f"CLM-{400 + i % 2 + n:07}") for i in range(10) for n in range(5)] and size < 1_000_000
    q = spark.createDataFrame([(i, "List customers") for i in range(20)], "qid int, query string")
    found, size = shuffled(spark, lambda: retrieve.keyword_seeds(q, nodes))
    assert [r[:2] for r in found] == [(i, f"CLM-{n:07}") for i in range(20) for n in range(5)] and size < 30_000_000
