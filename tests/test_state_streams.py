"""State in streams equals the same in batch, also after restarts."""

import random

import pytest
from pyspark.sql import functions as F

from quarrygraph.operators import records
from quarrygraph.streaming import rings, snapshots

ENTITY = "array<struct<label:string,id:string,props:map<string,string>,nums:map<string,double>>>"


def run(stream, tmp_path, name, mode="append"):
    """All that is there, appended to a table of files."""
    save = lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/{name}/batch={n}")
    query = stream.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}_check").trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None


def versions():
    rng = random.Random(6)
    out = []
    for doc in "abcde":
        for v in range(1, 6):
            chosen = rng.sample(range(8), rng.randrange(0, 6))
            out.append((doc, v, [("L", f"n{i}", {"p": rng.choice([None, "x", "y"])} if rng.random() < 0.8 else None, {"q": rng.choice([1.0, 2.0])} if rng.random() < 0.5 else {}) for i in chosen]))
    return out


def test_snapshot_state_equals_differences(spark, tmp_path):
    schema = f"doc_id string, version long, entities {ENTITY}"
    rows = versions()
    everything = spark.createDataFrame(rows, schema)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for part in ([1, 2], [3], [4, 5]):
        chosen = [r for r in rows if r[1] in part]
        # what is delivered twice, or after a newer version, changes nothing
        again = [r for r in rows if r[1] == part[0] - 1][:2] + [(None, 1, []), ("a", None, [])]
        spark.createDataFrame(chosen + again, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(snapshots.stream_changes(stream()), tmp_path, "changes")  # a restart from the checkpoint each time
    got = spark.read.parquet(f"{tmp_path}/changes").select("doc_id", "version", "label", "id", "change")
    want = snapshots.changes_between(everything)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r.change for r in got.collect()} == {"added", "modified", "deleted"}


SCHEMA = "user string, ts timestamp, id string, text string"


def some_records(n=400, seed=3):
    rng = random.Random(seed)
    out = [(rng.choice(["a", "b", "c", None]), 1_700_000_000 + rng.randrange(i, i + 600), f"r{i:04}", f"text {i}") for i in range(n)]
    return out + [("a", out[0][1], "r0000", "equal"), ("d", None, "x", "no time")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "user string, s long, id string, text string").select("user", F.timestamp_seconds("s").alias("ts"), "id", "text")


def test_rings_equal_retention(spark, tmp_path):
    rows = some_records()
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for part in (rows[:150], rows[150:160], rows[160:]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(rings.ring_stream(stream(), "user", "ts", "id", "text", 7), tmp_path, "rings", "update")
    got = rings.newest_rings(spark.read.parquet(f"{tmp_path}/rings"))
    keyed = frame(spark, rows).filter("ts is not null").withColumn("user", F.coalesce("user", F.lit("")))
    want = records.retain(keyed, 7, "ts", "id", "user")
    assert {(r.key, r.us, r.tie) for r in got.collect()} == {(r.user, int(r.ts.timestamp()) * 1_000_000, r.id) for r in want.collect()}
    count = {r.user: r["count"] for r in keyed.groupBy("user").count().collect()}
    assert {(r.key, r.evicted) for r in got.collect()} == {(k, c - 7) for k, c in count.items()}
    assert [r.position for r in got.filter("key = 'a'").orderBy(F.desc("us"), F.desc("tie")).collect()] == list(range(1, 8))


def test_idle_rings_expire(spark, tmp_path):
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    t = 1_700_000_000
    for part in ([("a", t, "1", "x"), ("b", t + 5, "2", "x")], [("b", t + 5000, "3", "x")], [("b", t + 5001, "4", "x")], [("a", t + 5002, "5", "x")]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(rings.ring_stream(stream(), "user", "ts", "id", "text", 3, late="10 seconds", idle_s=3600), tmp_path, "idle", "update")
    emitted = spark.read.parquet(f"{tmp_path}/idle")
    assert emitted.filter("key = 'a' and size = 0").count() == 1
    assert {(r.key, r.tie, r.evicted) for r in rings.newest_rings(emitted).collect()} == {("a", "5", 1), ("b", "4", 0), ("b", "3", 0), ("b", "2", 0)}


def test_a_large_document_is_few_entries_of_state(spark, tmp_path):
    schema = f"doc_id string, version long, entities {ENTITY}"
    rows = [("d", v, [("L", f"n{i}", {"p": str(i % v)}, {}) for i in range(0, 3000, v)]) for v in (1, 2, 3)]
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    for chosen in (rows[:2], rows[2:]):
        spark.createDataFrame(chosen, schema).write.mode("append").parquet(f"{tmp_path}/in")
        save = lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
        query = snapshots.stream_changes(stream()).writeStream.foreachBatch(save).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert query.exception() is None
        assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators) <= snapshots.BLOCKS + 2
    got = spark.read.parquet(f"{tmp_path}/out").select("doc_id", "version", "label", "id", "change")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, snapshots.changes_between(spark.createDataFrame(rows, schema)).collect()))
