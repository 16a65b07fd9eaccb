"""The record log reads each whole line once, in parallel, and from where it stopped."""

import json

import pytest
from pyspark.sql import functions as F

from quarrygraph.sources import record_log

SCHEMA = "id long, text string"


def line(i, text="x"):
    return json.dumps({"id": i, "text": text}, ensure_ascii=False) + "\n"


@pytest.mark.parametrize("piece", [1, 7, 100, 1 << 20])
def test_every_line_once(spark, tmp_path, piece):
    folder = tmp_path / "log"
    (folder / "sub").mkdir(parents=True)
    rows = [line(i, "é" * (i % 5) + "y" * (300 if i == 7 else 0)) for i in range(40)]
    (folder / "a.json").write_text("".join(rows[:30]), encoding="utf-8")
    (folder / "sub" / "b.json").write_text("".join(rows[30:]) + '{"id": 99, "te', encoding="utf-8")
    (folder / "empty.json").write_text("")
    (folder / "_SUCCESS").write_text(line(500))
    (folder / "c.json").write_text('not json\n[1]\n\n{"id": 41, "text": null}\r\n')
    got = record_log.read_log(spark, str(folder), SCHEMA, piece)
    assert sorted((r.id, r.text) for r in got.collect()) == sorted([(json.loads(x)["id"], json.loads(x)["text"]) for x in rows] + [(41, None)])
    raw = spark.read.format("record_log").option("piece", piece).load(f"file://{folder}")
    assert raw.count() == 44 and raw.select("path", "offset").distinct().count() == 44
    assert (raw.rdd.getNumPartitions() > 10) == (piece <= 100)


def test_missing_logs_and_paths(spark, tmp_path):
    assert record_log.read_log(spark, f"{tmp_path}/none", SCHEMA).count() == 0
    with pytest.raises(Exception, match="path"):
        spark.read.format("record_log").load().count()


def test_stream_continues_where_it_stopped(spark, tmp_path):
    log, seen = tmp_path / "log.json", f"{tmp_path}/seen"

    def run():
        stream = record_log.follow_log(spark, str(log), SCHEMA, 50)
        save = lambda df, n: df.write.mode("overwrite").parquet(f"{seen}/batch={n}")
        query = stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{tmp_path}/check").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted(r.id for r in spark.read.schema(SCHEMA).parquet(seen).collect())

    log.write_text("".join(line(i) for i in range(10)) + '{"id": 10, ')
    assert run() == list(range(10))
    with log.open("a") as f:
        f.write('"text": "torn before"}\n' + line(11))
    assert run() == list(range(12))
    assert run() == list(range(12))
    log.write_text(line(0))
    with pytest.raises(Exception, match="rewritten"):
        run()


def test_equals_the_batch_reader(spark, tmp_path):
    spark.range(5000).select("id", F.repeat(F.lit("t"), (F.col("id") % 50).cast("int")).alias("text")).repartition(3).write.json(f"{tmp_path}/j")
    a = record_log.read_log(spark, f"{tmp_path}/j", SCHEMA, 10_000)
    b = spark.read.schema(SCHEMA).json(f"{tmp_path}/j")
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0
