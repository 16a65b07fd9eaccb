"""Audit and metric records: append, retain, look up, report."""

from __future__ import annotations

import html
import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

AUDIT_SCHEMA = """audit_id string, timestamp string, query string, answer string, answer_mode string, answer_model string,
reranker string, max_hops int, retrieval struct<seeds:array<string>,seed_kinds:array<string>,node_count:int,edge_count:int>,
traversal struct<nodes_visited:array<string>,edges_traversed:array<array<string>>,paths:array<struct<nodes:array<string>,edges:array<array<string>>>>>,
ranking array<struct<id:string,label:string,score:double>>,
pruned struct<kept:array<string>,dropped:array<string>,kept_count:int,dropped_count:int,budget:int>,
tokens struct<before:int,after:int,savings_percent:double>, timings_ms map<string,double>"""


def append(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def read(spark: SparkSession, path: str, schema: str = AUDIT_SCHEMA) -> DataFrame:
    """Torn lines are left out; ``torn`` shows them."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def torn(spark: SparkSession, path: str) -> DataFrame:
    """``line`` of every line that is no JSON object."""
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    no_object = F.try_parse_json("line").isNull() | ~F.startswith(F.ltrim("line"), F.lit("{"))
    return lines.filter((F.trim("line") != "") & no_object)


def recent(records: DataFrame, n: int, order: str = "timestamp", tie: str = "audit_id") -> DataFrame:
    return records.orderBy(F.desc(order), F.desc(tie)).limit(n)


def retain(records: DataFrame, n: int, order: str, tie: str, by: str | None = None) -> DataFrame:
    """The newest ``n`` records, of each ``by`` if given."""
    if by is None:
        return records.orderBy(F.desc(order), F.desc(tie)).limit(n)
    w = Window.partitionBy(by).orderBy(F.desc(order), F.desc(tie))
    return records.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def rolling(records: DataFrame, n: int, order: str, tie: str, kind: str, value: str) -> DataFrame:
    """Counts and mean value by kind over the last ``n`` records."""
    last = retain(records, n, order, tie)
    return last.groupBy(F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 4).alias("mean_value"))


def trim(spark: SparkSession, path: str, n: int, schema: str = AUDIT_SCHEMA) -> int:
    """Keep the newest ``n`` records of the log at ``path``; returns how many went.

    The kept ones are written beside the log before they take its place.
    """
    records = read(spark, path, schema)
    before = records.count()
    if before <= n:
        return 0
    beside = f"{path.rstrip('/')}_kept"
    retain(records, n, "timestamp", "audit_id").write.mode("overwrite").json(beside)
    spark.read.schema(schema).json(beside).write.mode("overwrite").json(path)
    _delete(spark, beside)
    return before - n


def clear(spark: SparkSession, path: str, schema: str = AUDIT_SCHEMA) -> int:
    """Remove the log at ``path``; returns how many records it held."""
    n = read(spark, path, schema).count()
    _delete(spark, path)
    return n


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def of_answers(answers: DataFrame, timestamp: str, hops: int = 2, budget: int = 1280, timings_ms: dict[str, float] | None = None, mode: str = "extractive") -> DataFrame:
    """An audit record per row of ``questions.answer_batch``; the id is a digest of time, qid and query.

    ``timings_ms`` are the batch's stages: its questions pass each of them together.
    """
    strings, ints = "array<string>", "int"
    audit_id = F.substring(F.sha2(F.concat_ws("|", F.lit(timestamp), F.col("qid").cast("string"), "query"), 256), 1, 16)
    size = lambda c: F.size(c).cast(ints)
    timings = F.create_map(*[F.lit(x) for kv in timings_ms.items() for x in kv]) if timings_ms else F.create_map().cast("map<string,double>")
    visited = F.array_union("kept", "dropped")
    return answers.select(
        audit_id.alias("audit_id"), F.lit(timestamp).alias("timestamp"), "query", "answer", F.lit(mode).alias("answer_mode"), F.lit(hops).alias("max_hops"),
        F.struct(F.col("seeds").cast(strings).alias("seeds"), size(visited).alias("node_count")).alias("retrieval"),
        F.struct(visited.alias("nodes_visited")).alias("traversal"),
        F.struct("kept", "dropped", size("kept").alias("kept_count"), size("dropped").alias("dropped_count"), F.lit(budget).alias("budget")).alias("pruned"),
        F.struct(F.col("tokens_before").cast(ints).alias("before"), F.col("tokens_after").cast(ints).alias("after"), "savings_percent").alias("tokens"),
        timings.cast("map<string,double>").alias("timings_ms"),
    )


def get(records: DataFrame, audit_id: str) -> DataFrame:
    return records.filter(F.col("audit_id") == audit_id)


def node_status(records: DataFrame) -> DataFrame:
    """``audit_id, id, label, status`` (kept, dropped, visited) of every node that a record names.

    Dropped rules over kept.  A node without a rank has the label Node.
    """
    none = F.array().cast("array<string>")
    kept, dropped = F.coalesce("pruned.kept", none), F.coalesce("pruned.dropped", none)
    ids = F.array_distinct(F.concat(kept, dropped, F.coalesce("traversal.nodes_visited", none)))
    rows = records.select("audit_id", "ranking", kept.alias("kept"), dropped.alias("dropped"), F.explode(ids).alias("id"))
    label = F.try_element_at(F.filter("ranking", lambda r: r["id"] == F.col("id")), F.lit(-1))["label"]
    status = F.when(F.array_contains("dropped", F.col("id")), "dropped").when(F.array_contains("kept", F.col("id")), "kept").otherwise("visited")
    return rows.select("audit_id", "id", F.coalesce(label, F.lit("Node")).alias("label"), status.alias("status"))


def lineage(nodes: list[dict], edges: list[list[str]]) -> str:
    """One record's nodes (``id, label, status``) and edges as an HTML list; every value is escaped."""
    esc = lambda x: html.escape(str(x))
    rows = "".join(f"<li class='{esc(n['status'])}'>{esc(n['id'])} ({esc(n['label'])}, {esc(n['status'])})</li>" for n in nodes)
    links = "".join(f"<li>{' &rarr; '.join(esc(x) for x in e)}</li>" for e in edges)
    return f"<!doctype html><meta charset='utf-8'><title>Lineage</title><ul>{rows}</ul><ul>{links}</ul>"


def report(record: dict) -> str:
    """One record as HTML; every value is escaped."""
    rows = "".join(f"<tr><th>{html.escape(str(k))}</th><td><pre>{html.escape(json.dumps(v, ensure_ascii=False, default=str))}</pre></td></tr>" for k, v in record.items())
    return f"<!doctype html><meta charset='utf-8'><title>Audit record</title><table>{rows}</table>"


def report_lines(record: dict) -> list[str]:
    """One record as ``key: value`` lines; nested values are JSON."""
    plain = lambda v: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, default=str)
    return [line for k, v in record.items() for line in f"{k}: {plain(v)}".splitlines()]


def export_report(record: dict, folder: str) -> list[str]:
    """One record as JSON, HTML and PDF in a folder of the driver's; returns the paths.

    The name is the record's id with other characters than letters, digits, _ and - replaced.
    """
    from ..sources import pdf

    name = re.sub(r"[^A-Za-z0-9_-]", "_", str(record.get("audit_id") or "record"))
    made = {"json": json.dumps(record, ensure_ascii=False, indent=2, default=str).encode(), "html": report(record).encode(), "pdf": pdf.render(report_lines(record))}
    Path(folder).mkdir(parents=True, exist_ok=True)
    paths = {kind: Path(folder) / f"audit_{name}.{kind}" for kind in made}
    for kind, content in made.items():
        paths[kind].write_bytes(content)
    return [str(p) for p in paths.values()]


STAMP = "*Last run "


def stamped(report: str, when: str, datasets: list[str], seconds: float) -> str:
    """A report's text that ends with a line on the newest run; lines on earlier runs go."""
    kept = "\n".join(x for x in report.splitlines() if not x.startswith(STAMP)).rstrip("\n")
    line = f"{STAMP}{when} ({seconds}s): {', '.join(datasets)}*\n"
    return f"{kept}\n\n{line}" if kept else line


def stage_times(marks: list[tuple[str, float]]) -> dict[str, float]:
    """Milliseconds of each stage, and their ``total``, from (name, seconds when it ended); the first mark is the start."""
    spans = {name: round((at - before) * 1000, 2) for (_, before), (name, at) in zip(marks, marks[1:])}
    return spans | {"total": round((marks[-1][1] - marks[0][1]) * 1000, 2)} if marks else {}
