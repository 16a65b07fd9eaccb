"""Summaries over the result files of many runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import evaluate

RUN = """dataset string, queries long, retrieval_accuracy double, pruning_accuracy double, avg_savings_pct double, avg_latency_ms double,
results array<struct<category:string,tokens_before:double,tokens_after:double>>"""
FRAUD = "confusion struct<tp:long,fp:long,tn:long,fn:long>"
PROBES = "probes_total long, retrieval_prune_passed long, answer_level_passed long, by_kind map<string,struct<passed:long,total:long>>"
#: A day's questions and a price for a thousand tokens, for the projection.
PER_DAY = 10_000
PRICE = 0.0025


def read(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Result files that match ``pattern``, one JSON object each, with their names."""
    return spark.read.schema(schema).json(pattern, multiLine=True).withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))


def summary(results: DataFrame) -> DataFrame:
    """A run's judged questions (``workload.judge``) to its ``RUN`` figures, by ``dataset``."""
    pct = lambda c: F.round(100 * F.avg(F.col(c).cast("int")), 2)
    return results.groupBy("dataset").agg(F.count(F.lit(1)).alias("queries"), pct("retrieval_hit").alias("retrieval_accuracy"), pct("prune_hit").alias("pruning_accuracy"), F.round(F.avg("savings_percent"), 2).alias("avg_savings_pct"), F.sum("tokens_before").cast("long").alias("raw_tokens"), F.sum("tokens_after").cast("long").alias("optimized_tokens"))


def per_run(runs: DataFrame) -> DataFrame:
    """Run files as rows of figures; each run's tokens are summed within its row."""
    total = lambda c: F.round(F.aggregate(F.coalesce(f"results.{c}", F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))).cast("long")
    return runs.select("dataset", "queries", "retrieval_accuracy", "pruning_accuracy", "avg_savings_pct", "avg_latency_ms", total("tokens_before").alias("raw_tokens"), total("tokens_after").alias("optimized_tokens"))


def overall(rows: DataFrame, per_day: int = PER_DAY, price: float = PRICE) -> DataFrame:
    """One row: accuracies weighted by questions, an interval, tokens saved, cost saved in a year."""
    w = F.greatest(F.sum("queries"), F.lit(1))
    mean = lambda c: F.sum(F.col(c) * F.col("queries")) / w
    out = rows.agg(F.coalesce(F.sum("queries"), F.lit(0)).alias("queries"), F.coalesce(F.sum("raw_tokens"), F.lit(0)).alias("raw_tokens"), F.coalesce(F.sum("optimized_tokens"), F.lit(0)).alias("optimized_tokens"), F.coalesce(mean("retrieval_accuracy"), F.lit(0.0)).alias("r"), F.coalesce(mean("pruning_accuracy"), F.lit(0.0)).alias("p"), F.coalesce(mean("avg_savings_pct"), F.lit(0.0)).alias("s"))
    saved = (F.col("raw_tokens") - F.col("optimized_tokens")) / F.greatest("queries", F.lit(1))
    out = out.withColumn("ci", evaluate.wilson(F.round(F.col("r") / 100 * F.col("queries")), F.col("queries")))
    return out.select("queries", "raw_tokens", "optimized_tokens", F.round("r", 2).alias("retrieval_accuracy"), F.round("p", 2).alias("pruning_accuracy"), F.round("s", 2).alias("avg_savings_pct"), F.col("ci.lower").alias("ci_lower"), F.col("ci.upper").alias("ci_upper"), F.round(saved, 1).alias("saved_tokens_per_query"), F.round(saved * per_day * 365 * price / 1000, 2).alias("annual_savings_usd"))


def fraud(files: DataFrame) -> DataFrame:
    """Confusions of all files added up, with their rates."""
    total = lambda c: F.coalesce(F.sum(f"confusion.{c}"), F.lit(0)).alias(c)
    return evaluate.rates(files.agg(*[total(c) for c in ("tp", "fp", "tn", "fn")]))


def probes(files: DataFrame) -> DataFrame:
    """``kind, passed, total, accuracy`` over all files, and a row ``all``."""
    kinds = files.select(F.explode("by_kind").alias("kind", "k")).select("kind", "k.passed", "k.total")
    every = files.select(F.lit("all").alias("kind"), F.col("retrieval_prune_passed").alias("passed"), F.col("probes_total").alias("total"))
    out = kinds.union(every).groupBy("kind").agg(F.sum("passed").alias("passed"), F.sum("total").alias("total"))
    return out.withColumn("accuracy", F.when(F.col("total") > 0, F.round(100 * F.col("passed") / F.col("total"), 2)).otherwise(0.0))


def mix(runs: DataFrame, exact: str = "id-lookup") -> DataFrame:
    """``category, n, share``: what kinds of questions the runs asked; look-ups are ``exact``."""
    rows = evaluate.mix(runs.select(F.explode("results.category").alias("category")), "category")
    return rows.withColumn("exact", F.col("category") == exact)


def validation(entries: DataFrame, runs: DataFrame, frauds: DataFrame) -> DataFrame:
    """A row per entry of a validation table: ``label, queries``, weighted means, ``fraud``, ``state``.

    ``entries``: ``label, files array<string>, fraud_name, labelled`` (boolean); ``runs``: ``RUN`` figures by
    ``dataset``; ``frauds``: ``dataset`` and counts ``tp, fp, tn, fn``.  ``fraud`` reads precision, recall and F1
    in percent, ``no labels`` for a source without them, or a dash.  ``state`` is ``no bench`` without any run.
    """
    q = F.col("queries")
    mean = lambda c: F.round(F.sum(F.col(c) * q) / F.nullif(F.sum(q), F.lit(0)), 4).alias(c)
    own = entries.select("label", F.explode("files").alias("dataset")).join(runs, "dataset")
    figures = own.groupBy("label").agg(F.sum(q).alias("queries"), *[mean(c) for c in ("retrieval_accuracy", "pruning_accuracy", "avg_savings_pct", "avg_latency_ms")])
    added = frauds.groupBy("dataset").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")])
    rows = entries.join(figures, "label", "left").join(added.withColumnRenamed("dataset", "fraud_name"), "fraud_name", "left")
    tp, fp, tn, fn = (F.coalesce(c, F.lit(0)) for c in ("tp", "fp", "tn", "fn"))
    p, r, f1 = (F.when(b > 0, a / b).otherwise(0.0) for a, b in ((tp, tp + fp), (tp, tp + fn), (2 * tp, 2 * tp + fp + fn)))
    shown = F.concat_ws(" / ", *[F.format_string("%.0f%%", x * 100) for x in (p, r, f1)])
    said = F.when(tp + fp + tn + fn > 0, shown).when(~F.col("labelled"), "no labels").otherwise("—")
    asked = F.coalesce(q, F.lit(0))
    return rows.select("label", asked.alias("queries"), *figures.columns[2:], said.alias("fraud"), F.when(asked > 0, "measured").otherwise("no bench").alias("state"))


def cold_warm(timings: DataFrame) -> DataFrame:
    """``mode, cold_start_ms, avg_warm_ms`` of timed calls (``mode, call`` from 0, ``ms``)."""
    warm = F.avg(F.when(F.col("call") > 0, F.col("ms")))
    return timings.groupBy("mode").agg(F.round(F.max(F.when(F.col("call") == 0, F.col("ms"))), 1).alias("cold_start_ms"), F.coalesce(F.round(warm, 1), F.lit(0.0)).alias("avg_warm_ms"))
