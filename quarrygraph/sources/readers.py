"""Sources: CSV with row numbers, JSON arrays, raw documents, graph export and import."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv_rows(spark: SparkSession, path: str, header: list[str] | None = None, multi_line: bool = True) -> DataFrame:
    """All cells as strings, header names trimmed, ``row`` from 1: files by path, then in the file's order.

    Types are never inferred: a column may hold numbers and words.  Cells with line breaks need
    ``multi_line``, which reads a file in one task; without it large files are read in blocks.
    """
    names = header or [c.lstrip("\ufeff").strip() for c in spark.read.option("header", True).option("inferSchema", False).csv(path).columns]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.schema(schema).csv(path, header=True, enforceSchema=True, mode="PERMISSIVE", multiLine=multi_line)
    # a block lies in one partition, so numbers that rise there give its order; the blocks' counts give its start
    cells = [F.col(f"`{n}`") for n in names]
    placed = df.select(*cells, F.struct("_metadata.file_path", "_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    blocks = placed.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("_block", "_first", before.alias("_before"))
    return placed.join(starts, "_block").select(*cells, (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("row"))


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def documents(spark: SparkSession, path: str, to_text=None) -> DataFrame:
    """``path, text`` of raw files; ``to_text(bytes)`` parses other formats than UTF-8 text."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    if to_text is None:
        return raw.select("path", F.coalesce(F.decode("content", "UTF-8"), F.lit("")).alias("text"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([to_text(c) if c else "" for c in b.column("content").to_pylist()], pa.string())], names=["path", "text"])

    return raw.mapInArrow(run, "path string, text string")


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """``path, size, modified, digest``: what a change of files is told by; the digest alone tells one of content."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("digest"))


def export_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def import_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def newest(spark: SparkSession, pattern: str) -> DataFrame:
    """``path, modified`` of the file changed last, the largest path of several; no row without a file.

    Contents are not read.
    """
    files = spark.read.format("binaryFile").load(pattern).select("path", F.col("modificationTime").alias("modified"))
    return files.orderBy(F.desc("modified"), F.desc("path")).limit(1)
