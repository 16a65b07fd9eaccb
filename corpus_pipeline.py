"""A corpus pipeline over ``documents``: each stage is one of the training-data operators.

The stages are written as Parquet and read again, so that each starts from a table and a lost
executor costs no more than the stage that runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.llm import mixing, packing, shared, simhash, substring_dedup, toxicity
from quarrygraph.llm.queries import table, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a toxicity score below one half, whatever their id; repeated rows stay repeated.

    A null or empty text is scored like any other.  No column is changed.
    """
    score = shared.spare(docs, "score")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scores(docs, model, keep=True, name=score).filter(F.col(score) < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of rows with a similarity of 0.8 or more: the smallest id's, null ids last.

    Rows are told apart by a number, not by their ids: a row without an id stays unless it is a copy,
    and of rows that share an id only copies go.
    """
    row = shared.spare(docs, "row")
    rows = shared.materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(row).alias("row")))
    kept = simhash.similar_groups(rows, row=row).groupBy("component").agg(first.alias("first"))
    return rows.join(kept.select(F.col("first.row").alias(row)), row, "left_semi").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated windows; a text without repeats stays as it is.

    A document goes if none of its words is left, but of rows with equal texts that would all go one
    stays whole: the smallest id's, null ids last.  Null and short texts stay.  ``n_chars`` follows the
    text; no other column is changed.
    """
    words, removed, kept, gone, row = names = [shared.spare(docs, n) for n in ("n_words", "n_removed", "kept_text", "all_gone", "row")]
    rows = substring_dedup.remove_repeats(docs, names=tuple(names[:3]))
    some, all_gone = F.col(removed) > 0, (F.col(removed) > 0) & (F.col(removed) == F.col(words))
    text = F.when(some & ~all_gone, F.col(kept)).otherwise(F.col("text"))
    rows = rows.withColumn(gone, all_gone).withColumn("text", text).withColumn(row, F.monotonically_increasing_id())
    rows = rows.withColumn("n_chars", F.when(some & ~F.col(gone), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    # stored, so that what follows runs none of the hops again; each row holds one text
    rows = shared.materialise(rows.select(*docs.columns, gone, row), "passages")
    equal = rows.filter(F.col(gone)).groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    first = equal.agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(row).alias("row"))).alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.filter("n > 1").select(F.col("first.row").alias(row))
    whole = rows.filter(F.col(gone)).join(first, row, "left_semi")
    return rows.filter(~F.col(gone)).select(*docs.columns).union(whole.select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 2 times; no column is changed."""
    return mixing.take(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix with the sequence and offset that each has been given.

    A null or empty text is the end id alone; rows that repeat are packed as often as they occur.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Several stages are iterative or learn; the tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.materialise(stage(spark, docs, sf_dir), name)
    return docs
