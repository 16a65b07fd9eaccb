"""Documents to a graph in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cdc, graph
from ..sources import extract


def from_documents(nodes: DataFrame, edges: DataFrame, snapshots: DataFrame, docs: DataFrame, id_col: str = "doc_id", text: str = "text", hint: str | None = None, extractor=None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and snapshots after an upload of documents, and the counts of changes per record.

    Entities are read by rules or, with ``extractor``, by a model where it answers.  A record is known by its own
    id, else by its row's; of rows that hold the same record the largest row id counts, and of entities that a record
    states twice one does.  A row that gives no entity changes nothing.  The same upload again changes nothing either.
    """
    found = extract.entities(docs, id_col, text, hint) if extractor is None else extract.by_model(docs, extractor, id_col, text, hint)
    found = graph._cut(found.withColumn("doc_id", F.coalesce("doc_id", F.col("source").cast("string"))))
    new = graph._cut(cdc.baseline(cdc.latest(found, "source")).drop("version"))
    return cdc.apply_batch(nodes, edges, snapshots, new)
