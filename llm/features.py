"""Bounded samples of labelled rows for training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _one_row_an_id(rows: DataFrame) -> DataFrame:
    """Reduced in the map tasks, so that an id with very many rows costs no more than others."""
    return rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "label")).alias("row")).select("doc_id", "row.text", "row.label")


def training_rows(docs: DataFrame, labels: DataFrame | None, label: str, modulus: int, held: int, rows: int) -> DataFrame:
    """text, label of at most ``rows`` documents whose crc32(doc_id as text) mod ``modulus`` is not ``held``: those with the smallest hash
    of their id, so that the choice doesn't follow the order of files.  Documents without id, text or label are left out;
    where the labels of one id disagree, the larger counts; of rows with equal id, the text of smallest hash counts."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([F.col(label).alias("label")] if labels is None else []))
    own = own.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (crc % modulus != held))
    order = F.xxhash64(F.lit("training"), "doc_id")
    if labels is None:
        ids = own.filter(F.col("label").isNotNull()).select("doc_id", "label")
    else:
        ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        ids = ids.filter(F.col("label").isNotNull() & (crc % modulus != held)).groupBy("doc_id").agg(F.max("label").alias("label"))
    if labels is None:
        return _one_row_an_id(own.filter(F.col("label").isNotNull())).orderBy(order).limit(rows)
    chosen = ids.orderBy(order).limit(rows)
    return _one_row_an_id(own.join(F.broadcast(chosen), "doc_id"))  # at most ``rows`` ids and labels
