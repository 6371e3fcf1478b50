"""Labelled rows for fitting: folds and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TRAIN = 20_000


def fold(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; -1 for a null id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % folds, F.lit(-1)).cast("int")


def sample(labels: DataFrame, label_col: str, folds: int, held_out: int, bound: int = MAX_TRAIN) -> DataFrame:
    """doc_id, label: of rows outside the held-out fold, ``bound`` at most, by the order of a hash of the id.

    Null ids and labels go; an id with several labels gets their rounded mean.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (fold("doc_id", folds) != held_out))
    rows = rows.groupBy("doc_id").agg(F.round(F.avg("label")).cast("int").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
