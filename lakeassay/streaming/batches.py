"""Investigations of a stream, one for each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.investigate import investigate
from ..plans.model import Dossier


def investigate_stream(source: DataFrame, sink: Callable[[Dossier, int], None], target: str | None = None, checkpoint: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Start a query that gives ``sink`` the dossier and number of every batch with rows.

    A batch may be given again after a failure, with its number; a sink that keeps
    dossiers by number keeps each once.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # many aggregates read it
        try:
            if batch.limit(1).count():
                sink(investigate(batch, target), number)
        finally:
            batch.unpersist()

    writer = source.writeStream.foreachBatch(each)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
