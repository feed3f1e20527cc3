"""Continuous ingest: each micro-batch of a stream is applied to a named index as an upsert."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

if TYPE_CHECKING:
    from pyspark.sql.streaming import StreamingQuery

    from siftwell.index import DocumentIndex


def ingest(stream: DataFrame, index: DocumentIndex, root: str, name: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts a query that upserts the stream's rows into the index saved as root/name; a batch repeated after a failure changes nothing more.

    Readers load the saved index; each batch writes a new version and then switches the manifest to it.
    """
    from siftwell.sources import snapshot

    snapshot.save(index, root, name)

    def upsert(rows: DataFrame, epoch: int) -> None:
        # a batch costs what it holds: the saved documents stay unread until deltas reach a share of them
        rows = rows.persist()
        try:
            if not rows.isEmpty() and snapshot.manifest(rows.sparkSession, root, name).get("batch", -1) < epoch:
                snapshot.append(rows, root, name, index.schema, batch=epoch)
        finally:
            rows.unpersist()

    writer = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
