"""Documents that arrive as a stream are encoded with the codec as it is and added to the index, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import VectorIndex


def add_stream(index: VectorIndex, docs: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Start adding a stream of (doc_id, flat). The last batch number is part of the index's manifest, so a batch that is
    delivered again after a failure is passed over."""

    def add(batch: DataFrame, number: int) -> None:
        if number <= index.facts.get("stream_batch", -1):
            return
        index.update(batch, facts={"stream_batch": number})

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
