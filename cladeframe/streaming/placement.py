"""Placing sequences as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cladeframe.operators import place as L


def place_stream(queries: DataFrame, profiles: DataFrame, out: str, checkpoint: str, once: bool = False, **kw) -> StreamingQuery:
    """Append ``(seq_id, edge_id, score)`` of every arriving query to the Parquet table ``out``.

    Each query is placed by itself, so there is no state and nothing can be late.  A batch is
    written to a folder of its own number: a batch that is run again after a loss replaces what
    it had written.  ``once`` takes what is there and ends.  ``profiles`` should be written or
    checkpointed, as every batch reads them.
    """

    def batch(rows: DataFrame, number: int) -> None:
        L.best_edge(rows, profiles, **kw).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
