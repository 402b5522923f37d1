"""Query images as a stream against a standing index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Index
from ..operators.retrieve import TOP
from ..plans.pipeline import query
from ..sources.store import temporary


def query_stream(stream: DataFrame, index: Index, positions: DataFrame, path: str, checkpoint: str, k: int = TOP, **trigger) -> StreamingQuery:
    """Writes the rankings of each micro-batch under `path`, a folder a batch; a batch that runs again replaces its own.

    An image's features must arrive together: its ranking depends on all of them, and on nothing else, so no state is kept.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        with temporary(batch.sparkSession):
            query(index, batch, positions, k).write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
