"""A streaming sink: each micro-batch becomes a container of its own, written once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources import container
from ..sources.storage import Store


def to_containers(stream: DataFrame, path: str, checkpoint: str, order: list[str], *, available_now: bool = True, **options) -> StreamingQuery:
    """Starts a query that writes batch n of ``stream`` to ``path``/batch-n.

    A batch that runs again after a failure replaces its own container, so each row is kept once.
    """

    def put(batch: DataFrame, number: int) -> None:
        container.write(batch, f"{path}/batch-{number:010d}", order=order, **options)

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def batches(spark, path: str) -> list[str]:
    """Paths of the containers of all finished batches, in order."""
    store = Store(spark, path)
    return [f"{path}/{n}" for n in sorted(store.names()) if n.startswith("batch-") and store.exists(f"{n}/manifest.json")]
