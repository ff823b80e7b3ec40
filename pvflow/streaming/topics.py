"""A stream into ordered topics, each message once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pvflow.sources import topics


def publish(stream: DataFrame, path: str, plan: Callable[[DataFrame], DataFrame], order: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Every micro-batch, through ``plan``, to all its topics at once.

    ``plan`` gives messages with ``topic``. The number of the batch is that of the stream's log, so a batch that is
    repeated after a failure finds what it wrote, or writes anew beside what no manifest names (``sources.topics``).
    Positions in a topic go on from batch to batch.
    """
    return (
        stream.writeStream.foreachBatch(lambda batch, number: topics.append(plan(batch), path, order, number))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
