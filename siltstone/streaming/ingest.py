"""Continuous ingestion: a stream of observations into the change log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from siltstone.operators.changes import ChangeLog


def follow(
    stream: DataFrame, log: ChangeLog, key: Column, version: Column, values: dict[str, Column], checkpoint: str,
    after: Callable[[int], None] | None = None, once: bool = True,
) -> StreamingQuery:
    """Append each micro-batch of a stream to the log and run it.

    A micro-batch that is delivered again after a failure is appended again; its rows are not
    newer than those already there, so that the sink, which deduplicates by key, is unchanged.
    `after` gets the number of every committed run.
    """

    def batch(rows: DataFrame, _: int) -> None:
        log.append(rows, key, version, values)
        run = log.run()
        if after is not None:
            after(run)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
