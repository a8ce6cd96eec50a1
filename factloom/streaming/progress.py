"""Progress of running queries: a callback per finished micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Calls back with (query's name, batch, rows of the batch, rows so far); counts are the driver's."""

    def __init__(self, tell: Callable[[str | None, int, int, int], None]):
        self.tell, self.rows = tell, {}

    def onQueryStarted(self, event) -> None:  # noqa: N802 - the interface's names
        self.rows[str(event.id)] = 0

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.rows[str(p.id)] = self.rows.get(str(p.id), 0) + p.numInputRows
        self.tell(p.name, p.batchId, p.numInputRows, self.rows[str(p.id)])

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.rows.pop(str(event.id), None)


def watch(spark: SparkSession, tell: Callable[[str | None, int, int, int], None]) -> Progress:
    """Add a listener that calls back; remove it with spark.streams.removeListener()."""
    p = Progress(tell)
    spark.streams.addListener(p)
    return p
