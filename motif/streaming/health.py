"""Health figures of running streams."""

from __future__ import annotations

import logging

from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger("motif.streaming")


class Health(StreamingQueryListener):
    """Counts batches and rows of every query; spark.streams.addListener(Health())."""

    def __init__(self):
        self.batches: dict[str, int] = {}
        self.rows: dict[str, int] = {}
        self.failed: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802  the names that Spark calls
        log.info("started %s", event.name or event.id)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        key = p.name or str(p.id)
        self.batches[key] = self.batches.get(key, 0) + 1
        self.rows[key] = self.rows.get(key, 0) + p.numInputRows
        log.info("%s: batch %s, %s rows, %s rows a second", key, p.batchId, p.numInputRows, p.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        log.debug("idle %s", event.id)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.exception:
            self.failed[str(event.id)] = event.exception
        log.info("ended %s", event.id)
