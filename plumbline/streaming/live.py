"""Counters of a running stream: events taken in and alerts fired, batch by batch."""

from __future__ import annotations

from threading import Lock

from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from plumbline.sources.store import Store


class LiveCounters(StreamingQueryListener):
    """Sums up what the batches of a stream of streaming.replay observed while they were processed.

    A batch counts once, however often it runs or is reported, and batches of earlier starts with the same tables
    count from the beginning, so that the totals equal plans.ingest.counters() after each batch. Only numbers of the
    batches are held here.
    """

    def __init__(self, store: Store):
        self._store, self._lock = store, Lock()
        self._batches: dict[int, tuple[int, int]] = {}
        self._query: str | None = None
        self._pace = (0.0, 0)
        for row in store.read("batches").select("batch", "events_ingested", "alerts_fired").collect():
            self._batches[row["batch"]] = (row["events_ingested"], row["alerts_fired"])

    def follow(self, query: StreamingQuery) -> LiveCounters:
        """Listen to the query from now on."""
        self._query = str(query.id)
        self._store.spark.streams.addListener(self)
        return self

    def close(self) -> None:
        self._store.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if str(progress.id) != self._query:
            return
        row = self._store.read("batches", parts=[progress.batchId]).first()
        with self._lock:
            if row is not None:
                self._batches[progress.batchId] = (row["events_ingested"], row["alerts_fired"])
            self._pace = (progress.processedRowsPerSecond or 0.0, progress.batchDuration)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def totals(self) -> dict[str, float]:
        """Now: events_ingested, alerts_fired, batches, and the pace of the last batch."""
        with self._lock:
            events, alerts = (sum(c) for c in zip(*self._batches.values(), strict=True)) if self._batches else (0, 0)
            pace, took = self._pace
            return {"events_ingested": events, "alerts_fired": alerts, "batches": len(self._batches), "events_per_second": pace, "batch_milliseconds": took}
