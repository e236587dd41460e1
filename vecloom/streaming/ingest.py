"""Micro-batches of new vectors into a database, found by the next search."""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..db import VectorDB
from ..errors import NoVectors


def ingest(stream: DataFrame, db: VectorDB, checkpoint: str, interval: str | None = None, maintain: bool = False, on_error: Callable[[Exception], None] | None = None, order: str | None = None) -> StreamingQuery:
    """Add each micro-batch (vec_id, embedding[, metadata]); centroids move once a batch.

    Rows carry the stream (named by its checkpoint) and the number of their batch, so a batch that comes again after a
    restart adds nothing. A later version of an id replaces an earlier one; of rows that repeat an id within a batch the
    one with the largest `order` counts (without it such a batch is refused). With maintain, the index is rebuilt when
    enough has changed.
    """
    name = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            if not batch.isEmpty():
                db.add(batch, order=order, batch=(name, number))
                if maintain:
                    db.maintain()
        except Exception as error:
            if on_error is None:
                raise
            on_error(error)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


class Maintenance:
    """Builds or rebuilds every `interval` seconds if enough has changed; errors but an empty database go to on_error."""

    def __init__(self, db: VectorDB, interval: float, on_error: Callable[[Exception], None] | None = None):
        self.db, self.interval, self.on_error, self.builds = db, interval, on_error, 0
        self._stop, self._thread = threading.Event(), None

    def start(self) -> Maintenance:
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()
        return self

    def _run(self) -> None:
        while not self._stop.wait(self.interval):
            try:
                self.builds += self.db.maintain()
            except NoVectors:
                pass
            except Exception as error:
                if self.on_error is not None:
                    self.on_error(error)

    def stop(self) -> None:
        self._stop.set()
        if self._thread:
            self._thread.join()
