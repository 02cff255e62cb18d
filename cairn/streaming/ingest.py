"""Taking in document rows as a stream. An addition of this engine: batches pass through the catalog's own upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.operators import catalog
from cairn.sources.store import Store


def upsert_stream(rows: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Upsert a stream of (collection, path, title, text, raw) into the store, batch by batch, until what is there is taken in.

    A batch that is repeated after a failure changes nothing more: content is keyed by hash and documents by (collection, path). What a
    batch writes is in proportion to it; merge the parts now and then by :meth:`Store.compact`.
    """

    def take(batch: DataFrame, _: int) -> None:
        good = catalog.with_hash(batch).persist()
        store.take_in(good)
        good.unpersist()

    return rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, by: list[str], window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by event-time window; rows later than ``late`` behind the watermark are left out of a stream's result."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), *by, "n")
