"""Applying streamed changes to snapshot tables, one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomspark.operators import vocabulary as voc
from loomspark.sources.tables import Store


def upsert_stream(stream: DataFrame, store: Store, name: str, keys: list[str], order: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Upserts every batch into a collection (only the buckets it touches, if it has buckets by these keys); a batch that is delivered again changes nothing.

    The number of the last applied batch is kept with the collection and moves with its pointer.
    """

    def apply(batch: DataFrame, number: int) -> None:
        if store.metadata(name).get("last_batch", -1) >= number:
            return
        store.upsert(name, batch, keys, order, {"last_batch": number})

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def vocabulary_stream(stream: DataFrame, store: Store, name: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Applies token deltas (codebase_id, token, added, removed, docs) to a vocabulary's three tables.

    `docs` is the change of the corpus's document count that a row stands for. The tables are parts of one
    version, so a batch is applied as a whole, and one that is delivered again changes nothing.
    """

    def apply(batch: DataFrame, number: int) -> None:
        if store.metadata(name).get("last_batch", -1) >= number:
            return
        state = voc.State(*[store.read(name, part) for part in ("vocabulary", "contributions", "doc_counts")])
        up = batch.filter("added > 0").groupBy("codebase_id", "token").agg(F.sum("added").alias("doc_freq"))
        down = batch.filter("removed > 0").groupBy("codebase_id", "token").agg(F.sum("removed").alias("doc_freq"))
        net = batch.groupBy("codebase_id").agg(F.sum("docs").alias("change"))
        after = voc.incremental(state, up, down, net)
        store.publish_parts(name, {"vocabulary": after.vocabulary, "contributions": after.contributions, "doc_counts": after.doc_counts}, {"last_batch": number})

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_windows(events: DataFrame, every: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """(start, event_type, events, value): tumbling windows over a stream of events with a watermark."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "events", "value")
