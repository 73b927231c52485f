"""A stream of inserts, updates and deletes applied to a vector table, batch after batch.

A mutation has op ('upsert' or 'delete'), seq, id, vector and the table's metadata. Within a batch the last mutation of
an id wins. The batch's number is kept beside the table, so a batch that runs again after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lifecycle import Lifecycle
from ..operators.table import VectorTable


def last_of_each(batch: DataFrame) -> DataFrame:
    packed = batch.groupBy("id").agg(F.max_by(F.struct(*batch.columns), "seq").alias("row"))
    return packed.select("row.*")


def apply_batch(table: VectorTable, batch: DataFrame, number: int) -> bool:
    """Whether the batch was new and has been applied."""
    done = f"batches/{number:012d}"
    if done.split("/")[1] in table.store.names("batches"):
        return False
    last = last_of_each(batch).persist()
    try:
        upserts = last.where("op = 'upsert'").select("id", "vector", *[f"`{n}`" for n in table.spec.schema.names])
        if not last.where("op = 'delete'").isEmpty():
            table.delete(last.where("op = 'delete'").select("id"))
        if not upserts.isEmpty():
            table.update(upserts)
    finally:
        last.unpersist()
    table.store.create(done, "")
    return True


def start(stream: DataFrame, table: VectorTable, checkpoint: str, lifecycle: Lifecycle | None = None, interval: str | None = None, available_now: bool = False):
    """Starts the query that applies a stream of mutations; with a lifecycle, a batch after which the table needs it compacts it."""

    def each(batch: DataFrame, number: int) -> None:
        apply_batch(table, batch, number)
        if lifecycle and lifecycle.needed():
            lifecycle.compact()

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval) if interval else writer
    return writer.start()


def visible_state(events: DataFrame, delete_when, order: str = "generation") -> DataFrame:
    """The rows of a mutation log that no later delete of the same id hides, in one aggregation and one join."""
    gone = events.where(delete_when).groupBy("id").agg(F.max(order).alias("gone_at"))
    return events.where(~delete_when).join(gone, "id", "left").where(F.col("gone_at").isNull() | (F.col(order) > F.col("gone_at"))).drop("gone_at")
