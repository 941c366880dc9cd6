"""Capturing a change stream into a branch's segments with Structured Streaming."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from larchway.operators.replay import committed
from larchway.plans.store import Store
from larchway.sources.catalog import Refused


def changes(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A folder of change files as a stream, in order of arrival."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def capture(store: Store, stream: DataFrame, db: str, branch: str, table: str, holder: str, epoch: int, checkpoint: str, now: datetime | None = None, **trigger) -> StreamingQuery:
    """Flushes each micro-batch of (keys, payload, op, txid, seq, is_commit) as one segment, exactly once.

    Transactions whose commit row hasn't arrived wait beside the checkpoint for the next batch. The batch number is
    kept in the branch's metadata, so a batch that is replayed after a failure changes nothing. A writer whose lease has
    passed to another is fenced, which ends the query.
    """
    from dataclasses import replace

    pending = f"{checkpoint}/pending"

    def flush(batch: DataFrame, number: int) -> None:
        ref, _ = store.catalog.get(db, branch)
        store.catalog.fence(ref, holder, epoch)
        key = f"batch:{table}"
        if int(ref.meta.get(key, -1)) >= number:
            return
        spark = batch.sparkSession
        waiting = spark.read.schema(batch.schema).parquet(f"{pending}/{number - 1}") if number and (store.catalog.folder.__class__(f"{pending}/{number - 1}")).exists() else None
        rows = batch if waiting is None else waiting.unionByName(batch)
        done = committed(rows)
        rest = rows.join(done.select("txid").distinct(), "txid", "left_anti")
        rest.select(*batch.columns).write.mode("overwrite").parquet(f"{pending}/{number}")
        if not done.isEmpty():
            last = done.drop("is_commit", "txid")
            store.commit(db, branch, {table: last}, holder, epoch, {key: str(number)})  # one write: a crash leaves both or neither
        else:
            store.catalog.update(db, branch, lambda r: replace(r, meta=r.meta | {key: str(number)}))

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(flush).trigger(**(trigger or {"availableNow": True})).start()


def drain(query: StreamingQuery, seconds: float = 60.0) -> None:
    """Waits until everything that is there has been flushed; an error after `seconds`."""
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError("the stream isn't drained")
    if query.exception():
        raise Refused(str(query.exception()))
