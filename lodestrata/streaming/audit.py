"""The audit log as a stream: an addition to batch, for continuous ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.lineage import durable

EVENTS = "created boolean, memory_id string, timestamp string, type string"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of events as they are appended under a folder."""
    return spark.readStream.schema(EVENTS).json(path).withColumn("at", F.try_to_timestamp("timestamp"))


def rates(events: DataFrame, minutes: int = 60, late: str = "10 minutes") -> DataFrame:
    """Events of each kind in windows of ``minutes``; on a stream, those later than ``late`` behind the newest don't count."""
    rows = events.withWatermark("at", late) if events.isStreaming else events
    return rows.groupBy(F.window("at", f"{minutes} minutes").alias("w"), "type").agg(F.count("*").alias("events"), F.approx_count_distinct("memory_id").alias("units") if events.isStreaming else F.count_distinct("memory_id").alias("units")).select(F.col("w.start").alias("start"), "type", "events", "units")


def merge_each(stream: DataFrame, root: str, checkpoint: str, table: str = "units"):  # noqa: ANN201
    """Continuous merge of a stream of rows into a store's table; each micro-batch is one commit, and a batch that was committed before a failure is not
    merged again. A stream with ``seq`` says which of two rows of a batch is the later one. A table that was never written starts empty."""
    from lodestrata.operators import merge
    from lodestrata.plans.imports import Import
    from lodestrata.sources.store import Store

    note = f"stream:{checkpoint}"

    def go(batch: DataFrame, number: int) -> None:
        store = Store(batch.sparkSession, root)
        if store.head().notes.get(note, -1) >= number:
            return
        staged = batch if "seq" in batch.columns else durable(batch.withColumn("seq", F.monotonically_increasing_id()))

        def make(base):  # noqa: ANN001, ANN202
            old = store.table(table, base, staged.drop("seq"))
            plan = durable(merge.merge_plan(old.near(staged), staged, key=old.spec["key"][0]))
            return Import({}, {}, changed={table: plan.select(*old.columns)})

        store.update(make, notes={note: number})

    return stream.writeStream.foreachBatch(go).option("checkpointLocation", checkpoint)
