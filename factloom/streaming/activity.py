"""Windowed activity over a stream of rows, kept in a table that every micro-batch brings up to date."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which the cluster shares. Only a local master may leave it unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or "file://" + tempfile.mkdtemp(prefix="factloom-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def windowed(rows: DataFrame, time: str, keys: list[str], measure: str, width: str = "1 day", late: str = "3 days") -> DataFrame:
    """Count and sum of each key in each tumbling window; rows later than `late` behind the newest are dropped by the watermark.

    The same expression runs on a stream and on a table. Rows without a time are in no window.
    """
    slots = rows.withWatermark(time, late).groupBy(F.window(time, width).alias("slot"), *keys)
    return slots.agg(F.count("*").alias("n"), F.sum(measure).alias("total")).select(F.col("slot.start").alias("start"), *keys, "n", "total")


def drain(stream: DataFrame, key: list[str], folder: str) -> DataFrame:
    """Runs an update-mode stream over all that is there now; returns the newest row of each key.

    A micro-batch overwrites its own folder, so one that is repeated after a
    failure counts once; the offsets lie beside them, so a next call resumes.
    """
    spark = stream.sparkSession
    state = f"{folder}/state"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state}/batch={number}")

    writer = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True)
    writer.foreachBatch(keep).start().awaitTermination()
    rows = spark.read.option("basePath", state).schema(stream.schema.add("batch", "long")).parquet(state)
    rest = [c for c in stream.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("newest")).select(*key, "newest.*")
