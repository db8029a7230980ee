"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Files landing in a folder, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, time: str, by: str, value: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts and sums by event-time window; rows later than `late` behind the latest are left out."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")


def sessions(events: DataFrame, time: str, by: str, gap: str, late: str) -> DataFrame:
    """Sessions that end after a gap, by event time."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), by, "n")


def first_seen(events: DataFrame, key: list[str], time: str, late: str) -> DataFrame:
    """Each canonical key once; keys are forgotten when the watermark has passed them."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def cursors(events: DataFrame, folder: str, validity: str, uid: str) -> DataFrame:
    """The cursor of each folder: the greatest uid of its current validity; a new validity starts it anew.

    Emits (folder, validity, last_uid, accepted) for each batch of a folder;
    rows at or before the cursor are repeats and are not accepted again.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        valid, last = state.get if state.exists else (None, -1)
        accepted = 0
        rows = pd.concat(list(batches)).sort_values([validity, uid])
        for v, u in zip(rows[validity].tolist(), rows[uid].tolist(), strict=True):
            if valid is None or v > valid:
                valid, last = v, -1
            if v == valid and u > last:
                last, accepted = u, accepted + 1
        state.update((valid, last))
        yield pd.DataFrame({"folder": [str(key[0])], "validity": [valid], "last_uid": [last], "accepted": [accepted]})

    rows = events.select(F.col(folder).cast("string").alias(folder), F.col(validity).cast("long").alias(validity), F.col(uid).cast("long").alias(uid))
    return rows.groupBy(folder).applyInPandasWithState(step, "folder string, validity long, last_uid long, accepted long", "validity long, last_uid long", "update", GroupStateTimeout.NoTimeout)


def upsert(target: str, keys: list[str], order: str):
    """A foreachBatch function: keeps the latest row of each key in a folder of numbered versions.

    A version is a whole table written under its batch number, so a batch that
    runs again overwrites its own version and nothing else. The version before
    stays for readers and for a repeated batch; older ones are deleted. Each
    batch writes the whole table: this is for state tables of moderate size.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in keys]
        rows = batch
        if number > 0:
            rows = spark.read.schema(batch.schema).parquet(f"{target}/v{number - 1}").unionByName(batch)
        rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, "_r.*").write.mode("overwrite").parquet(f"{target}/v{number}")
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/v{number - 2}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return write


#: States of a document on its way through the index, in order.
STATES = ["PENDING", "CONVERT", "EMBED", "UPSERT", "INDEXED", "ERROR"]


def progress_of(log: DataFrame, key: str, state: str, time: str) -> DataFrame:
    """The latest state of each document and how many steps it has taken."""
    return log.groupBy(key).agg(F.max_by(state, F.struct(time, F.array_position(F.lit(STATES), F.col(state)))).alias("state"), F.count(F.lit(1)).alias("steps"))
