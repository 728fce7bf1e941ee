"""Structured Streaming counterparts: windowed counts, deduplication, sessions and guarded monthly appends."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from girder.operators.lifecycle import judged_appends
from girder.operators.panel import snapshot_features
from girder.sources.staging import shared_folder, staged


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", schema=None) -> DataFrame:
    """A stream over a Parquet table of a folder. Its times become timestamps in the session's zone, which watermarks need."""
    there = spark.read.parquet(f"{folder}/{name}")
    reader = spark.readStream.schema(schema or there.schema)
    one_file = any(f.rstrip("/").endswith(f"/{name}") for f in there.inputFiles()[:1])
    rows = reader.option("pathGlobFilter", name).parquet(folder) if one_file else reader.parquet(f"{folder}/{name}")
    return rows.withColumns({c: F.col(c).cast("timestamp") for c, t in rows.dtypes if t == "timestamp_ntz"})


def bucketed(events: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts and sums by time bucket and type; on a stream, buckets close when the watermark passes them."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    rows = events.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """A user's events with no pause of `gap` between them."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    rows = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def appending(rows: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run a guarded batch append on each micro-batch, exactly once for each batch id that `apply` records."""
    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_once(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Drain what is there into a Parquet table (append mode), for tests and backfills."""
    rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drained(rows: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """What a streaming query gives once everything there is has been read: its last result in complete mode, else all batches.

    A batch is a folder of its own, so that a batch that runs again replaces itself.
    """
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/girder/{name}-{uuid.uuid4().hex}"
    spark.createDataFrame([], rows.schema).write.parquet(f"{path}/out/batch=-1")
    done = [-1]

    def put(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={k}")
        done.append(k)

    stream = rows.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint")
    stream.trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{path}/out")
    out = out.where(F.col("batch") == max(done)) if mode == "complete" else out
    return out.drop("batch")


def guarded_appends(rows: DataFrame, projects: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of monthly rows to folder/snapshots under the guards of lifecycle.judged_appends.

    Each micro-batch is judged against what earlier batches left: repeated months, rows after a project's end and the other
    guards' refusals go to folder/refused with their reasons; late rows are taken. The features of every project that the batch
    touched are computed anew over its whole history into folder/features, where the rows of the highest batch count. A batch that runs
    again replaces its own folders. Batches go on from what the folder holds when a checkpoint is first used, so a fresh checkpoint, of the same name
    too, adds to earlier batches and is judged against them. One stream at a time writes to a folder.
    """

    def put(batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        k += _first_batch(spark, folder, checkpoint)
        before = spark.read.parquet(f"{folder}/snapshots").where(F.col("batch") < k).drop("batch")
        judged = staged(judged_appends(batch, before, projects), "judged")
        good = judged.where("refused IS NULL").select(*[c for c in before.columns if c in judged.columns])
        good.write.mode("overwrite").parquet(f"{folder}/snapshots/batch={k}")
        judged.where("refused IS NOT NULL").write.mode("overwrite").parquet(f"{folder}/refused/batch={k}")
        touched = good.select("project_id").distinct()
        history = before.unionByName(good, allowMissingColumns=True).join(touched, "project_id", "left_semi")
        starts = projects.select("project_id", "planned_duration_months")
        snapshot_features(history.join(starts, "project_id", "left")).write.mode("overwrite").parquet(f"{folder}/features/batch={k}")

    return appending(rows, put, checkpoint)


def _first_batch(spark: SparkSession, folder: str, checkpoint: str) -> int:
    """The number of a checkpoint's batch 0, kept in folder/streams under the id that Spark gave the checkpoint."""
    own = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
    try:
        known = spark.read.schema("id string, first int").parquet(f"{folder}/streams").where(F.col("id") == own).agg(F.min("first")).first()[0]
    except AnalysisException:  # no stream has written here yet
        known = None
    if known is None:
        known = spark.read.parquet(f"{folder}/snapshots").agg(F.coalesce(F.max("batch"), F.lit(-1)) + 1).first()[0]
        spark.createDataFrame([(own, known)], "id string, first int").coalesce(1).write.mode("append").parquet(f"{folder}/streams")
    return known


def latest_features(features: DataFrame) -> DataFrame:
    """The rows of folder/features that count: of each project those of its highest batch."""
    last = features.groupBy("project_id").agg(F.max("batch").alias("batch"))
    return features.join(last, ["project_id", "batch"])
