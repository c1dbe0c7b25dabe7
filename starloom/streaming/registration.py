"""Registration of query sets as their files arrive: a file stream, joined per batch with a fixed reference."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from starloom.operators.spatial import nearest_within

POINTS = "set_id string, pid long, y double, x double"


def stream_points(spark: SparkSession, folder: str, schema: str = POINTS, files_per_batch: int = 16) -> DataFrame:
    """Points of query sets from JSON-lines files that are dropped into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def matched(points: DataFrame, reference: DataFrame, radius: float) -> DataFrame:
    """``set_id, n, n_inliers, frac_inliers, mean_error_um`` of points already in the reference's frame."""
    a = points.withColumnRenamed("pid", "i")
    near = nearest_within(a.withColumn("i", F.struct("set_id", "i")), reference.withColumnRenamed("pid", "j"), radius).select("i.set_id", "dist")
    sizes = points.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))
    hits = near.groupBy("set_id").agg(F.count(F.lit(1)).alias("n_inliers"), F.avg("dist").alias("mean_error_um"))
    n_in = F.coalesce("n_inliers", F.lit(0)).cast("long")
    return sizes.join(hits, "set_id", "left").select("set_id", "n", n_in.alias("n_inliers"), (n_in / F.col("n")).alias("frac_inliers"), "mean_error_um")


def register_stream(points: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run ``act(batch, number)`` on each batch of arrived points; ``once`` ends when all files present are done."""
    writer = points.writeStream.option("checkpointLocation", checkpoint).foreachBatch(act)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def append_results(path: str, reference: DataFrame, radius: float, extra: Mapping[str, str] | None = None) -> Callable[[DataFrame, int], None]:
    """A batch action: match the sets and write rows to a folder of its batch, so that a repeated batch replaces its own."""

    def act(batch: DataFrame, number: int) -> None:
        out = matched(batch, reference, radius).withColumns({k: F.lit(v) for k, v in (extra or {}).items()})
        out.write.mode("overwrite").json(f"{path}/batch={number}")

    return act


def windowed_counts(events: DataFrame, lateness: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and means of events by time window and type, with a watermark; for streams and tables alike."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    timed = events.withWatermark("ts", lateness) if events.isStreaming else events
    return timed.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")
