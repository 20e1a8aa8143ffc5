"""Live counterparts on Structured Streaming.

Event time is the frame's time.  Rows behind the watermark are dropped, which a
batch run does not do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_time(df: DataFrame, fps: float) -> DataFrame:
    return df.withColumn("at", F.timestamp_micros((F.col("frame") / fps * 1_000_000).cast("long")))


def live_rallies(ball: DataFrame, fps: float, gap_s: int = 2, late_s: int = 10, least_n: int = 3, least_s: float = 1.0) -> DataFrame:
    """Rallies as sessions per video; rows exactly ``gap_s`` apart stay together."""
    w = with_time(ball, fps).withWatermark("at", f"{late_s} seconds")
    s = w.groupBy("video_id", F.session_window("at", f"{gap_s} seconds")).agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count(F.lit(1)).alias("n_points"))
    seconds = (F.col("end_frame") - F.col("start_frame")) / fps
    return s.where((F.col("n_points") >= least_n) & (seconds >= least_s)).select("video_id", "start_frame", "end_frame", F.bround(seconds, 2).alias("duration_s"), "n_points")


def live_zones(samples: DataFrame, zone, fps: float, window: str = "1 minute", late_s: int = 10) -> DataFrame:
    """Zone visits in tumbling windows."""
    w = with_time(samples, fps).withWatermark("at", f"{late_s} seconds").withColumn("zone", zone).where("zone is not null")
    return w.groupBy("video_id", F.window("at", window), "zone").agg(F.count(F.lit(1)).alias("visits")).select("video_id", F.col("window.start").alias("since"), "zone", "visits")


def live_votes(reads: DataFrame) -> DataFrame:
    """Running weight of each number of each track (update mode)."""
    return reads.groupBy("video_id", "track_id", "number").agg(F.sum("conf").alias("weight"), F.count(F.lit(1)).alias("votes"))
