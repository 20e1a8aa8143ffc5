"""Detections, votes and poses derived from the driver's tables, by integer
arithmetic that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FPS, FRAME_W, FRAME_H, VIDEOS = 1 / 60, 1280, 720, 8  # a frame is a minute of event time
FIRST_MINUTE = 28401120


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "props")
    i = F.col("event_id")
    return e.select(
        i.alias("det_id"),
        F.col("user_id").alias("track_id"),
        (F.col("user_id") % VIDEOS).alias("video_id"),
        (F.floor(F.unix_timestamp("ts") / 60) - FIRST_MINUTE).alias("frame"),
        ((i * 31) % 1280).cast("double").alias("img_x"),
        ((i * 37) % 720).cast("double").alias("img_y"),
        (((i * 7919) % 9500) / 1000 - F.lit(0.25)).alias("court_x"),
        (((i * 104729) % 18500) / 1000 - F.lit(0.25)).alias("court_y"),
        (((i * 13) % 1000) / 1000).alias("conf"),
        ((i * 31) % 1280).alias("x1"),
        ((i * 37) % 720).alias("y1"),
        F.least((i * 31) % 1280 + (i * 17) % 640, F.lit(1280)).alias("x2"),
        F.least((i * 37) % 720 + (i * 23) % 520, F.lit(720)).alias("y2"),
        F.get_json_object("props", "$.k").alias("text"),
    )


#: the same rows in DuckDB
DET = """det AS (
  SELECT event_id AS det_id, user_id AS track_id, user_id % 8 AS video_id, CAST(floor(epoch(ts) / 60) AS BIGINT) - 28401120 AS frame,
    CAST((event_id * 31) % 1280 AS DOUBLE) AS img_x, CAST((event_id * 37) % 720 AS DOUBLE) AS img_y,
    ((event_id * 7919) % 9500) / 1000 - CAST(0.25 AS DOUBLE) AS court_x, ((event_id * 104729) % 18500) / 1000 - CAST(0.25 AS DOUBLE) AS court_y,
    ((event_id * 13) % 1000) / 1000 AS conf,
    (event_id * 31) % 1280 AS x1, (event_id * 37) % 720 AS y1,
    least((event_id * 31) % 1280 + (event_id * 17) % 640, 1280) AS x2, least((event_id * 37) % 720 + (event_id * 23) % 520, 720) AS y2,
    json_extract_string(props, '$.k') AS text
  FROM events
)"""


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors read as 17 keypoints and their scores."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    kp = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda j: F.array(F.get("v", j * 2), F.get("v", j * 2 + 1)))
    sc = F.transform(F.slice("v", 35, 17), lambda s: s + 0.5)
    return e.select("vec_id", (F.col("vec_id") % 7).alias("track_id"), kp.alias("kp"), sc.alias("sc"))
