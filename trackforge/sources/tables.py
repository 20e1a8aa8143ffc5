"""Readers and writers: calibrations, detections, scouting documents, rosters."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CALIBRATION = """homography_matrix array<array<double>>, court_size_m array<double>, pixels_per_meter double, pixel_corners array<array<double>>,
 half_court boolean, frame_shape array<int>, max_person_height_ratio double, max_person_width_ratio double, video_reference string"""
BALL_CSV = "Frame INT, Visibility INT, X DOUBLE, Y DOUBLE, Radius DOUBLE"
RAW_BALL = "frame bigint, x double, y double, radius double, confidence double"
DETECTIONS = "video_id bigint, det_id bigint, frame bigint, track_id bigint, cls int, x1 double, y1 double, x2 double, y2 double, conf double"
SHIRT_READS = "video_id bigint, track_id bigint, seq bigint, text string, conf double"
POSES = "video_id bigint, frame bigint, position int, kp array<array<double>>, sc array<double>"
SAMPLE = "struct<frame:bigint,court_x:double,court_y:double>"
BALL = "struct<frame:bigint,img_x:double,img_y:double,court_x:double,court_y:double,conf:double>"


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """One row per calibration file, with the names that the operators use."""
    c = spark.read.schema(CALIBRATION).json(path, multiLine=True)
    w, h = F.get("court_size_m", F.lit(0)), F.get("court_size_m", F.lit(1))
    return c.select(
        F.col("homography_matrix").alias("h"), w.alias("court_w"), h.alias("court_h"), F.coalesce("pixels_per_meter", F.lit(1.0)).alias("ppm"), "pixel_corners",
        F.coalesce("half_court", h <= w).alias("half_court"), F.get("frame_shape", F.lit(0)).alias("frame_h"), F.get("frame_shape", F.lit(1)).alias("frame_w"), F.col("video_reference").alias("video"),
    )


def write_calibration(spark: SparkSession, path: str, h, corners, court: tuple[float, float], ppm: float, shape: tuple[int, int], video: str = "", **extra) -> None:
    """A calibration document, in a file of any store that Spark reaches."""
    doc = {"homography_matrix": [list(map(float, r)) for r in h], "court_size_m": list(court), "pixels_per_meter": ppm, "pixel_corners": [list(map(float, p)) for p in corners], "frame_shape": list(shape), "video_reference": video}
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(json.dumps(doc | extra, indent=2).encode()))
    finally:
        out.close()


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of people and balls (Parquet), checked against their schema."""
    return _checked(spark.read.parquet(path), DETECTIONS)


def read_shirt_reads(spark: SparkSession, path: str) -> DataFrame:
    """Numbers read from shirts (Parquet), in the order of ``seq``."""
    return _checked(spark.read.parquet(path), SHIRT_READS)


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    """Seventeen keypoints and their scores for the boxes of a frame, by position (Parquet)."""
    return _checked(spark.read.parquet(path), POSES)


def _checked(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with the columns of ``schema`` in its types; an error where one is missing."""
    want = T._parse_datatype_string(schema)
    if missing := [f.name for f in want.fields if f.name not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in want.fields))


def read_ball_csv(spark: SparkSession, path: str) -> DataFrame:
    """Visible balls of a tracker's CSV; they count as sure."""
    b = spark.read.csv(path, schema=BALL_CSV, header=True).where("Visibility = 1")
    return b.select(F.col("Frame").cast("long").alias("frame"), F.col("X").alias("x"), F.col("Y").alias("y"), F.col("Radius").alias("radius"), F.lit(1.0).alias("confidence"))


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """``number, name`` of a team; entries whose number is not an integer are skipped."""
    r = spark.read.schema("team string, players map<string,string>").json(path, multiLine=True)
    out = r.select(F.explode("players").alias("number", "name")).withColumn("number", F.col("number").try_cast("int")).where("number is not null and name is not null")
    if out.isEmpty():
        raise ValueError("the roster names no player with a number")
    return out


def samples_of(doc: Column) -> Column:
    """Samples per track in a document's JSON text: ``track_samples``, otherwise
    ``tracks``; as a list of objects or a map by id.  Summaries, whose ``samples``
    is a number, give none."""
    item = f"array<struct<id:bigint,samples:array<{SAMPLE}>>>"
    entry = lambda s: F.struct(s["id"].alias("id"), s["samples"].alias("samples"))
    by_id = f"map<string,array<{SAMPLE}>>"

    def read(field: str) -> Column:
        raw = F.get_json_object(doc, f"$.{field}")
        pairs = F.transform(F.map_entries(F.from_json(raw, by_id)), lambda e: F.struct(e["key"].cast("bigint").alias("id"), e["value"].alias("samples")))
        read_ = F.when(raw.startswith("["), F.transform(F.from_json(raw, item), entry)).when(raw.startswith("{"), pairs)
        good = F.filter(read_, lambda s: s["samples"].isNotNull() & (F.size(s["samples"]) > 0))
        return F.when(F.size(good) > 0, good)

    return F.coalesce(read("track_samples"), read("tracks"))


def read_scouting(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, ball rows and player samples of scouting files, one video each.

    An error where a document has no ball rows or no samples.
    """
    docs = spark.read.text(path, wholetext=True).select(F.col("value").alias("doc"), F.input_file_name().alias("video"))
    docs = docs.withColumns({"video_id": F.xxhash64("video"), "duration_s": F.get_json_object("doc", "$.duration_s").cast("double"), "balls": F.from_json(F.get_json_object("doc", "$.ball_track"), f"array<{BALL}>"), "tracks": samples_of(F.col("doc"))})
    bad = docs.where("coalesce(size(balls), 0) <= 0 or tracks is null").select("video").first()
    if bad:
        raise ValueError(f"{bad[0]} has no ball track or no raw player samples")
    balls = docs.select("video_id", F.posexplode("balls").alias("det_id", "b")).select("video_id", "det_id", "b.*")
    tracks = docs.select("video_id", F.posexplode("tracks").alias("nth", "t")).select("video_id", "nth", F.col("t.id").alias("track_id"), F.posexplode("t.samples").alias("k", "s"))
    samples = tracks.select("video_id", "track_id", (F.col("nth") * 1_000_000 + F.col("k")).alias("det_id"), "s.frame", "s.court_x", "s.court_y")
    return docs.select("video_id", "video", "doc", "duration_s"), balls, samples


def signature(**inputs) -> str:
    """Key of what a detector would compute: its inputs, rounded where they are floats."""
    plain = {k: round(v, 4) if isinstance(v, float) else v for k, v in inputs.items()}
    return hashlib.sha256(json.dumps(plain, sort_keys=True).encode()).hexdigest()


def cached(spark: SparkSession, folder: str | None, compute: Callable[[], DataFrame], schema: str | T.StructType = RAW_BALL, **inputs) -> DataFrame:
    """What ``compute`` gave for these inputs before, or gives now.

    Kept as Parquet under the inputs' signature; a missing or damaged copy is
    computed again.  Parquet's commit makes half-written copies invisible.
    """
    if folder is None:
        return compute()
    path = f"{folder}/{signature(**inputs)}"
    try:
        kept = spark.read.schema(schema).parquet(path)
        kept.write.format("noop").mode("overwrite").save()
        fs = spark._jvm.org.apache.hadoop.fs.Path(path)
        if fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(fs, "_SUCCESS")):
            return kept
    except Exception:  # noqa: BLE001  whatever is wrong with the copy, it is made anew
        spark.catalog.clearCache()
    compute().write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def inside_feet(ball: DataFrame, feet: DataFrame) -> DataFrame:
    """Ball points inside the bounding box of all foot points, edges included."""
    box = feet.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if box[0] is None:
        return ball.limit(0)
    return ball.where(F.col("x").between(box[0], box[1]) & F.col("y").between(box[2], box[3]))


def upside_down(feet: DataFrame, frame_h: int) -> bool:
    """Whether the far side is below: people above the middle look taller than below."""
    top = F.col("y") < frame_h / 2
    r = feet.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(top, F.col("height"))).alias("a"), F.avg(F.when(~top, F.col("height"))).alias("b")).first()
    return bool(r["n"] >= 4 and r["a"] is not None and r["b"] is not None and r["a"] > r["b"])
