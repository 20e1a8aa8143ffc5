"""Poses and identities: alignment with boxes, statistics, and their place in the track table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G

TRACK = ["video_id", "track_id"]
#: fixed value: the name of a track that nobody recognised
UNKNOWN = "desconocida"


def positions(df: DataFrame, key: str, name: str = "position") -> DataFrame:
    """Number the rows of each frame from 1, in the order of ``key``."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy("video_id", "frame").orderBy(key)))


def pose_to_boxes(boxes: DataFrame, poses: DataFrame, least: float = 0.3, key: str = "det_id") -> DataFrame:
    """``boxes(video_id, frame, ...)`` with the pose of the same position in their frame.

    ``poses(video_id, frame, position, kp, sc)``.  A pose counts where its mean score is
    ``least`` at least; otherwise, and where a frame has fewer poses than boxes, ``kp``
    and ``sc`` are null.
    """
    mean = F.aggregate("sc", F.lit(0.0), lambda a, x: a + x) / F.size("sc")
    sure = poses.where(mean >= least).select("video_id", "frame", "position", "kp", "sc")
    return positions(boxes, key).join(sure, ["video_id", "frame", "position"], "left")


def pose_stats(samples: DataFrame, part: list[str] = TRACK, dp: int = 1, knee_dp: int | None = None) -> DataFrame:
    """Lean, stance and knee angle of each track that has any of them."""
    m = samples.select(*part, *(f("kp", "sc").alias(n) for n, f in G.POSE_METRICS.items()))
    t = m.groupBy(*part).agg(
        F.count("lean").alias("samples_with_pose"), F.round(F.avg("lean"), dp).alias("torso_lean_deg_avg"), F.round(F.max("lean"), dp).alias("torso_lean_deg_max"),
        F.round(F.avg("stance"), dp).alias("stance_width_px_avg"), F.round(F.avg("knee"), dp if knee_dp is None else knee_dp).alias("knee_flexion_deg_avg"),
    )
    return t.where("samples_with_pose > 0 or stance_width_px_avg is not null or knee_flexion_deg_avg is not null")


def attach(summary: DataFrame, found: DataFrame, name: str, part: list[str] = TRACK) -> DataFrame:
    """``summary`` with the other columns of ``found`` as one struct; null for tracks
    without a row there."""
    rest = [c for c in found.columns if c not in part]
    return summary.join(found.select(*part, F.struct(*rest).alias(name)), part, "left")


def identified(votes: DataFrame, part: list[str]) -> DataFrame:
    """How many tracks have a name."""
    return (votes.groupBy(*part) if part else votes).agg(F.count_if(F.col("name") != UNKNOWN).alias("players_identified"), F.count(F.lit(1)).alias("tracks"))
